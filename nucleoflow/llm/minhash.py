"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nucleoflow.llm.common import NULL_ID, null_back, stored, texts
from nucleoflow.llm.hashing import byte_chunks, mix64, shingles, word_hashes
from nucleoflow.operators.graph import components
from nucleoflow.session import materialize

#: 25 bands of 5 rows miss a pair of similarity 0.85 with a chance of 5e-7, and one of 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: A pair is pruned once the posterior chance that it is similar enough is below this.
MISS = 1e-7
BATCH = 25
TILE = 256
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """Least 32 bits of each of the 125 permutations of the set."""
    out = np.full(_SEEDS.size, np.uint64(2**64 - 1))
    for i in range(0, found.size, 8192):
        part = found[i : i + 8192]
        np.minimum(out, ((part[None, :] ^ (_SEEDS[:, None] >> np.uint64(7))) * _SEEDS[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


@cache
def least_matches(n: int, percent: int) -> int:
    """Fewest of n equal components with which P(similarity >= percent) stays at MISS or more.

    The prior is uniform, so with m matches the posterior is Beta(m + 1, n - m + 1),
    whose upper tail at t is the chance of at most m successes in n + 1 trials of t.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= MISS:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Places of the rows of ``a`` and ``b`` that no batch of components rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n in range(BATCH, _SEEDS.size + 1, BATCH):
        matches = matches + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        good = matches >= least_matches(n, percent)
        alive, matches = alive[good], matches[good]
    return alive


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig): digest names the set; both are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in byte_chunks(batch.column(1)):
                words, at = word_hashes(data, offsets)
                counts, digests, sigs = [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found = shingles(words[a:b], size)
                    counts.append(found.size)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if found.size else None)
                    sigs.append(signature(found).tobytes() if found.size else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def band_codes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit code for each of the 25 bands of each signature."""
    parts = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
    code = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return code.view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    """(band, cid) for the 25 bands of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                code = band_codes(_matrix(batch.column(1))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(cid)], names=["band", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "band long, cid long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), _SEEDS.size)


def _pruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose signatures leave them a chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), percent)
                yield batch.select(["a", "b"]).take(pa.array(good))

    both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b"
    )
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct hashes share ``percent`` of their union."""
    common = np.intersect1d(x, y, assume_unique=True).size
    return bool(common) and 100 * common >= percent * (x.size + y.size - common)


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, data, offsets in byte_chunks(column):
        words, at = word_hashes(data, offsets)
        yield from (shingles(words[x:y], size) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _confirmed(pairs: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) whose whole shingle sets are similar enough, as (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(sets_of(batch.column(2), size), sets_of(batch.column(3), size), strict=True)
            good = [similar(x, y, percent) for x, y in both]
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )
    rows = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "ta", "tb")
    return rows.mapInArrow(run, "src long, dst long").distinct()


def _across(members: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (src, dst) between members of one band and different components.

    A band's members are dealt into tiles of bounded size and two tiles meet in
    one task. There a pair is pruned by its signatures, then confirmed on the
    full sets, the likeliest first; a link joins the components, so what
    follows from it isn't compared and at most one link a member is written. A
    pair is compared in the first of its common bands only.
    """
    by_band = Window.partitionBy("band").orderBy("cid")
    tiled = materialize(members.withColumn("tile", F.floor((F.row_number().over(by_band) - 1) / TILE).cast("int")))
    last = tiled.groupBy("band").agg(F.max("tile").alias("last"))
    met = tiled.join(last, "band").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    met = met.select("band", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "cid", "component")
    rows = met.join(held.withColumnRenamed("doc_id", "cid"), "cid")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        band, t1, t2 = (table.column(c)[0].as_py() for c in ("band", "t1", "t2"))
        tile, cid = table.column("tile").to_numpy(), table.column("cid").to_numpy()
        sets = list(sets_of(table.column("text").chunk(0), size))
        sig = np.stack([signature(x) for x in sets])
        codes = band_codes(sig)
        k = int((codes == band).sum(axis=0).argmax())
        comp = table.column("component").to_numpy().copy()
        left = np.flatnonzero(tile == t1)
        right = left if t2 == t1 else np.flatnonzero(tile == t2)
        src, dst = [], []
        for i in left.tolist():
            others = right[comp[right] != comp[i]]
            others = others[others > i] if t1 == t2 else others
            others = others[~(codes[others, :k] == codes[i, :k]).any(axis=1)]
            good = others[survivors(np.broadcast_to(sig[i], (others.size, sig.shape[1])), sig[others], percent)]
            for j in good[np.argsort(-(sig[good] == sig[i]).sum(axis=1), kind="stable")].tolist():
                if comp[i] != comp[j] and similar(sets[i], sets[j], percent):
                    src.append(min(cid[i], cid[j]))
                    dst.append(max(cid[i], cid[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return rows.groupBy("band", "t1", "t2").applyInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Texts whose sets of ``size``-word shingles share ``percent`` of their union
    are linked; a component is named by its smallest doc_id. Equal sets form a
    class, which takes part once. Members of a band first meet the band's least
    class; bands whose further members are still in several components are
    compared tile by tile, so no pair that shares a band is left out. Null or wordless texts are
    linked with nothing. Rows that share a doc_id count as one document with
    several texts. An empty table gives no rows.
    """
    base = materialize(sketch(docs, size))
    light = base.select("doc_id", "digest")
    names = light.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"))
    classes = materialize(names)
    sigs = materialize(
        base.join(classes, (base["digest"] == classes["digest"]) & (base["doc_id"] == classes["cid"])).select("cid", "sig").dropDuplicates(["cid"])
    )
    bands = _bands(sigs)
    groups = bands.groupBy("band").agg(F.min("cid").alias("head"), F.max("cid").alias("tail")).where("head < tail")
    members = materialize(bands.join(groups.select("band", "head"), "band"))
    ids = members.select(F.col("cid").alias("doc_id")).distinct()
    held = stored(texts(docs).join(ids, "doc_id", "left_semi"), "near-texts")
    stars = members.where("cid > head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    links = materialize(_confirmed(_pruned(stars, sigs, percent), held, size, percent))
    found = components(links)
    others = members.where("cid > head").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    others = materialize(others.select("band", "cid", F.coalesce("component", "cid").alias("component")))
    several = others.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    rest = others.join(several.select("band"), "band", "left_semi")
    more = materialize(_across(rest, held, size, percent))
    if not more.isEmpty():
        found = components(materialize(links.union(more)))
    labels = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select(
        "digest", F.coalesce("component", "cid").alias("component_id")
    )
    out = base.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    back = F.when(component != NULL_ID, component)
    return out.select(
        null_back("doc_id").alias("doc_id"), "n_shingles", back.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; the columns are those of ``docs``."""
    found = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_gone"]), "left_anti")
