"""Removal of byte strings that an earlier document has: Burrows-Wheeler transforms of anchored contexts.

A common prefix of at least ``LEAST`` bytes is found in three steps.

1. Anchors: in every run of LEAST bytes the k-mer with the least hash is an
   anchor. Equal runs have equal anchors, so only anchors that two texts share
   lead anywhere. Hashes are dealt into buckets; a bucket finds the shared ones.
2. Contexts: around each shared anchor lie all runs that hold it. Contexts with
   the same anchor go to one bucket. Equal contexts are collapsed first, so a
   passage that many documents repeat costs one context a batch. The anchors
   with the most texts send their runs one by one, dealt by the run's own hash.
3. In a bucket contexts are cut to what another context of the anchor has too,
   equal ones are collapsed, and the rest is suffix-sorted and transformed. Breadth-first
   backward extension derives the boundaries between suffixes whose common
   prefix has 0, 1, 2, ... bytes and stops at LEAST: suffixes left between two
   boundaries share LEAST bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoflow.llm.common import null_back, stored, texts
from nucleoflow.llm.hashing import byte_chunks, mix64
from nucleoflow.session import materialize

LEAST = 50
K = 20
SIDE = LEAST - K
SPAN = 2 * LEAST - K
#: Bytes of text for each bucket of anchors, and buckets of contexts for each of those.
BUCKET_BYTES = 8 << 20
FINER = 4
LEAST_BUCKETS = 64
#: Anchors that a task gathers before it sends them.
GATHER = 1 << 21
#: Anchors in more texts than this are hot; at most HOT_LIST of them, those in most texts.
HOT, HOT_LIST = 50_000, 20_000
#: Ids of exact copies that may be broadcast, 8 bytes each.
FEW_COPIES = 1_000_000
_P = np.uint64(0x100000001B3)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_P), n, 2**64))


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes at each place."""
    if data.size < K:
        return np.zeros(0, np.uint64)
    e1 = data.astype(np.uint64)
    e2 = e1[:-1] * _P + e1[1:]
    e4 = e2[:-2] * _power(2) + e2[2:]
    e8 = e4[:-4] * _power(4) + e4[4:]
    e16 = e8[:-8] * _power(8) + e8[8:]
    n = data.size - K + 1
    return mix64(e16[:n] * _power(4) + e4[16 : 16 + n]) | np.uint64(1)


def _slide(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each SIDE + 1 = 31 neighbours."""
    for step in (1, 2, 4, 8):
        x = pick(x[:-step], x[step:])
    return pick(x[:-15], x[15:])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, text) of the anchors of the texts that ``offsets`` cuts out of ``data``."""
    nothing = np.zeros(0, np.int64)
    if data.size < LEAST:
        return nothing, nothing.view(np.uint64), nothing
    h = kmer_hashes(data)
    least = _slide(h, np.minimum)
    inside = np.zeros(data.size + 1, np.int32)  # runs that start here stay within their text
    lengths = np.diff(offsets)
    long = lengths >= LEAST
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - LEAST + 1)[long], -1)
    least = np.where(np.cumsum(inside[: least.size]) > 0, least, np.uint64(0))
    pad = np.zeros(SIDE, np.uint64)
    place = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), np.maximum) == h)
    return place, h[place], np.searchsorted(offsets, place, "right") - 1


def keys_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high bits, 40 bits of hash below."""
    return (((h & np.uint64(0xFFFFFF)) % np.uint64(buckets)) << np.uint64(40) | h >> np.uint64(24)).view(np.int64)


def _firsts(order_by: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], order_by[1:] != order_by[:-1]])) if order_by.size else np.zeros(0, np.int64)


def _per_doc(doc: np.ndarray, values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Values (rows of 64-bit integers) gathered by document."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    at = _firsts(doc)
    ends = np.append(at, doc.size)[1:]
    return doc[at].tolist(), [values[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]


def _packed(values: np.ndarray) -> bytes:
    """Bytes of an array behind their length, compressed."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd"), dtype) for x in column.to_pylist()]


def _join(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


ASKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("doc", pa.binary()), ("key", pa.binary()), ("n", pa.binary())])


def ask(buckets: int):
    """Batches of (doc_id, text) to rows for the buckets.

    Kind 0 holds one document for each anchor of the gathered batch, kind 1 the
    further documents of anchors that two of its texts share already.
    """

    def send(doc: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        doc, key = doc[new], key[new]
        at = _firsts(key)
        count = np.diff(np.append(at, key.size)).astype(np.int32)
        later = np.ones(key.size, bool)
        later[at] = False
        known_doc, known_key = doc[later], key[later]
        one_doc, one_key = doc[at], key[at]
        rows: list[tuple] = []
        by = np.lexsort((one_doc, one_key >> 40))
        one_doc, one_key, count = one_doc[by], one_key[by], count[by]
        cuts = _firsts(one_key >> 40)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), one_key.size], strict=True):
            docs, low = one_doc[a:b], one_key[a:b] & ((1 << 40) - 1)
            five = np.ascontiguousarray(low.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            steps = np.diff(docs, prepend=np.int64(0)).astype("<i8")
            rows.append((int(one_key[a] >> 40), 0, steps.tobytes(), five, count[a:b].tobytes()))
        if known_doc.size:
            for i, (d, k) in enumerate(zip(*_per_doc(known_doc, known_key), strict=True)):
                rows.append((i % buckets, 1, np.int64(d).tobytes(), k, b""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ASKED, strict=True)], schema=ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in byte_chunks(batch.column(1)):
                _, h, text = anchors(data, offsets)
                docs.append(ids[first + text])
                keys.append(keys_of(h, buckets))
                held += h.size
                if held >= GATHER:
                    yield from send(np.concatenate(docs), np.concatenate(keys))
                    docs, keys, held = [], [], 0
        if held:
            yield from send(np.concatenate(docs), np.concatenate(keys))

    return run


def answer(table: pa.Table, most: int = HOT) -> pa.Table:
    """(doc_id, keys, n) of a bucket: the shared anchors of each document; without doc_id an anchor in over ``most`` texts."""
    kind = table.column("kind").to_numpy()
    out_doc: list = []
    out_keys: list[bytes] = []
    out_n: list[int] = []
    asked = table.filter(pa.array(kind == 0))
    if asked.num_rows:
        key = np.zeros((sum(len(k) for k in asked.column("key").to_pylist()) // 5, 8), np.uint8)
        key[:, :5] = _join(asked.column("key"), np.uint8).reshape(-1, 5)
        bucket = np.int64(asked.column("bucket")[0].as_py()) << np.int64(40)
        key = key.view("<i8").ravel() | bucket
        doc = np.concatenate([np.cumsum(np.frombuffer(d, "<i8")) for d in asked.column("doc").to_pylist()])
        count = _join(asked.column("n"), np.int32)
        order = np.argsort(key, kind="stable")
        key, doc, count = key[order], doc[order], count[order]
        at = _firsts(key)
        total = np.add.reduceat(count.astype(np.int64), at)
        spread = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        shared = np.repeat((total > 1) & (spread | (np.maximum.reduceat(count, at) > 1)), np.diff(np.append(at, key.size)))
        d, k = _per_doc(doc[shared], key[shared])
        out_doc, out_keys, out_n = d, k, [0] * len(d)
        for i in np.flatnonzero(total > most).tolist():
            out_doc.append(None)
            out_keys.append(key[at[i]].tobytes())
            out_n.append(int(total[i]))
    for row in table.filter(pa.array(kind == 1)).select(["doc", "key"]).to_pylist():
        out_doc.append(int(np.frombuffer(row["doc"], np.int64)[0]))
        out_keys.append(row["key"])
        out_n.append(0)
    return pa.table({"doc_id": pa.array(out_doc, pa.int64()), "keys": pa.array(out_keys, pa.binary()), "n": pa.array(out_n, pa.int64())})


SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("head", pa.binary()), ("bytes", pa.binary())])


def contexts(buckets: int, hot: np.ndarray):
    """Batches of (doc_id, text, keys) to rows for the context buckets.

    A head is (key, doc, start, length, anchor) in 64-bit integers; its bytes are
    laid out around the anchor, which begins at SIDE, with zeros outside. Kind 1 rows are removals that the batch itself could settle:
    a context that a smaller document of the batch has as well.
    """
    weights = mix64(np.arange(1, SPAN // 8 + 1, dtype=np.uint64)) | np.uint64(1)

    def folded(raw: np.ndarray) -> np.ndarray:
        return mix64((mix64(np.ascontiguousarray(raw).view(np.uint64)) * weights).sum(axis=1))

    def send(head: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        code = mix64(folded(raw) ^ mix64(head[:, 0].view(np.uint64) + head[:, 3].astype(np.uint64)))
        order = np.lexsort((head[:, 1], code))
        head, raw, code = head[order], raw[order], code[order]
        at = _firsts(code)
        rep = np.repeat(at, np.diff(np.append(at, code.size)))
        equal = (raw == raw[rep]).all(axis=1) & (head[:, 0] == head[rep, 0]) & (head[:, 3] == head[rep, 3])
        covered = equal & (head[:, 1] > head[rep, 1]) & (head[:, 4] == head[rep, 4])
        rows: list[tuple] = []
        gone = head[covered]
        if gone.size:
            ranges = np.stack([gone[:, 2], gone[:, 2] + gone[:, 3]], axis=1)
            for i, (d, r) in enumerate(zip(*_per_doc(gone[:, 1], ranges), strict=True)):
                rows.append((i % buckets, 1, np.int64(d).tobytes(), r))
        head, raw = head[~covered], raw[~covered]
        to = ((head[:, 0] >> 40) * FINER + head[:, 0] % FINER) % buckets
        by = np.lexsort((head[:, 1], to))
        head, raw, to = head[by], raw[by], to[by]
        cuts = _firsts(to)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), to.size], strict=True):
            rows.append((int(to[a]), 0, _packed(head[a:b].T), _packed(raw[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)

    def cut(data: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        where = place[:, None] + np.arange(-SIDE, SPAN - SIDE)
        raw = data[np.clip(where, 0, data.size - 1)]
        raw[(where < begin[:, None]) | (where >= end[:, None])] = 0
        return raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, raws = [], []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(2)
            for first, data, offsets in byte_chunks(batch.column(1)):
                place, h, text = anchors(data, offsets)
                key = keys_of(h, buckets // FINER)
                mine = [np.frombuffer(b"".join(x), np.int64) for x in wanted.slice(first, len(offsets) - 1).to_pylist()]
                bounds = np.searchsorted(text, np.arange(len(mine) + 1))
                keep = [np.isin(key[a:b], m) for a, b, m in zip(bounds[:-1].tolist(), bounds[1:].tolist(), mine, strict=True)]
                keep = np.concatenate(keep) if keep else np.zeros(0, bool)
                place, key, text = place[keep], key[keep], text[keep]
                begin = np.maximum(place - SIDE, offsets[text])
                end = np.minimum(place + LEAST, offsets[text + 1])
                is_hot = np.isin(key, hot) if hot.size else np.zeros(key.size, bool)
                if is_hot.any():  # each run by itself, dealt by its own bytes
                    runs = (end - begin - LEAST + 1)[is_hot]
                    starts = np.repeat(begin[is_hot], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                    starts, pick = np.unique(starts, return_index=True)
                    owner = np.repeat(text[is_hot], runs)[pick]
                    raw = cut(data, starts, starts, starts + LEAST)
                    own_key = (folded(raw) >> np.uint64(1)).view(np.int64)
                    heads.append(np.stack([own_key, ids[first + owner], starts - offsets[owner], np.full(starts.size, LEAST), np.zeros(starts.size, np.int64)], axis=1))
                    raws.append(raw)
                    place, key, text, begin, end = (x[~is_hot] for x in (place, key, text, begin, end))
                heads.append(np.stack([key, ids[first + text], begin - offsets[text], end - begin, place - begin], axis=1))
                raws.append(cut(data, place, begin, end))
                if sum(map(len, raws)) >= GATHER // 8:
                    yield from send(np.concatenate(heads), np.concatenate(raws))
                    heads, raws = [], []
        if raws and sum(map(len, raws)):
            yield from send(np.concatenate(heads), np.concatenate(raws))

    return run


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes up to the separator (0), equal ones by place.

    ``left`` counts the symbols before the separator. Ranks of 6 symbols are
    doubled until they cover the longest suffix.
    """
    n = text.size
    padded = np.concatenate([text, np.zeros(6, text.dtype)]).astype(np.int64)
    rank = np.zeros(n, np.int64)
    for k in range(6):
        rank = rank * 512 + np.where(left >= k, padded[k : k + n], 0)
    width, longest = 6, int(left.max()) + 1
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_rank = rank[order]
        if width >= longest:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_rank[1:] != sorted_rank[:-1]]))
        ahead = np.zeros(n, np.int64)
        ok = np.flatnonzero(left >= width)
        ahead[ok] = rank[ok + width]
        rank = rank * (n + 1) + ahead
        width *= 2


def shared_runs(text: np.ndarray, left: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, boundaries): between two boundaries suffixes share ``least`` symbols or more.

    Separators differ from each other. At level l the boundaries with a common
    prefix below l are known. A row j and the row before it with the same
    preceding symbol become neighbours one symbol further left; if a boundary
    lies between them, their common prefix has exactly one symbol more than the
    lowest such boundary, so it is found at this level.
    """
    order = suffix_order(text, left)
    before = np.where(order > 0, text[order - 1], 0)
    by_symbol = np.argsort(before, kind="stable")  # the row of a suffix extended to the left
    extended = np.empty(order.size, np.int64)
    extended[by_symbol] = np.arange(order.size)
    previous = np.empty(order.size, np.int64)
    previous[by_symbol] = np.concatenate([[0], by_symbol[:-1]])
    first = text[order]
    boundary = np.concatenate([[True], first[1:] != first[:-1]]) | (first == 0)
    open_rows = np.flatnonzero((before != 0) & ~boundary[extended])
    for _ in range(1, least):
        through = np.cumsum(boundary, dtype=np.int32)
        split = through[open_rows] > through[previous[open_rows]]
        if not split.any():
            break
        boundary[extended[open_rows[split]]] = True
        open_rows = open_rows[~split]
    return order, boundary


def settle(table: pa.Table) -> pa.Table:
    """(doc_id, ranges) of a context bucket: the byte ranges that a smaller document has too."""
    kind = table.column("kind").to_numpy()
    docs, ranges = [], []
    for row in table.filter(pa.array(kind == 1)).select(["head", "bytes"]).to_pylist():
        docs.append(int(np.frombuffer(row["head"], np.int64)[0]))
        ranges.append(row["bytes"])
    sent = table.filter(pa.array(kind == 0))
    if sent.num_rows:
        head = np.concatenate([h.reshape(5, -1).T for h in _unpacked(sent.column("head"), np.int64)])
        raw = np.concatenate([r.reshape(-1, SPAN) for r in _unpacked(sent.column("bytes"), np.uint8)])
        found = [x for x in _settled(head, raw) if x[0].size]
        if found:
            doc = np.concatenate([d for d, _ in found])
            spans = np.concatenate([s for _, s in found])
            d, r = _per_doc(doc, spans)
            docs += d
            ranges += r
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "ranges": pa.array(ranges, pa.binary())})


def _reach(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row of ``part`` with another row of its key; -1 without one."""
    words = np.zeros((len(part), 32), np.uint8)
    words[:, :SIDE] = part
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], key))
    equal = part[order[1:]] == part[order[:-1]]
    common = np.where(equal.all(axis=1), SIDE, equal.argmin(axis=1))
    common[key[order[1:]] != key[order[:-1]]] = -1
    out = np.empty(len(part), np.int64)
    out[order] = np.maximum(np.append(common, -1), np.append(-1, common))
    return out


def _settled(head: np.ndarray, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # what no other context of the anchor has, on either side, is in no shared run
    left = np.minimum(_reach(head[:, 0], raw[:, :SIDE][:, ::-1]), head[:, 4])
    right = np.minimum(_reach(head[:, 0], raw[:, SIDE + K :]), head[:, 3] - head[:, 4] - K)
    use = np.flatnonzero((left >= 0) & (left + K + right >= LEAST))
    head, raw, left, right = head[use], raw[use].copy(), left[use], right[use]
    if not use.size:
        return
    head = np.stack([head[:, 0], head[:, 1], head[:, 2] + head[:, 4] - left, left + K + right, left], axis=1)
    column = np.arange(SPAN)
    raw[(column < SIDE - left[:, None]) | (column >= SIDE + K + right[:, None])] = 0
    whole = np.concatenate([np.ascontiguousarray(head[:, [0, 3, 4]]).view(np.uint8).reshape(-1, 24), raw], axis=1)
    eights = whole.view(np.uint64)
    code = mix64((mix64(eights) * (mix64(np.arange(1, eights.shape[1] + 1, dtype=np.uint64)) | np.uint64(1))).sum(axis=1))
    _, one, inverse = np.unique(code, return_index=True, return_inverse=True)
    if (eights != eights[one[inverse]]).any():  # two strings with one hash
        _, inverse = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((head[:, 1], inverse))
    head, raw, inverse = head[order], raw[order], inverse[order]
    at = _firsts(inverse)
    size = np.diff(np.append(at, inverse.size))
    least_doc = head[at, 1]
    later = head[:, 1] > np.repeat(least_doc, size)
    gone = head[later]
    yield gone[:, 1], np.stack([gone[:, 2], gone[:, 2] + gone[:, 3]], axis=1)
    # one context for each distinct string; only anchors with several need comparing
    key = head[at, 0]
    by_key = np.argsort(key, kind="stable")
    run = _firsts(key[by_key])
    several = np.zeros(key.size, bool)
    several[by_key] = np.repeat(np.diff(np.append(run, key.size)) > 1, np.diff(np.append(run, key.size)))
    one = at[several]
    if not one.size:
        return
    length = head[one, 3]
    total = int((length + 1).sum())
    text, left = np.zeros(total, np.int16), np.zeros(total, np.int64)
    begin = np.cumsum(length + 1) - length - 1
    place = np.arange(total) - np.repeat(begin, length + 1)
    which = np.repeat(np.arange(one.size), length + 1)
    left[:] = length[which] - place
    inside = left > 0
    rows = one[which[inside]]
    text[inside] = raw[rows, SIDE - head[rows, 4] + place[inside]].astype(np.int16) + 1
    suffixes, boundary = shared_runs(text, left)
    group = np.cumsum(boundary) - 1
    doc = least_doc[several][which[suffixes]]
    smallest = np.minimum.reduceat(doc, np.flatnonzero(boundary))[group]
    hit = suffixes[(doc > smallest) & (left[suffixes] >= LEAST)]
    if not hit.size:
        return
    hit.sort()
    cut = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))  # a separator lies between contexts
    first, last = hit[cut], hit[np.append(cut[1:], hit.size) - 1]
    context = which[first]
    a, b = place[first], place[last] + LEAST
    # every occurrence of the context in its least document loses the same bytes
    copies = np.add.reduceat(~later, at)[several]
    source = at[several][context]
    n = copies[context]
    rows = np.repeat(source, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = np.repeat(a, n), np.repeat(b, n)
    yield head[rows, 1], np.stack([head[rows, 2] + a, head[rows, 2] + b], axis=1)


def _merged(blobs: list[bytes] | None, size: int) -> np.ndarray:
    if not blobs:
        return np.zeros((0, 2), np.int64)
    r = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
    r = np.minimum(r[np.argsort(r[:, 0], kind="stable")], size)
    reach = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([r[at, 0], reach[np.append(at[1:], len(r)) - 1]], axis=1)


def removals(docs: DataFrame, hot_above: int = HOT) -> DataFrame:
    """(doc_id, ranges): byte ranges to remove, as packed pairs, in several rows a document."""
    rows = texts(docs)
    named = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("name"), F.octet_length("text").alias("size")).where(f"size >= {LEAST}")
    first = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = materialize(named.join(first, "name").where("doc_id > first").select("doc_id").distinct())
    size = named.agg(F.sum("size")).first()[0] or 0
    buckets = min(1 << 22, max(LEAST_BUCKETS, size // BUCKET_BYTES))
    # copies needn't be asked for, but may: texts aren't shuffled for it when they are many
    few = copies.limit(FEW_COPIES + 1).count() <= FEW_COPIES
    own = rows.join(F.broadcast(copies), "doc_id", "left_anti") if few else rows
    asked = own.mapInArrow(ask(buckets), "bucket int, kind byte, doc binary, key binary, n binary")
    answers = asked.groupBy("bucket").applyInArrow(lambda t: answer(t, hot_above), "doc_id long, keys binary, n long")
    shared = stored(answers, "shared-anchors")
    hottest = shared.where("doc_id is null").orderBy(F.desc("n"), "keys").limit(HOT_LIST).select("keys").collect()
    hot = np.array([np.frombuffer(r[0], np.int64)[0] for r in hottest], np.int64)
    wanted = shared.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    sent = rows.join(wanted, "doc_id").select("doc_id", "text", "keys").mapInArrow(
        contexts(buckets * FINER, hot), "bucket int, kind byte, head binary, bytes binary"
    )
    found = sent.groupBy("bucket").applyInArrow(settle, "doc_id long, ranges binary")
    whole = F.lit(bytearray(np.array([0, 2**62], np.int64).tobytes()))
    return found.union(copies.select("doc_id", whole.alias("ranges")))


def deduplicate(docs: DataFrame, hot_above: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row.

    A byte goes if a run of LEAST bytes over it also starts in a document with
    a smaller doc_id; all is judged on the input. Null and short texts lose
    nothing. Equal doc_ids don't remove from each other, yet rows that share a
    doc_id count as one document: what goes in one goes in all at the same
    place. A null doc_id is the smallest. kept holds the remaining bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                rows = []
                for raw, blobs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    spans = _merged(blobs, len(raw)).tolist()
                    spans = [s for s in spans if s[1] > s[0]]
                    keep, at = [], 0
                    for a, b in spans:
                        keep.append(raw[at:a])
                        at = b
                    kept = b"".join([*keep, raw[at:]])
                    rows.append((len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
                n, gone, spans, kept, sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    ranges = removals(docs, hot_above).groupBy("doc_id").agg(F.collect_list("ranges").alias("ranges"))
    rows = texts(docs).join(ranges, "doc_id", "left").select("doc_id", F.col("text").cast("binary"), "ranges")
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumn("doc_id", null_back("doc_id"))
