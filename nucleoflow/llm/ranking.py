"""Ranked lexical search: item weights times document impacts, tile by tile, as dense float64 products.

Every item asks for its best documents among all of them. A first pass turns
each text into the counts of the terms that any item uses; a second pass takes
documents a tile at a time and multiplies the items' weights, over the terms
that the tile holds, with the tile's impacts. Weights and impacts are whole
numbers and a product runs over at most VOCABULARY_TILE terms, so that each sum
stays below 2^53 and float64 is exact; sums of tiles are 64-bit integers.

Null texts and texts without a term match nothing and count nowhere. Rows count
as they are: a repeated document stands twice in the ranking, a repeated item is
asked twice. Null ids sort first and are given back as null. Without documents
or items there are no rows. A very long text is counted a chunk of bytes at a
time within one task and becomes one row of its distinct item terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nucleoflow.llm.common import null_back, stored, texts
from nucleoflow.llm.hashing import byte_chunks, word_hashes
from nucleoflow.session import materialize

#: Documents kept for an item.
BEST = 10
#: Item terms that are sent to the tasks at once (8 bytes each); more items take another pass.
PASS_TERMS = 1 << 20
#: Documents, items and terms of a dense tile: at most 4 MB each.
DOCUMENT_TILE = 256
ITEM_TILE = 256
VOCABULARY_TILE = 1024
#: Parts in which the best of all tasks are merged before the last step.
MERGES = 64

#: Bytes outside terms: ASCII other than digits and letters.
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:128] = [not chr(b).isalnum() for b in range(128)]

# Weights stay under 2^16 for fewer than e^65 documents and impacts under 2^20.
assert VOCABULARY_TILE << 36 <= 1 << 53


def term_sets(items: DataFrame) -> DataFrame:
    """(item_id, terms): the hashes of the distinct terms of each item that has any, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in byte_chunks(batch.column(1)):
                terms, at = word_hashes(data, offsets, _OUTSIDE)
                sets = [np.unique(terms[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                ids = batch.column(0).slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "terms"])

    asked = texts(items, id_col="item_id").withColumnRenamed("doc_id", "item_id")
    return asked.mapInArrow(run, "item_id long, terms array<long>").where("size(terms) > 0")


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, term, tf) of the documents with a term: all terms with repeats, and which of ``vocabulary`` how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for first, data, offsets in byte_chunks(batch.column(1)):
                terms, at = word_hashes(data, offsets, _OUTSIDE)
                n = np.diff(at)
                place = np.minimum(np.searchsorted(wanted, terms), wanted.size - 1)
                hit = np.flatnonzero(wanted[place] == terms)
                code = np.sort(np.repeat(np.arange(n.size), n)[hit] * wanted.size + place[hit])
                new = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: code.size])
                tf = np.diff(np.append(new, code.size))
                row, term = np.divmod(code[new], wanted.size)
                full = np.flatnonzero(n)
                ends = np.append(0, np.searchsorted(row, full, "right"))
                ids = batch.column(0).slice(first, n.size).take(pa.array(full))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[full], pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def document_frequencies(counted: DataFrame, size: int) -> DataFrame:
    """(term, df) over the rows of ``term_counts``; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(df[found])], names=["term", "df"])

    return counted.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Scorer:
    """The best documents of each item so far; ``add`` takes a batch of documents."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, documents: int, words: int, best: int):
        self.first, self.term, self.weight = first, term, weight
        self.documents, self.words, self.best = documents, words, best
        self.place = np.full(size, -1, np.int32)
        self.item = np.zeros(0, np.int64)
        self.doc, self.score = self.item, self.item
        self.least = np.ones(first.size - 1, np.int64)

    def add(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        row = np.repeat(np.arange(ids.size), np.diff(at))
        length = 10 + (90 * n * self.documents) // self.words
        tf = tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * length[row])
        for a in range(0, ids.size, DOCUMENT_TILE):
            b = min(a + DOCUMENT_TILE, ids.size)
            cut = slice(at[a], at[b])
            held, column = np.unique(term[cut], return_inverse=True)
            if not held.size:
                continue
            dense = np.zeros((held.size, b - a))
            dense[column, row[cut] - a] = impact[cut]
            self.place[held] = np.arange(held.size, dtype=np.int32)
            for i in range(0, self.first.size - 1, ITEM_TILE):
                self._tile(i, min(i + ITEM_TILE, self.first.size - 1), dense, ids[a:b])
            self.place[held] = -1

    def _tile(self, i: int, j: int, dense: np.ndarray, ids: np.ndarray) -> None:
        cut = slice(self.first[i], self.first[j])
        place = self.place[self.term[cut]]
        used = place >= 0
        item = np.repeat(np.arange(j - i), np.diff(self.first[i : j + 1]))[used]
        place, weight = place[used], self.weight[cut][used]
        total = np.zeros((j - i, ids.size), np.int64)
        for t in range(0, dense.shape[0], VOCABULARY_TILE):
            part = (place >= t) & (place < t + VOCABULARY_TILE)
            weights = np.zeros((j - i, min(VOCABULARY_TILE, dense.shape[0] - t)))
            weights[item[part], place[part] - t] = weight[part]
            total += (weights @ dense[t : t + VOCABULARY_TILE]).astype(np.int64)
        # equal scores pass too: the smaller id decides among them
        x, y = np.nonzero(total >= self.least[i:j, None])
        if x.size:
            self._merge(i + x, ids[y], total[x, y])

    def _merge(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = np.append(self.item, item), np.append(self.doc, doc), np.append(self.score, score)
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(item.size) - np.searchsorted(item, item)
        last = rank == self.best - 1
        self.least[item[last]] = score[last]
        kept = rank < self.best
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]


def _one_pass(asked: DataFrame, docs: DataFrame, best: int) -> DataFrame:
    """(item_id, asked, doc_id, score): each task's best documents of the items ``asked``."""
    rows = asked.toArrow()
    ids, sets = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
    first = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)
    flat = (sets.flatten().to_numpy() if first[-1] else np.zeros(0, np.int64)).view(np.uint64)
    vocabulary, term = np.unique(flat, return_inverse=True)
    spark = docs.sparkSession
    schema = "item_id long, asked int, doc_id long, score long"
    if not vocabulary.size:
        return spark.createDataFrame([], schema)
    counted = stored(term_counts(docs, vocabulary), "term-counts")
    documents, words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = document_frequencies(counted, vocabulary.size).toArrow()
    df = np.zeros(vocabulary.size, np.int64)
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], float)
    shared = spark.sparkContext.broadcast((ids.to_numpy(), first, term, weight[term]))
    size = vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, term, weight = shared.value
        scorer = Scorer(first, term, weight, size, documents, words, best)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = (lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy())
            scorer.add(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), at, *flat)
        columns = (names[scorer.item], scorer.item.astype(np.int32), scorer.doc, scorer.score)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["item_id", "asked", "doc_id", "score"])

    return counted.mapInArrow(run, schema)


def ranked(items: DataFrame, docs: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents with the highest scores above 0 for each row of ``items``.

    A pass over the documents serves PASS_TERMS item terms or so; the number of
    passes grows with the items only. An item's own terms fit a task.
    """
    asked = materialize(term_sets(items))
    passes = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / PASS_TERMS))
    dealt = asked.withColumn("pass", F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)))
    found = None
    for p in range(passes):
        part = _one_pass(dealt.where(F.col("pass") == p).select("item_id", "terms"), docs, best).withColumn("pass", F.lit(p))
        found = part if found is None else found.union(part)
    order = (F.desc("score"), F.asc("doc_id"))
    part = Window.partitionBy("pass", "asked", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))).orderBy(*order)
    merged = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= best)
    whole = Window.partitionBy("pass", "asked").orderBy(*order)
    merged = merged.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= best)
    return merged.select(null_back("item_id").alias("item_id"), "rank", null_back("doc_id").alias("doc_id"), "score")


OP12_SQL = r"""
with words as (
  select doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) as term from documents)),
counts as (select doc_id, term, count(*) as tf from words group by all),
lengths as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as all_n from lengths),
wanted as (
  select distinct item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select item_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) as term from benchmark)),
weights as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from counts, totals group by term, docs),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_n))))::bigint as score
  from wanted join counts using (term) join weights using (term) join lengths using (doc_id), totals
  group by item_id, doc_id),
placed as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
  from scored where score > 0)
select * from placed where rank <= 10
"""
