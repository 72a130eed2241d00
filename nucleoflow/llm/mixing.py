"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoflow.functions.ordering import numbered
from nucleoflow.llm.common import WORD, fresh, small
from nucleoflow.session import materialize

WEIGHTS = (5, 2, 1)
HASH_BITS = 60
LEVEL_BITS = 12


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column, seed: str) -> Column:
    """60 bits of an MD5, the same in every engine and every run."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. A target stops at ``cap`` times its source's size;
    the excess is shared again by weight until no target is above. As the
    common factor only rises, a source is full once cap * size / weight is
    below it, so one number describes each round.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = (F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(per, *order, name="place")
    placed = materialize(
        placed.select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
            (F.lit(cap) * F.col("source_size")).alias("limit"),
        )
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    factor, full = 0.0, -1
    while True:
        is_full = (F.col("limit") < F.col("weight") * F.lit(factor)) if full >= 0 else F.lit(False)
        held, free, count = placed.agg(
            F.coalesce(F.sum(F.when(is_full, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(is_full.cast("long")), F.lit(0)),
        ).first()
        if count == full or not free:
            break
        full, factor = count, (share * total - held) / free
    target = F.least("limit", F.col("weight") * F.lit(factor))
    return materialize(placed.select("source", "source_size", target.alias("target")))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, rounds, edge, with_edge): whole repeats, then the documents
    whose hash lies below ``edge``, and those at ``edge`` if that comes nearer.

    Level by level the words of each source are summed by hash bucket; only the
    bucket in which the budget ends is summed more finely in the next level.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = materialize(
        targets.select(
            "source",
            rounds.cast("long").alias("rounds"),
            (F.col("target") - rounds * F.col("source_size")).alias("left"),
            F.lit(0).cast("long").alias("prefix"),
        )
    )
    by_source = Window.partitionBy("source").orderBy("bucket")
    level = 0
    while level < HASH_BITS // LEVEL_BITS:
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        rows = sized.where("size > 0").withColumn("bucket", F.shiftright("hash", shift))
        same = rows["source"].eqNullSafe(state["source"])
        inside = rows.join(
            small(state), same & (F.shiftright(rows["bucket"], LEVEL_BITS) == state["prefix"])
        ).select(rows["source"], "bucket", "size", "rounds", "left")
        sums = inside.groupBy("source", "bucket", "rounds", "left").agg(F.sum("size").alias("words"))
        running = sums.withColumn("through", F.sum("words").over(by_source))
        crossing = running.where("through > left")
        first = crossing.groupBy("source").agg(F.min_by(F.struct("bucket", "through", "words", "rounds", "left"), "bucket").alias("b"))
        state = materialize(
            first.select(
                "source",
                "b.rounds",
                (F.col("b.left") - F.col("b.through") + F.col("b.words")).alias("left"),
                F.col("b.bucket").alias("prefix"),
                F.col("b.words").alias("words"),
            )
        )
        level += 1
    return state.select("source", "rounds", F.col("prefix").alias("edge"), (F.col("words") - F.col("left") < F.col("left")).alias("with_edge"))


def mixed(docs: DataFrame, seed: str = "mix:", share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Every document with size, source_size, target and taken words.

    Null texts and texts without words have size 0 and nothing is taken of
    them. A null source is a source of its own, the last. Rows that share a
    doc_id share a hash and are taken together. An empty table gives no rows.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            words_in(F.col("text").cast("string")).alias("size"),
        ).withColumn("hash", hash60(F.col("doc_id"), seed))
    )
    return _taken(sized, share, cap, weights)


def _taken(sized: DataFrame, share: float, cap: float, weights: tuple) -> DataFrame:
    targets = source_targets(sized, share, cap, weights)
    edges = thresholds(sized, targets)
    plan = targets.alias("t").join(edges.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select(
        F.col("t.source").alias("of"),
        "source_size",
        "target",
        F.coalesce("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))), F.lit(0)).cast("long").alias("rounds"),
        "edge",
        "with_edge",
    )
    more = (F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("with_edge"))
    times = F.col("rounds") + F.coalesce(more, F.lit(False)).cast("long")
    plan = small(materialize(plan))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "hash", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times")
    )


def mix(docs: DataFrame, seed: str = "mix:", share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it.

    Documents without words are in no mix. The columns are those of ``docs``.
    """
    size, digest = fresh(docs, "_size"), fresh(docs, "_hash")
    rows = docs.withColumn(size, words_in(F.col("text").cast("string"))).withColumn(
        digest, hash60(F.col("doc_id").cast("long"), seed)
    )
    sized = materialize(
        rows.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.col(size).alias("size"),
            F.col(digest).alias("hash"),
        )
    )
    plan = (
        _taken(sized, share, cap, weights)
        .where("size > 0")
        .groupBy("source", "hash")
        .agg(F.max("times").alias("times"))
        .where("times > 0")
        .select(F.col("hash").alias("_of_hash"), F.col("source").alias("_of_source"), F.col("times").alias("_times"))
    )
    joined = rows.where(F.col(size) > 0).join(
        plan, (F.col(digest) == F.col("_of_hash")) & F.col("source").cast("string").eqNullSafe(F.col("_of_source"))
    )
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
-- the factor f solves sum(least(2 * size, f * weight)) = 1.5 * sum(size)
walk AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         sum(source_size) OVER () AS total
  FROM per),
factor AS (SELECT min_by((1.5::DOUBLE * total - held) / free, ratio) AS f FROM walk WHERE (1.5::DOUBLE * total - held) / free <= ratio),
target AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * f) AS target FROM per, factor),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS budget
  FROM target),
sums AS (SELECT source, hash, sum(size) AS words FROM sized WHERE size > 0 GROUP BY ALL),
running AS (SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS through FROM sums),
edge AS (
  SELECT r.source, min(r.hash) AS edge, min_by(r.through - b.budget < b.budget - (r.through - r.words), r.hash) AS with_edge
  FROM running r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source WHERE r.through > b.budget GROUP BY r.source)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.rounds + coalesce(s.hash < e.edge OR (s.hash = e.edge AND e.with_edge), false)::INT))::BIGINT AS taken
FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source
"""
