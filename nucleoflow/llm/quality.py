"""Quality rules with thresholds that each language and source sets itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from nucleoflow.llm.common import fresh, small
from nucleoflow.session import materialize

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: Ratio of neighbouring sketch buckets: quantiles are right within one percent.
GAMMA = 1.02
#: A group with fewer documents takes the quantiles of its language's merged sketch.
MIN_GROUP = 200
#: measure: (numerator, denominator, least distance kept free above the upper
#: quartile in thousandths, whether low values fail as well)
MEASURES = {
    "word_length": ("word_chars", "n_words", 3000, True),
    "symbols": ("n_symbols", "n_words", 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 500, False),
    "repeats": ("n_repeat_words", "n_words", 300, False),
}
FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    code = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    ordered = np.sort(code)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not twice.size:
        return 0
    starts = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, code), twice.size - 1)] == code)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def text_signals(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    return (
        len(words),
        chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@pandas_udf(StructType([StructField(n, LongType()) for n in FIELDS]))
def signals(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_signals(t) for t in text], columns=list(FIELDS), dtype="int64")


def base_failed(s: Column) -> Column:
    return (s.n_words < 20) | (100 * s.n_repeat_words > 30 * s.n_words)


def measure(s: Column, name: str) -> Column:
    top, bottom, _, _ = MEASURES[name]
    return F.when(s[bottom] > 0, F.floor(1000 * s[top] / s[bottom])).otherwise(F.lit(0)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) from rows with lang, source and signals s.

    A bucket holds values within two percent of each other. Sketches of parts
    merge by adding counts, so the result doesn't depend on the partitioning.
    """
    long = rows.select(
        "lang",
        "source",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), measure(F.col("s"), m).alias("value")) for m in MEASURES])
        ).alias("m"),
    )
    bucket = F.ceil(F.log(F.col("m.value") + 1.0) / float(np.log(GAMMA)) - 1e-9).cast("int")
    return long.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(
        F.count("*").alias("n")
    )


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    ordered = Window.partitionBy(*keys, "measure").orderBy("bucket")
    everything = Window.partitionBy(*keys, "measure")
    rows = sketch.withColumn("through", F.sum("n").over(ordered)).withColumn("total", F.sum("n").over(everything))
    value = F.pow(F.lit(GAMMA), F.col("bucket")) - 1
    at = lambda q: F.min(F.when(F.col("through") >= q * F.col("total"), value))
    return rows.groupBy(*keys, "measure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("total"))


def thresholds(rows: DataFrame, spread: float = 4.0) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) for each language and source.

    The limits lie ``spread`` times the middle half's width beyond the
    quartiles, and never closer than the measure's own least distance.
    """
    fine = materialize(sketches(rows))
    per_lang = quartiles(fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), "lang").alias("l")
    own = quartiles(fine, "lang", "source").alias("o")
    both = own.join(per_lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
    pick = lambda c: F.when(F.col("o.total") >= MIN_GROUP, F.col(f"o.{c}")).otherwise(F.col(f"l.{c}"))
    chosen = both.select("o.lang", "o.source", "o.measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for m, (_, _, least, two_sided) in MEASURES.items():
        width = F.greatest(spread * (F.col("q3") - F.col("q1")), F.lit(float(least)))
        here = F.col("measure") == m
        out.append(F.max(F.when(here, F.col("q3") + width)).alias(f"{m}_high"))
        if two_sided:
            out.append(F.max(F.when(here, F.col("q1") - F.least(width, F.col("q1") / 2))).alias(f"{m}_low"))
    return materialize(chosen.groupBy("lang", "source").agg(*out))


def verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with the limits of their group joined as struct ``limit`` and boolean ``ok``."""
    limits = small(
        limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*limits.columns[2:]).alias("limit"))
    )
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")
    ok = ~base_failed(F.col("s"))
    for m, (_, _, _, two_sided) in MEASURES.items():
        ok = ok & (measure(F.col("s"), m) <= F.col(f"limit.{m}_high"))
        if two_sided:
            ok = ok & (measure(F.col("s"), m) >= F.col(f"limit.{m}_low"))
    return joined.withColumn("ok", ok)


def assess(docs: DataFrame) -> DataFrame:
    """Per document the signals, base_failed and kept.

    A null text counts as empty, has no words and fails. Null languages and
    sources form groups of their own. Repeated rows are judged each; an empty
    table gives no rows.
    """
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"),
            signals(F.col("text").cast("string")).alias("s"),
        )
    )
    return verdict(rows, thresholds(rows)).select(
        "doc_id", "s.*", base_failed(F.col("s")).alias("base_failed"), F.col("ok").alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``.

    The signals are computed again in the second pass, so texts aren't shuffled.
    """
    sig = signals(F.col("text").cast("string"))
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    limits = thresholds(docs.select(lang.alias("lang"), source.alias("source"), sig.alias("s")))
    row = fresh(docs, "_row")
    packed = docs.select(F.struct("*").alias(row), lang.alias("lang"), source.alias("source"), sig.alias("s"))
    return verdict(packed, limits).where("ok").select(f"{row}.*")
