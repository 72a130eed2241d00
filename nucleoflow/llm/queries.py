"""The registered queries: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nucleoflow.llm import (
    alignment,
    lines,
    minhash,
    mixing,
    nearest,
    pieces,
    privacy,
    quality,
    ranking,
    sketches,
    suffixes,
    token_file,
    twins,
    warc,
)
from nucleoflow.llm.common import modest_batches
from nucleoflow.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, folder, "documents")).drop("kept")


@query("op2_near_duplicates", twins.OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op3_fingerprints")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.compared(table(spark, folder, "documents"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"), pieces.read_model(vocabulary(PIECES)))


@query("op5_mix_sources", mixing.OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = token_file.stored(table(spark, folder, "documents"), vocabulary(TOKENIZER))
    return token_file.read_digests(spark, path)


@query("op7_fuzzy_lines")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


@query("op8_quality_rules", twins.OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.assess(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_warc")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    where = warc.archived(table(spark, folder, "pages"))
    return warc.read_records(warc.read_index(spark, where), where).drop("payload", "url")


@query("op10_personal_data")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.report(table(spark, folder, "documents"))


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.neighbours(table(spark, folder, "embeddings"))


@query("op12_ranked_search", ranking.OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.compared(table(spark, folder, "documents"), vocabulary(BYTES), vocabulary(PIECES))
