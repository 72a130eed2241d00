"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoflow.session import ensure_checkpoint_dir, tidy_shuffles

#: A null id is carried as this value inside the operators and given back as null.
NULL_ID = -(2**63)
WORD = r"[^\x20\x09-\x0D]+"


def long_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def null_back(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, more): null ids become NULL_ID, null texts become empty; other columns go."""
    return docs.select(
        long_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more
    )


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a grouped table that may be broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of groups, marked for broadcast only if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to a table in the shared folder; compressed, unlike a checkpoint, so fit for texts."""
    path = shared_folder(df.sparkSession, what)
    with tidy_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of an Arrow batch; whole documents travel in them.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, so that workers hold few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
