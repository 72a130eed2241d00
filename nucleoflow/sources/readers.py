"""Readers for counts, labels, fragments, annotation and marker tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nucleoflow import schemas
from nucleoflow.container import Multiome
from nucleoflow.functions import strings as S
from nucleoflow.schemas import canonical_names, require_columns
from nucleoflow.session import materialize
from nucleoflow.sources import files


def read_multiome(spark: SparkSession, folder: str) -> Multiome:
    """A folder of Parquet tables: counts (partitioned by modality), cells, features."""
    return Multiome(
        spark.read.parquet(f"{folder}/counts"),
        spark.read.parquet(f"{folder}/cells"),
        spark.read.parquet(f"{folder}/features"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value) with line numbers from 1 for one text file read in splits.

    Lines are numbered inside their split; the counts of earlier splits, a few
    rows, give the offset.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m")
    )
    rows = materialize(rows)
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("block", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("m")
    return rows.join(offset, "block").select(
        (F.col("before") + F.row_number().over(inside)).alias("n"), "value"
    )


def read_matrix_market(spark: SparkSession, matrix: str, barcodes: str, features: str, modality: str) -> DataFrame:
    """Long counts from a coordinate matrix (feature, cell, value) and its name files."""
    f = numbered_lines(spark, features).select(F.col("n").alias("i"), F.split("value", "\t")[0].alias("feature_id"))
    b = numbered_lines(spark, barcodes).select(F.col("n").alias("j"), F.split("value", "\t")[0].alias("cell_id"))
    body = numbered_lines(spark, matrix).where(~F.col("value").startswith("%"))
    size_line = body.agg(F.min("n")).scalar()
    parts = F.split(F.trim("value"), r"\s+")
    t = body.where(F.col("n") > size_line).select(
        parts[0].cast("bigint").alias("i"), parts[1].cast("bigint").alias("j"), parts[2].cast("double").alias("value")
    )
    return t.join(f, "i").join(b, "j").select(F.lit(modality).alias("modality"), "cell_id", "feature_id", "value")


def read_any(spark: SparkSession, path: str):
    """Choose a reader by name; unknown kinds raise ``ValueError``."""
    suffix = Path(path).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return spark.read.option("header", True).csv(path)
    if suffix in (".tsv", ".txt"):
        return spark.read.option("header", True).option("sep", "\t").csv(path)
    if suffix == "" and files.is_folder(spark, path):
        return read_multiome(spark, path)
    raise ValueError(f"unsupported input {path!r}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cell_name, cluster) from a file with or without a header.

    Columns ``final_label`` or ``cluster`` are recognised; a file without either
    is taken to have no header and two columns.
    """
    df = spark.read.option("header", True).csv(path)
    df = canonical_names(df, {"final_label": "cluster", "cell": "cell_name", "barcode": "cell_name"})
    if {"cell_name", "cluster"} <= set(df.columns):
        return df.select(F.trim("cell_name").alias("cell_name"), F.trim("cluster").alias("cluster"))
    return spark.read.schema("cell_name STRING, cluster STRING").csv(path).select(
        F.trim("cell_name").alias("cell_name"), F.trim("cluster").alias("cluster")
    )


# Names under which the id column of a metadata file may stand.
ID_COLUMNS = ["cell_id", "cell_name", "barcode", "Unnamed: 0"]


def read_cell_metadata(spark: SparkSession, path: str, label: str = "celltype") -> DataFrame:
    """(barcode, label): trimmed, first row per barcode, empty label -> Unknown.

    The id is the first known id column, else the first column. A file is read in
    line order; its splits keep that order in the row number.
    """
    df = spark.read.option("header", True).csv(path)
    require_columns(df, label, what=path)
    key = next((c for c in ID_COLUMNS if c in df.columns), df.columns[0])
    rows = df.select(F.col(f"`{key}`").alias("barcode"), label, file_order().alias("_o"))
    from nucleoflow.operators.annotate import clean_labels

    return clean_labels(rows, "barcode", label, "_o")


def file_order() -> Column:
    """Place of a row in its files: name, then offset of the split, then place in the split."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), inside.alias("row"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragment rows with a barcode; ``#`` lines are skipped.

    A gzip file is one split, so compress large inputs in blocks or unpack them.
    """
    df = spark.read.schema(schemas.FRAGMENTS).option("sep", "\t").option("comment", "#").csv(path)
    return df.where(F.col("barcode").isNotNull())


def read_gene_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Gene table with one row per symbol, the first in file order."""
    df = spark.read.parquet(path)
    require_columns(df, "symbol", "chr", "start", "end", "strand", what=path)
    rest = [c for c in df.columns if c != "symbol"]
    ranked = df.withColumn("_o", file_order())
    first = ranked.groupBy("symbol").agg(F.min_by(F.struct(*rest), "_o").alias("r"))
    return first.select("symbol", "r.*")


KNOWLEDGE_BASE = (
    "tissue STRING, gene_index MAP<STRING, ARRAY<STRING>>, "
    "cell_metadata MAP<STRING, STRUCT<total_markers: INT, cancer_type: STRING>>"
)


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Marker rows from JSON lines, one tissue per line."""
    from nucleoflow.operators.annotate import explode_knowledge_base

    return explode_knowledge_base(spark.read.schema(KNOWLEDGE_BASE).json(path))


def read_keyed_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Marker rows from files that hold one object each, with a member for every tissue."""
    from nucleoflow.operators.annotate import explode_knowledge_base

    entry = KNOWLEDGE_BASE.split(", ", 1)[1]
    whole = spark.read.text(path, wholetext=True)
    by_tissue = F.from_json("value", f"MAP<STRING, STRUCT<{entry.replace('gene_index', 'gene_index:').replace('cell_metadata', 'cell_metadata:')}>>")
    rows = whole.select(F.explode(by_tissue).alias("tissue", "entry"))
    return explode_knowledge_base(rows.select("tissue", "entry.gene_index", "entry.cell_metadata"))


def read_grn(spark: SparkSession, path: str) -> DataFrame:
    """Network table with normalised factor names; support may be missing."""
    df = canonical_names(spark.read.option("header", True).csv(path), schemas.GRN_ALIASES)
    require_columns(df, "tf", "gene", "correlation", what=path)
    if "n_peaks" not in df.columns:
        df = df.withColumn("n_peaks", F.lit(None).cast("double"))
    return df.withColumns(
        {
            "tf": S.factor_name(F.col("tf")),
            "correlation": F.col("correlation").try_cast("double"),
            "n_peaks": F.col("n_peaks").try_cast("double"),
        }
    )


def read_parameters(path: str, required: tuple[str, ...] = ()) -> dict:
    """JSON parameters or manifest; missing keys raise ``ValueError``."""
    data = json.loads(files.read_text(SparkSession.active(), path))
    missing = sorted(set(required) - set(data))
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return data


def newest(folder: str, pattern: str) -> str:
    """Most recently changed match."""
    return files.newest(SparkSession.active(), folder, pattern)
