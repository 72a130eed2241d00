"""Writers. Large tables go out partitioned; only small reports become one file."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoflow.container import Multiome
from nucleoflow.sources import files


def write_multiome(data: Multiome, folder: str) -> None:
    data.counts.write.mode("overwrite").partitionBy("modality").parquet(f"{folder}/counts")
    data.cells.write.mode("overwrite").parquet(f"{folder}/cells")
    data.features.write.mode("overwrite").parquet(f"{folder}/features")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``single`` is for result tables known to be small (rankings, summaries)."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_consensus(pairs: DataFrame, path: str) -> None:
    """Upper triangle, clustered by row so that one cell's pairs sit together."""
    pairs.where("i < j").repartitionByRange("i", "j").write.mode("overwrite").parquet(path)


def path_exists(spark, path: str) -> bool:
    """Whether a path exists in whatever file system its scheme names."""
    return files.exists(spark, path)


def append_iteration(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").partitionBy("iter").parquet(path)


def unfinished(iterations: DataFrame, path: str) -> DataFrame:
    """Iterations without stored labels."""
    if not path_exists(iterations.sparkSession, path):
        return iterations
    done = iterations.sparkSession.read.parquet(path).select("iter").distinct()
    return iterations.join(done, "iter", "left_anti")


def safe_name(text: str) -> str:
    """Letters, digits, dot, dash and underscore; other runs become one underscore."""
    return re.sub(r"[^0-9A-Za-z._-]+", "_", str(text)).strip("_") or "unnamed"


def write_bundle(tables: dict[str, DataFrame], folder: str, info: dict | None = None) -> dict:
    """Write each table and a manifest with row counts and paths."""
    manifest = {"paths": {}, "rows": {}, **(info or {})}
    for name, df in tables.items():
        path = f"{folder}/{safe_name(name)}"
        df.write.mode("overwrite").parquet(path)
        manifest["paths"][name] = path
        manifest["rows"][name] = df.sparkSession.read.parquet(path).count()
    files.write_text(SparkSession.active(), f"{folder}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def summary_text(title: str, row: DataFrame) -> str:
    """Markdown report of a one-row summary."""
    values = row.first().asDict()
    return "\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in values.items()], ""])


def driver_summary(ranking: DataFrame) -> DataFrame:
    """Counts per class in one row."""
    return ranking.agg(
        F.count(F.lit(1)).alias("n_tfs"),
        F.count_if("is_high_confidence_driver").alias("n_high_confidence"),
        F.count_if(F.col("driver_class") == "hub_like_network_driven").alias("n_hub_like"),
    )
