"""Tables behind the figures; drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nucleoflow.functions import ordering as O
from nucleoflow.functions import vectors as V


def clip_colour(df: DataFrame, value: str, out: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip to two whole-column quantiles."""
    cut = O.exact_quantiles(df, value, {"lo": lo, "hi": hi})
    bounds = cut.select(F.struct("lo", "hi").alias("s")).scalar()
    return df.withColumn(out, F.least(bounds["hi"], F.greatest(bounds["lo"], F.col(value))))


def arrow_path(cells: DataFrame, window: int = 5) -> DataFrame:
    """Mean position per slot of 1.01 time units, smoothed: at most 100 rows."""
    slots = cells.where(F.col("trajectory").isNotNull()).groupBy(
        F.floor(F.col("trajectory") / 1.01).alias("slot")
    ).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    half = window // 2
    around = Window.orderBy("slot").rowsBetween(-half, half)
    return slots.select("slot", F.avg("x").over(around).alias("x"), F.avg("y").over(around).alias("y"))


def heatmap_matrix(profile: DataFrame, limit: float = 2.0) -> DataFrame:
    """Rows scaled by population deviation and clipped, with their peak bin for ordering."""
    peaks = F.array_position("vec", F.array_max("vec")).cast("int")
    return profile.withColumn("peak_bin", peaks).withColumn(
        "vec", V.standardized(F.col("vec"), limit, ddof=0)
    )


def paired_heatmap(links: DataFrame, peaks: DataFrame, genes: DataFrame, limit: float = 2.0) -> DataFrame:
    """Both panels of linked peaks and genes, ordered by the peak's highest bin.

    One row per link, so a peak linked to two genes appears twice in both panels.
    """
    p = heatmap_matrix(peaks, limit).select(
        F.col("feature_id").alias("peak"), F.col("vec").alias("peak_row"), "peak_bin"
    )
    g = heatmap_matrix(genes, limit).select(F.col("feature_id").alias("gene"), F.col("vec").alias("gene_row"))
    return links.select("peak", "gene").join(p, "peak").join(g, "gene")


def correlation_matrix(cor: DataFrame, tfs: list) -> DataFrame:
    """Gene rows, factor columns; missing correlations are 0."""
    return cor.groupBy("gene").pivot("tf", tfs).agg(F.first("correlation")).na.fill(0.0)


def circular_layout(nodes: DataFrame, key: str = "node", radius: float = 1.0) -> DataFrame:
    """Evenly spaced positions on a circle in key order."""
    placed = O.dense_order(nodes.withColumn("_z", F.lit(0.0)), "_z", key, "_k").drop("_z")
    n = nodes.agg(F.count(F.lit(1))).scalar()
    angle = 2 * math.pi * (F.col("_k") - 1) / n
    return placed.withColumn("x", radius * F.cos(angle)).withColumn("y", radius * F.sin(angle)).drop("_k")


def bipartite_layout(edges: DataFrame) -> DataFrame:
    """Factors on the left line and targets on the right, evenly spaced in [-1, 1]."""

    def line(col: str, x: float) -> DataFrame:
        nodes = edges.select(F.col(col).alias("node")).distinct()
        placed = O.dense_order(nodes.withColumn("_z", F.lit(0.0)), "_z", "node", "_k").drop("_z")
        n = nodes.agg(F.count(F.lit(1))).scalar()
        y = F.coalesce(-1 + 2 * (F.col("_k") - 1) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
        return placed.select("node", F.lit(col).alias("side"), F.lit(x).alias("x"), y.alias("y"))

    return line("tf", -1.0).unionByName(line("gene", 1.0))


def joint_coordinates(embedding: DataFrame, labels: DataFrame, key: str = "cell_id") -> DataFrame:
    """First two joint dimensions beside the cell type."""
    return embedding.select(
        key, F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")
    ).join(labels, key, "left")
