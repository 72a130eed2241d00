"""Rank-sum marker test of every cluster against the rest."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nucleoflow.functions import ordering as O
from nucleoflow.functions import tails
from nucleoflow.session import materialize


def keep_large_clusters(cells: DataFrame, label: str, min_cells: int = 10) -> DataFrame:
    """Drop noise (-1, NULL) and clusters with fewer than ``min_cells`` cells."""
    valid = cells.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "-1"))
    big = valid.groupBy(label).count().where(F.col("count") >= min_cells)
    return valid.join(big.select(label), label, "left_semi")


def rank_sum(values: DataFrame, cells: DataFrame, value: str = "norm") -> DataFrame:
    """Two-sided Mann-Whitney U per (feature, cluster) with tie and continuity terms.

    ``values``: cell_id, feature_id, positive entries only; ``cells``: cell_id,
    cluster. Zeros are one tied block below every stored entry and are handled in
    closed form. A feature is ranked by distinct value, in ordered buckets, so a
    feature seen in most cells is spread over many tasks.
    """
    labelled = values.join(cells.select("cell_id", "cluster"), "cell_id")
    hist = materialize(
        labelled.groupBy("feature_id", "cluster", F.col(value).cast("double").alias("v")).agg(
            F.count(F.lit(1)).alias("c")
        )
    )
    levels = O.levels_from_histogram(
        hist.groupBy("feature_id", "v").agg(F.sum("c").alias("ties")), "v", ["feature_id"]
    )
    levels = materialize(levels.drop("_b"))
    sizes_df = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes_df.agg(F.collect_list(F.struct("cluster", "n"))).scalar()
    n_all = cells.agg(F.count(F.lit(1)).cast("double")).scalar()

    stored = (
        hist.join(levels.select("feature_id", "v", "ties", "below"), ["feature_id", "v"])
        .groupBy("feature_id", "cluster")
        .agg(
            F.sum(F.col("c") * O.average_rank()).alias("rank_part"),
            F.sum("c").alias("nnz"),
            F.sum(F.col("c") * F.col("v")).alias("total_in"),
        )
    )
    t = F.col("ties").cast("double")
    per_gene = (
        levels.groupBy("feature_id")
        .agg(
            F.sum(t).alias("nnz_all"),
            F.sum(t * t * t - t).alias("tie_part"),
            F.sum(t * F.col("v")).alias("total_all"),
        )
        .withColumn("n_all", n_all)
        .withColumn("zeros", F.col("n_all") - F.col("nnz_all"))
        .withColumn("cl", F.explode(sizes))
        .select("*", F.col("cl.cluster").alias("cluster"), F.col("cl.n").cast("double").alias("n1"))
        .drop("cl")
    )
    g = per_gene.join(stored, ["feature_id", "cluster"], "left").fillna(
        0, ["rank_part", "nnz", "total_in"]
    )
    n1, n0 = F.col("n1"), F.col("zeros")
    n2 = F.col("n_all") - n1
    rank_total = F.col("rank_part") + F.col("nnz") * n0 + (n1 - F.col("nnz")) * (n0 + 1) / 2
    u = rank_total - n1 * (n1 + 1) / 2
    ties = F.col("tie_part") + n0 * n0 * n0 - n0
    n = F.col("n_all")
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(ties, n * (n - 1)))
    g = g.withColumn("u_stat", u).withColumn("_sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    z = (F.abs(F.col("u_stat") - n1 * n2 / 2) - 0.5) / F.nullif(F.col("_sd"), F.lit(0.0))
    z = F.when(F.col("_sd") > 1e-9, F.greatest(z, F.lit(0.0)))
    fold = (F.col("total_in") / n1 - F.try_divide(F.col("total_all") - F.col("total_in"), n2)) / math.log(2)
    return g.withColumn("z", z).withColumn("log2FC", fold).select(
        "feature_id", "cluster", "u_stat", "z", "log2FC"
    )


def marker_test(values: DataFrame, cells: DataFrame, value: str = "norm") -> DataFrame:
    """Rank-sum p-values with FDR inside each cluster; undecidable rows get p = 1."""
    tested = rank_sum(values, cells, value).withColumn(
        "pval", F.coalesce(tails.normal_two_sided_p(F.col("z")), F.lit(1.0))
    )
    return O.benjamini_hochberg(materialize(tested), "pval", "pval_adj", ["cluster"], fixed=True)


def top_markers(
    tested: DataFrame, n: int = 10, max_fdr: float = 0.05, min_log2fc: float = 0.25
) -> DataFrame:
    """First n per cluster by p, then fold change descending, then feature."""
    order = Window.partitionBy("cluster").orderBy(
        F.asc("pval"), F.desc("log2FC"), F.asc("feature_id")
    )
    good = tested.where((F.col("pval_adj") < max_fdr) & (F.col("log2FC") > min_log2fc))
    return good.withColumn("marker_rank", F.row_number().over(order)).where(
        F.col("marker_rank") <= n
    )


def stable_genes(scores: DataFrame, threshold: float = 0.2256) -> DataFrame:
    return scores.where(F.col("mean_score_when_detected") > threshold)
