"""Factor-gene correlation, factor and gene selection, network assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O
from nucleoflow.functions import tails
from nucleoflow.functions import strings as S
from nucleoflow.functions import vectors as V
from nucleoflow.operators import linking, matching, tiles, trajectory
from nucleoflow.schemas import GRN_ALIASES, canonical_names, require_columns
from nucleoflow.session import materialize, written

MIN_BINS = 3


def correlation_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int) -> DataFrame:
    """Pearson r over n points, t and p of every left row with every right row, tile by tile."""
    l, r = linking.unit_profiles(left), linking.unit_profiles(right)
    nl, nr = tiles.tile_count(l), tiles.tile_count(r)
    key_types = dict(left.dtypes)["feature_id"], dict(right.dtypes)["feature_id"]
    left_tiles = tiles.pack(l, "feature_id", {"v": F.col("unit")}, nl)
    right_tiles = tiles.pack(r, "feature_id", {"v": F.col("unit")}, nr)

    def kernel(row) -> pd.DataFrame:
        a, b = tiles.matrix(row.l_v, len(row.l_k)), tiles.matrix(row.r_v, len(row.r_k))
        r = np.clip(a @ b.T, -1.0, 1.0).ravel()
        t, p = tails.pearson_tests(r, n)
        return pd.DataFrame(
            {
                left_key: np.repeat(np.asarray(row.l_k), len(row.r_k)),
                right_key: np.tile(np.asarray(row.r_k), len(row.l_k)),
                "correlation": r,
                "t_stat": t,
                "p_value": p,
            }
        )

    return tiles.every_pair(
        left_tiles,
        right_tiles,
        nl,
        nr,
        kernel,
        f"{left_key} {key_types[0]}, {right_key} {key_types[1]}, correlation double, t_stat double, p_value double",
    )


def tf_gene_correlation(
    tf_profiles: DataFrame,
    gene_profiles: DataFrame,
    tfs: DataFrame | None = None,
    genes: DataFrame | None = None,
    var_cutoff: float | None = 0.9,
    limit: float = 1.5,
    n_bins: int = 100,
) -> DataFrame:
    """(tf, gene, correlation, t_stat, p_value, fdr) over scaled profiles.

    Lists restrict rows only after the variance budget has been applied.
    """
    if n_bins < MIN_BINS:
        raise ValueError(f"at least {MIN_BINS} time bins are needed")
    t = trajectory.scaled_profiles(tf_profiles, None, None, limit)
    g = trajectory.scaled_profiles(gene_profiles, var_cutoff, 25000, limit)
    if tfs is not None:
        t = t.join(tfs.select(F.col("tf").alias("feature_id")), "feature_id", "left_semi")
    if genes is not None:
        g = g.join(genes.select(F.col("gene").alias("feature_id")), "feature_id", "left_semi")
    tested = written(correlation_blocks(materialize(t), materialize(g), "tf", "gene", n_bins))
    return O.benjamini_hochberg(tested, "p_value", "fdr", fixed=True)


def mean_activity_by_name(activity: DataFrame, names: DataFrame) -> DataFrame:
    """Average activity of motifs that carry one factor name.

    ``activity``: cell_id, motif, value. ``names``: motif, tf.
    """
    return activity.join(names, "motif").groupBy("cell_id", "tf").agg(
        F.avg("value").alias("activity"), F.count(F.lit(1)).alias("n_motifs")
    )


def select_tfs(
    activity: DataFrame,
    expression: DataFrame,
    correlation_threshold: float = 0.3,
    p_cutoff: float = 0.01,
    n_tfs: int | None = None,
    n_bins: int = 100,
    symbols: DataFrame | None = None,
    require: bool = False,
) -> DataFrame:
    """One row per factor with both profiles: tests, filter flags, ranks, time point.

    If no expression profile has the name of a factor, names are replaced
    through ``symbols`` (name, symbol); of profiles that get the same symbol
    that of the first name counts, and still none in common is a ``ValueError``.
    With ``require``, so is a result in which no factor passes.

    ``activity`` and ``expression`` are profiles keyed by factor name in
    ``feature_id``. Constant rows are skipped. Time points are spread over every
    factor with activity, not over the selected ones.
    """
    if n_tfs is not None and (not isinstance(n_tfs, int) or n_tfs <= 0):
        raise ValueError("n_tfs must be a positive integer or None")

    def varying(df: DataFrame) -> DataFrame:
        return df.where(V.sample_variance(F.col("vec")) > 0)

    a, e = varying(activity), varying(expression)
    if symbols is not None:
        rows = e.select(F.col("feature_id").alias("name"), F.col("feature_id").alias("id"), "vec")
        named = matching.common_names(a.select(F.col("feature_id").alias("name")), rows, symbols)
        e = materialize(named.groupBy(F.col("name").alias("feature_id")).agg(F.min_by("vec", "id").alias("vec")))
    pairs = a.select(F.col("feature_id").alias("tf")).join(
        e.select(F.col("feature_id").alias("tf")), "tf", "left_semi"
    )
    pairs = pairs.withColumn("gene", F.col("tf"))
    tested = linking.correlate_pairs(pairs, a, e, "tf", "gene", n_bins).select(
        "tf",
        F.col("Correlation").alias("correlation"),
        F.col("TStat").alias("t_stat"),
        F.col("pvalue").alias("p_value"),
    )
    out = O.benjamini_hochberg(materialize(tested), "p_value", "adj_p", fixed=True)
    passed = (F.col("adj_p") < p_cutoff) & (F.col("correlation") > correlation_threshold)
    out = materialize(out.withColumn("pass_filters", passed))
    out = O.with_ranks(out, "correlation", {"correlation_rank_all": O.min_rank_desc()}, fixed=True)
    good = out.where("pass_filters")
    if require and good.isEmpty():
        raise ValueError(f"no factor has a correlation above {correlation_threshold} and an adjusted p below {p_cutoff}")
    ranked = O.with_ranks(
        good.select("tf", "correlation"), "correlation", {"correlation_rank_passed": O.min_rank_desc()}, fixed=True
    ).select("tf", "correlation_rank_passed")
    chosen = good.select("tf", "correlation")
    if n_tfs is not None:
        chosen = O.top_n(chosen, "correlation", "tf", n_tfs)
    times = trajectory.time_points(activity).select(F.col("feature_id").alias("tf"), "time_point")
    return (
        out.join(ranked, "tf", "left")
        .join(chosen.select("tf").withColumn("selected", F.lit(True)), "tf", "left")
        .join(times, "tf", "left")
        .fillna(False, ["selected"])
    )


def select_genes(
    peak_profiles: DataFrame,
    gene_profiles: DataFrame,
    peaks: DataFrame,
    genes: DataFrame,
    var_cutoff: float | None = 0.9,
    max_distance: float = 250000.0,
    distance_cutoff: float = 2000.0,
    correlation_cutoff: float = 0.0,
    fdr_cutoff: float = 1e-4,
    n_bins: int = 100,
) -> DataFrame:
    """Links of the most variable genes that pass all filters."""
    variable = trajectory.variance_cutoff(gene_profiles, var_cutoff)
    kept = genes.join(
        variable.select(F.col("feature_id").alias("gene")), "gene", "left_semi"
    )
    links = linking.link_peaks_to_genes(
        peak_profiles, variable.select("feature_id", "vec"), peaks, kept, max_distance, n_bins
    )
    return linking.filter_links(links, distance_cutoff, correlation_cutoff, fdr_cutoff)


def peak_support(motif_match: DataFrame, links: DataFrame) -> DataFrame:
    """(tf, gene, n_peaks): peaks bound by tf and linked to gene."""
    require_columns(motif_match, "peak", "tf", "score", what="motif_match")
    bound = motif_match.where(F.col("score") > 0).select("peak", "tf")
    return (
        bound.join(links.select("peak", "gene"), "peak")
        .groupBy("tf", "gene")
        .agg(F.count(F.lit(1)).alias("n_peaks"))
    )


def infer_grn(
    motif_match: DataFrame,
    tf_gene_cor: DataFrame,
    links: DataFrame,
    correlation_threshold: float | None = None,
) -> DataFrame:
    """Network edges with support and correlation.

    Without a threshold an edge lacking a correlation stays, with NULL.
    """
    cor = canonical_names(tf_gene_cor, GRN_ALIASES)
    require_columns(cor, "tf", "gene", "correlation", what="tf_gene_cor")
    edges = peak_support(motif_match, canonical_names(links, GRN_ALIASES)).join(
        cor, ["tf", "gene"], "left"
    )
    if correlation_threshold is not None:
        edges = edges.where(F.abs("correlation") >= correlation_threshold)
    return edges


def with_known_correlation(grn: DataFrame) -> DataFrame:
    return grn.where(F.col("correlation").isNotNull())


def add_edge_weights(grn: DataFrame, normalize_names: bool = True) -> DataFrame:
    """edge_weight = percentile rank of log1p(peak support) * |correlation|.

    Percentiles are taken over edges with support; others weigh 0.
    """
    grn = require_columns(canonical_names(grn, GRN_ALIASES), "tf", "gene", "correlation", what="grn")
    if "n_peaks" not in grn.columns:
        raise ValueError("n_peaks is needed to compute the motif score")
    count = F.coalesce(F.col("n_peaks").cast("double"), F.lit(0.0))
    out = grn.withColumn("motif_peak_count", count).withColumn(
        "expression_assoc", F.coalesce(F.col("correlation").cast("double"), F.lit(0.0))
    )
    if normalize_names and dict(grn.dtypes)["tf"] == "string":
        out = out.withColumn("tf", S.factor_name(F.col("tf")))
    out = out.withColumn(
        "_support", F.when(F.col("motif_peak_count") > 0, F.log1p("motif_peak_count"))
    )
    out = O.with_ranks(out, "_support", {"motif_score": O.percent_rank_average()}, fill=0.0)
    out = out.withColumn("expr_score", F.abs("expression_assoc"))
    return out.withColumn("edge_weight", F.col("motif_score") * F.col("expr_score")).drop("_support")


def network_support(weighted: DataFrame) -> DataFrame:
    """Per factor: summed weight, targets, edges, means (one shuffle).

    Distinct targets are counted by first collapsing (tf, gene), which splits
    the rows of a factor that holds most edges.
    """
    w = F.col("edge_weight")
    per_target = weighted.groupBy("tf", "gene").agg(
        F.sum(F.abs(w)).alias("a"), F.sum(w).alias("s"), F.count(F.lit(1)).alias("c")
    )
    return per_target.groupBy(F.col("tf").alias("TF")).agg(
        F.sum("a").alias("NetworkSupport"),
        F.sum("s").alias("weighted_outdegree"),
        F.sum("a").alias("weighted_outdegree_abs"),
        F.count(F.lit(1)).alias("n_targets"),
        F.sum("c").alias("n_edges"),
        (F.sum("s") / F.sum("c")).alias("mean_edge_weight"),
        (F.sum("a") / F.sum("c")).alias("mean_abs_edge_weight"),
    )


def rank_network_support(weighted: DataFrame) -> DataFrame:
    """Network support with its row-number rank (highest first, name on ties)."""
    support = materialize(network_support(weighted))
    return O.dense_order(support, "NetworkSupport", "TF", "NetworkSupport_rank", fixed=True)
