"""Pseudotime binning, bin profiles and their transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O
from nucleoflow.functions import vectors as V
from nucleoflow.session import materialize


def assign_bins(cells: DataFrame, every: float = 1.0) -> DataFrame:
    """Left-open, right-closed bins; time 0 and cells off the trajectory get none."""
    b = F.ceil(F.col("trajectory") / every)
    return cells.where((F.col("trajectory") > 0) & (F.col("trajectory") <= 100)).select(
        "cell_id", b.cast("int").alias("bin")
    )


def check_range(cells: DataFrame) -> None:
    row = cells.agg(F.min("trajectory").alias("lo"), F.max("trajectory").alias("hi")).first()
    if row.lo is not None and (row.lo < 0 or row.hi > 100):
        raise ValueError("trajectory values must lie in [0, 100]")


def bin_sums(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """Sum per (feature, bin). Absent cells add nothing, so this is sparse."""
    return counts.join(bins, "cell_id").groupBy("feature_id", "bin").agg(
        F.sum("value").alias("s")
    )


def bin_sizes(bins: DataFrame) -> Column:
    """bin -> number of cells, as a scalar map of at most n_bins entries."""
    per = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n")))).scalar()


def profiles(
    counts: DataFrame,
    cells: DataFrame,
    every: float = 1.0,
    scale_to: float | None = 10000.0,
    log2: bool = True,
    window: int = 11,
    features: DataFrame | None = None,
) -> DataFrame:
    """One packed row per feature: (feature_id, vec) with one entry per bin.

    Means count absent cells as zero. Scaling and log2 are skipped for the whole
    matrix when any mean is negative. A feature without any value in a binned
    cell is a zero profile and is present when listed in ``features``.
    """
    n_bins = int(-(-100 // every))
    bins = assign_bins(cells, every)
    sizes = bin_sizes(bins)
    means = bin_sums(counts, bins).withColumn(
        "m", F.col("s") / F.element_at(sizes, F.col("bin"))
    )
    means = materialize(means.select("feature_id", "bin", "m"))
    packed = means.groupBy("feature_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("by_bin")
    )
    if features is not None:
        packed = features.select("feature_id").join(packed, "feature_id", "left")
        packed = packed.withColumn(
            "by_bin", F.coalesce("by_bin", F.create_map().cast("map<int,double>"))
        )
    at = V.let(
        F.col("by_bin"),
        lambda m: F.transform(
            F.sequence(F.lit(1), F.lit(n_bins)),
            lambda b: F.coalesce(F.try_element_at(m, b), F.lit(0.0)),
        ),
    )
    out = packed.select("feature_id", at.alias("vec"))
    if scale_to is not None or log2:
        negative = means.agg(F.coalesce(F.min("m") < 0, F.lit(False))).scalar()
        totals = means.groupBy("bin").agg(F.sum("m").alias("t"))
        total_map = totals.agg(F.map_from_entries(F.collect_list(F.struct("bin", "t")))).scalar()
        out = out.withColumn("_neg", negative).withColumn("_tot", total_map)

        def transform(x: Column, i: Column) -> Column:
            if scale_to is not None:
                t = F.coalesce(F.try_element_at("_tot", i + 1), F.lit(0.0))
                x = x / F.when(t == 0, F.lit(1.0)).otherwise(t) * scale_to
            return F.log2(x + 1) if log2 else x

        out = out.withColumn(
            "vec", F.when(F.col("_neg"), F.col("vec")).otherwise(F.transform("vec", transform))
        ).drop("_neg", "_tot")
    if window and window > 1:
        out = out.withColumn("vec", O.rolling_mean_padded(F.col("vec"), n_bins, window))
    return out


def unpack(profile: DataFrame, value: str = "value") -> DataFrame:
    """(feature_id, bin, value) rows with bins from 1."""
    return profile.select("feature_id", F.posexplode("vec").alias("bin", value)).withColumn(
        "bin", F.col("bin") + 1
    )


def variance_cutoff(
    profile: DataFrame, cut: float | None = 0.9, max_features: int | None = None
) -> DataFrame:
    """The most variable features; zero-variance rows are dropped first.

    The budget is ``(1 - cut) * n`` truncated in double arithmetic, so 0.9 of 10
    rows keeps none.
    """
    profile = materialize(profile)
    ok = profile.withColumn("variance", V.sample_variance(F.col("vec"))).where(
        ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)) & (F.col("variance") > 0)
    )
    budgets = []
    if cut is not None:
        budgets.append(F.floor(F.lit(1 - cut) * F.col("total")))
    if max_features is not None:
        budgets.append(F.lit(max_features).cast("bigint"))
    if not budgets:
        return ok
    budget = F.least(*budgets) if len(budgets) > 1 else budgets[0]
    kept = O.top_n(ok.select("feature_id", "variance"), "variance", "feature_id", budget)
    return ok.drop("variance").join(kept.select("feature_id", "variance"), "feature_id")


def scaled_profiles(
    profile: DataFrame, cut: float | None = 0.9, max_features: int | None = 25000, limit: float = 1.5
) -> DataFrame:
    kept = variance_cutoff(profile, cut, max_features)
    return kept.withColumn("vec", V.standardized(F.col("vec"), limit))


def peak_bins(profile: DataFrame) -> DataFrame:
    """Bin of the highest entry, earliest on ties, counted from 1."""
    return profile.select(
        "feature_id", F.array_position("vec", F.array_max("vec")).cast("int").alias("peak_bin")
    )


def time_points(profile: DataFrame, out: str = "time_point") -> DataFrame:
    """Evenly spaced 1..100 in order of peak bin (then id) over all rows given."""
    placed = O.dense_order(peak_bins(profile), "peak_bin", "feature_id", "_pos", descending=False)
    n = placed.agg(F.count(F.lit(1))).scalar()
    spaced = F.lit(1.0) + 99.0 * (F.col("_pos") - 1) / F.nullif(n - 1, F.lit(0))
    return placed.withColumn("peak_bin", F.col("peak_bin").cast("int")).withColumn(
        out, F.coalesce(spaced, F.lit(1.0))
    ).drop("_pos")


# Building the trajectory itself --------------------------------------------------

def centroids(points: DataFrame, group: str, dims: int, vec: str = "vec") -> DataFrame:
    """Mean vector per group with map-side partial sums."""
    return points.groupBy(group).agg(F.array(*V.element_means(vec, dims)).alias("centroid"))


def distance_filter(points: DataFrame, group: str, dims: int, q: float = 0.9) -> DataFrame:
    """Keep rows no farther from their group centroid than the q-quantile distance."""
    centre = centroids(points, group, dims)
    far = points.join(centre, group).withColumn(
        "distance", V.distance(F.col("vec"), F.col("centroid"))
    )
    far = materialize(far)  # the cut is compared with the very values it came from
    cut = O.exact_quantiles(far, "distance", {"cut": q}, [group])
    return far.join(cut, group).where("distance <= cut").drop("centroid", "cut")


def initial_times(
    kept: DataFrame, path: list[str], group: str, dims: int, mode: str = "trunc", base: int = 0
) -> DataFrame:
    """First guess of time: closeness to the next group's centre plus group index.

    The last group uses distance from the previous one. ``mode``/``base`` select
    the quantile rule and whether group indices start at 0 or 1.
    """
    steps = []
    for i, name in enumerate(path):
        last = i == len(path) - 1
        steps.append((str(name), i, str(path[i - 1] if last else path[i + 1]), last))
    spark = kept.sparkSession
    plan = spark.createDataFrame(steps, f"{group} string, step int, toward string, is_last boolean")
    centre = centroids(kept, group, dims).select(F.col(group).alias("toward"), "centroid")
    aimed = kept.drop("distance").withColumn(group, F.col(group).cast("string")).join(
        plan.join(centre.withColumn("toward", F.col("toward").cast("string")), "toward", "left"),
        group,
    )
    aimed = aimed.withColumn("distance", V.distance(F.col("vec"), F.col("centroid")))
    ranked = O.with_ranks(aimed, "distance", {"_q": O.empirical_quantile(mode)}, [group])
    offset = F.col("step") + base
    time = F.when(F.col("_q").isNull(), offset.cast("double")).when(
        F.col("is_last"), F.col("_q") + offset
    ).otherwise(1 - F.col("_q") + offset)
    return ranked.withColumn("time0", time).drop("_q", "toward", "is_last", "centroid")
