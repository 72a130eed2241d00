"""Quality control: per-cell metrics, cell and feature filters, modality sync."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoflow.container import Multiome
from nucleoflow.functions import ordering as O
from nucleoflow.functions import strings as S
from nucleoflow.session import materialize, written


@dataclass(frozen=True)
class QcLimits:
    min_features: int = 200
    max_features: int = 5000
    min_counts: float = 0.0
    max_counts: float = float("inf")
    max_pct_mt: float = 20.0
    min_cells_per_gene: int = 1
    min_cells_per_peak: int = 1
    exclude_genes: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self):
        for name in ("min_features", "min_counts", "min_cells_per_gene", "min_cells_per_peak"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


def mitochondrial(name: Column, pattern: str = "^MT-") -> Column:
    """Case-insensitive match at the start of the feature name."""
    return name.rlike(f"(?i)^(?:{pattern})")


def cell_metrics(counts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Features seen, total and flagged percentage per cell.

    ``flagged`` lists (feature_id, is_mt); one shuffle on cell with map-side
    partial sums, so a cell with very many entries is no hot spot.
    """
    joined = counts.join(flagged.select("feature_id", "is_mt"), "feature_id", "left")
    mt = F.sum(F.when(F.col("is_mt"), F.col("value")).otherwise(0.0))
    return joined.groupBy("cell_id").agg(
        F.count_if(F.col("value") > 0).alias("n_feature"),
        F.sum("value").alias("n_count"),
        (S.safe_divide(mt, F.sum("value")) * 100).alias("pct_mt"),
    )


def passes(limits: QcLimits) -> Column:
    return (
        F.col("n_feature").between(limits.min_features, limits.max_features)
        & (F.col("n_count") >= limits.min_counts)
        & (F.col("n_count") <= limits.max_counts)
        & (F.col("pct_mt") <= limits.max_pct_mt)
    )


def flag_cells(metrics: DataFrame, limits: QcLimits) -> DataFrame:
    return metrics.withColumn("pass_qc", passes(limits))


def feature_cells(counts: DataFrame) -> DataFrame:
    """Number of cells with a positive value, per feature."""
    return counts.where(F.col("value") > 0).groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n_cells")
    )


def filter_features(
    counts: DataFrame,
    min_cells: int = 0,
    names: DataFrame | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Drop rarely seen features, then features whose name matches a pattern."""
    if min_cells > 0:
        seen = feature_cells(counts).where(F.col("n_cells") >= min_cells)
        counts = counts.join(seen, "feature_id", "left_semi")
    if exclude:
        bad = names.where(S.matches_any(F.col("symbol"), exclude))
        counts = counts.join(bad, "feature_id", "left_anti")
    return counts


def filter_rna(
    counts: DataFrame, names: DataFrame, limits: QcLimits, mt_pattern: str = "^MT-"
) -> DataFrame:
    """Cell filter first; gene support is counted on surviving cells only."""
    flagged = names.select("feature_id", mitochondrial(F.col("symbol"), mt_pattern).alias("is_mt"))
    good = cell_metrics(counts, flagged).where(passes(limits))
    kept = counts.join(good, "cell_id", "left_semi")
    return filter_features(kept, limits.min_cells_per_gene, names, limits.exclude_genes)


def filter_atac(counts: DataFrame, peaks: DataFrame, min_cells: int = 1) -> DataFrame:
    """Peaks on standard chromosomes seen in enough cells. ``peaks``: (feature_id, name)."""
    standard = peaks.where(S.is_standard_chromosome(F.col("name")))
    return filter_features(counts.join(standard, "feature_id", "left_semi"), min_cells)


def shared_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct cells present on both sides."""
    return left.select("cell_id").distinct().join(
        right.select("cell_id").distinct(), "cell_id", "left_semi"
    )


def require_shared(shared: DataFrame) -> DataFrame:
    if shared.isEmpty():
        raise ValueError("the modalities share no cell")
    return shared


def quality_control(
    rna: DataFrame,
    atac: DataFrame,
    genes: DataFrame,
    peaks: DataFrame,
    limits: QcLimits = QcLimits(),
    mt_pattern: str = "^MT-",
    sync_first: bool = False,
) -> DataFrame:
    """RNA filter, ATAC filter and cell sync; returns long counts with modality.

    ``sync_first`` counts peak support on shared cells only, as the pipeline for
    supplied labels does. Counts are written once as they come and once filtered,
    so that what they derive from is computed once.
    """
    rna = written(filter_rna(written(rna), genes, limits, mt_pattern))
    atac = written(atac)
    if sync_first:
        shared = shared_cells(rna, atac)
        atac = filter_atac(written(atac.join(shared, "cell_id", "left_semi")), peaks, limits.min_cells_per_peak)
    else:
        atac = filter_atac(atac, peaks, limits.min_cells_per_peak)
    atac = written(atac)
    shared = materialize(shared_cells(rna, atac))
    both = rna.withColumn("modality", F.lit("rna")).unionByName(
        atac.withColumn("modality", F.lit("atac"))
    )
    return both.join(shared, "cell_id", "left_semi")


def qc_container(data: Multiome, limits: QcLimits = QcLimits()) -> Multiome:
    """Container form of :func:`quality_control`."""
    named = data.features.select("modality", "feature_id", F.col("feature_id").alias("symbol"))
    genes = named.where("modality = 'rna'").drop("modality")
    peaks = named.where("modality = 'atac'").select("feature_id", F.col("symbol").alias("name"))
    counts = quality_control(data.modality("rna"), data.modality("atac"), genes, peaks, limits)
    cells = data.cells.join(counts.select("cell_id").distinct(), "cell_id", "left_semi")
    return Multiome(counts, cells, data.features, data.embeddings, dict(data.extra))


def metric_long(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, value) rows, the data behind violin plots."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def metric_summary(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, median and sample deviation of each metric in one long pass."""
    long = metric_long(metrics, names)
    moments = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    medians = O.exact_quantiles(long, "value", {"median": 0.5}, ["metric"])
    return moments.join(medians, "metric")


def looks_like_counts(counts: DataFrame) -> DataFrame:
    """Per modality: whether every stored value is integral."""
    off = F.max(F.abs(F.col("value") - F.round(F.col("value"))))
    return counts.groupBy("modality").agg(
        off.alias("max_fraction"), (off < 1e-9).alias("is_counts"), F.count(F.lit(1)).alias("n_values")
    )


def unique_names(features: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Second and later uses of a name get ``-1``, ``-2``, ... in ``order``."""
    ranked = O.with_ranks(
        features.withColumn("_o", F.col(order).cast("double")), "_o", {"_pos": O.min_rank()}, [name]
    )
    k = (F.col("_pos") - 1).cast("string")
    return ranked.withColumn(
        out, F.when(F.col("_pos") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), k))
    ).drop("_o", "_pos")
