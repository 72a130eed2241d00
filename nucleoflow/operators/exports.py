"""Subsets and renamings handed to downstream tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O


def start_end_states(cells: DataFrame, state: str, order: str) -> DataFrame:
    """One row (start, end): states whose first cell appears first and last."""
    first = cells.where(F.col(state).isNotNull()).groupBy(state).agg(F.min(order).alias("_f"))
    return first.agg(F.min_by(state, "_f").alias("start"), F.max_by(state, "_f").alias("end"))


def start_end_cells(
    cells: DataFrame, state: str, order: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Cells of the two border states, recoded to start / end."""
    if start is None or end is None:
        s = start_end_states(cells, state, order).select(F.struct("start", "end").alias("s")).scalar()
        lo, hi = s["start"], s["end"]
    else:
        lo, hi = F.lit(start), F.lit(end)
    recoded = F.when(F.col(state) == lo, "start").when(F.col(state) == hi, "end")
    return cells.withColumn("state", recoded).where(F.col("state").isNotNull())


def ordered_states(cells: DataFrame, state: str, path: list[str]) -> DataFrame:
    """Position of each cell's state on the path; cells off the path are dropped."""
    where = F.array_position(F.array(*[F.lit(p) for p in path]), F.col(state)) - 1
    return cells.withColumn("state_order", where.cast("int")).where(F.col("state_order") >= 0)


def network_table(grn: DataFrame) -> DataFrame:
    """(TF, target, weight) of edges with a correlation."""
    return grn.where(F.col("correlation").isNotNull()).select(
        F.col("tf").alias("TF"), F.col("gene").alias("target"), F.col("correlation").alias("weight")
    )


def comparison_bundle(
    counts: DataFrame, cells: DataFrame, grn: DataFrame, state: str, order: str, full_path: list[str] | None = None
) -> dict[str, DataFrame]:
    """Tables of the start/end bundle, or of the whole path when it is given."""
    if full_path:
        kept = ordered_states(cells, state, full_path)
    else:
        kept = start_end_cells(cells, state, order)
    kept = O.min_max(kept, "trajectory", "pseudotime")
    return {
        "cells": kept,
        "counts": counts.join(kept.select("cell_id"), "cell_id", "left_semi"),
        "network": network_table(grn),
        "grn_full_baseline": grn,
    }
