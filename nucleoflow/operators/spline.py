"""Trajectory curve: penalised cubic spline from aggregated normal equations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O
from nucleoflow.operators import neighbors, trajectory
from nucleoflow.session import materialize


def _basis(u: Column) -> list[Column]:
    """The four uniform cubic B-splines that are non-zero at offset u in [0, 1]."""
    v = 1 - u
    return [
        v * v * v / 6,
        (3 * u * u * u - 6 * u * u + 4) / 6,
        (3 * v * v * v - 6 * v * v + 4) / 6,
        u * u * u / 6,
    ]


def _basis_rows(t: np.ndarray, lo: float, width: float, segments: int):
    s = np.clip(np.floor((t - lo) / width), 0, segments - 1).astype(int)
    u = (t - lo) / width - s
    v = 1 - u
    b = np.stack(
        [v**3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (3 * v**3 - 6 * v**2 + 4) / 6, u**3 / 6], axis=1
    )
    return s, b


class Curve:
    """Spline coefficients: (segments + 3) x dims, a size fixed by parameters."""

    def __init__(self, lo: float, width: float, segments: int, coef: np.ndarray):
        self.lo, self.width, self.segments, self.coef = lo, width, segments, coef

    def __call__(self, t: np.ndarray) -> np.ndarray:
        s, b = _basis_rows(np.asarray(t, dtype=float), self.lo, self.width, self.segments)
        return sum(b[:, [i]] * self.coef[s + i] for i in range(4))


def fit_curve(points: DataFrame, time: str, dims: int, dof: float = 250, spar: float = 1.0) -> Curve:
    """Smoothest spline per dimension whose residual sum stays within n / dof * spar.

    Spark sums the normal equations per knot interval (at most ``dof`` rows);
    only those sums reach the driver. The penalty is the fourth difference, so a
    loose bound gives a cubic polynomial.
    """
    head = points.agg(
        F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n")
    ).first()
    segments = int(max(1, min(dof, head.n // 2)))
    width = (head.hi - head.lo) / segments or 1.0
    pos = (F.col(time) - head.lo) / width
    seg = F.greatest(F.lit(0), F.least(F.lit(segments - 1), F.floor(pos))).cast("int")
    rows = points.select("vec", seg.alias("seg"), (pos - seg).alias("u"))
    b = _basis(F.col("u"))
    aggs = [F.sum(b[i] * b[j]).alias(f"g{i}{j}") for i in range(4) for j in range(i, 4)]
    aggs += [
        F.array(*[F.sum(b[i] * F.col("vec")[d]) for d in range(dims)]).alias(f"y{i}") for i in range(4)
    ]
    aggs.append(F.array(*[F.sum(F.col("vec")[d] * F.col("vec")[d]) for d in range(dims)]).alias("yy"))
    size = segments + 3
    gram, rhs, yy = np.zeros((size, size)), np.zeros((size, dims)), np.zeros(dims)
    for row in rows.groupBy("seg").agg(*aggs).collect():
        for i in range(4):
            rhs[row.seg + i] += row[f"y{i}"]
            for j in range(i, 4):
                gram[row.seg + i, row.seg + j] += row[f"g{i}{j}"]
                if i != j:
                    gram[row.seg + j, row.seg + i] += row[f"g{i}{j}"]
        yy += row["yy"]
    order = min(4, size - 1)
    diff = np.diff(np.eye(size), n=order, axis=0)
    penalty = diff.T @ diff
    scale = np.trace(gram) / size or 1.0
    ridge = 1e-10 * scale * np.eye(size)
    target = head.n / dof * spar
    coef = np.zeros((size, dims))
    for d in range(dims):

        def solve(log_lambda: float) -> tuple[np.ndarray, float]:
            c = np.linalg.solve(gram + scale * 10.0**log_lambda * penalty + ridge, rhs[:, d])
            return c, float(yy[d] - 2 * c @ rhs[:, d] + c @ gram @ c)

        low, high = -8.0, 10.0
        best, rss = solve(high)
        if rss > target:
            best, rss = solve(low)
            if rss <= target:
                for _ in range(50):
                    mid = (low + high) / 2
                    c, rss = solve(mid)
                    if rss <= target:
                        low, best = mid, c
                    else:
                        high = mid
        coef[:, d] = best
    return Curve(head.lo, width, segments, coef)


def evaluate(points: DataFrame, curve: Curve, key: str, time: str) -> DataFrame:
    """Curve position at each row's time."""
    key_type = dict(points.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {key: batch[key], time: batch[time], "vec": list(curve(batch[time].to_numpy(float)))}
            )

    return points.select(key, time).mapInPandas(run, f"{key} {key_type}, {time} double, vec array<double>")


def infer_trajectory(
    points: DataFrame,
    path: list,
    group: str,
    dims: int,
    key: str = "cell_id",
    pre_quantile: float = 0.9,
    post_quantile: float = 0.9,
    dof: float = 250,
    spar: float = 1.0,
    mode: str = "trunc",
    base: int = 0,
) -> DataFrame:
    """(key, trajectory in 0..100) for cells near a curve through the path's groups.

    Cells of other groups and outliers are absent from the result.
    """
    names = [str(p) for p in path]
    on_path = points.where(F.col(group).cast("string").isin(names)).select(
        key, group, F.col("vec").cast("array<double>").alias("vec")
    )
    if on_path.isEmpty():
        raise ValueError("no cell belongs to the trajectory groups")
    kept = trajectory.distance_filter(on_path, group, dims, pre_quantile)
    timed = trajectory.initial_times(materialize(kept), names, group, dims, mode, base)
    timed = materialize(timed.select(key, "time0", "vec"))
    curve = fit_curve(timed, "time0", dims, dof, spar)
    line = O.dense_order(evaluate(timed, curve, key, "time0"), "time0", key, "_at", descending=False)
    line = materialize(line.select((F.col("_at") - 1).alias("at"), "vec"))
    near = neighbors.knn(on_path, line, 3, key, "at", point_order="at")

    def pick(r: int, col: str) -> Column:
        return F.max(F.when(F.col("nn_rank") == r, F.col(col)))

    placed = near.groupBy(key).agg(
        pick(1, "neighbor").alias("i1"),
        pick(2, "neighbor").alias("i2"),
        pick(3, "neighbor").alias("i3"),
        pick(1, "distance").alias("gap"),
    )
    placed = materialize(placed)
    placed = O.with_ranks(placed, "gap", {"q": O.empirical_quantile(mode)}, fixed=True)
    side = F.when(F.col("i2") > F.col("i3"), 1).otherwise(-1)
    placed = placed.withColumn("order", F.col("i1") + base + side * F.col("q"))
    cut = O.exact_quantiles(placed, "gap", {"cut": post_quantile}).scalar()
    final = placed.where(F.col("gap") <= cut).select(key, "order")
    ranked = O.with_ranks(final, "order", {"q": O.empirical_quantile(mode)})
    return ranked.select(key, (F.col("q") * 100).alias("trajectory"))
