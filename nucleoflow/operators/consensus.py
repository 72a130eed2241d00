"""Ensemble consensus: co-clustering, stability, agreement and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nucleoflow.functions import ordering as O
from nucleoflow.functions import vectors as V
from nucleoflow.operators import tiles
from nucleoflow.session import materialize

# Names of the four base clusterers.
METHODS = ["Kmeans", "Seurat", "ACM_WEP", "Hierarchical"]
NOISE = -1


def sample_cells(cells: DataFrame, iters: DataFrame, ratio: float = 0.8) -> DataFrame:
    """floor(ratio * n) cells per iteration without replacement, by hash order.

    The hash is uniform, so its first three hex digits split each iteration into
    4096 even slices; only the slice holding the cut is ordered.
    """
    n = cells.agg(F.count(F.lit(1))).scalar()
    marked = cells.select("cell_idx").withColumn("iter", F.explode(_iter_list(iters)))
    marked = marked.withColumn("_h", F.md5(F.concat_ws(":", "iter", "cell_idx")))
    marked = marked.withColumn("_s", F.substring("_h", 1, 3))
    slices = marked.groupBy("iter", "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("iter").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    room = F.floor(n * F.lit(ratio)) - F.coalesce(F.sum("_c").over(before), F.lit(0))
    slices = slices.withColumn("_room", room).where("_room > 0")
    inside = Window.partitionBy("iter", "_s").orderBy("_h", "cell_idx")
    return (
        marked.join(slices, ["iter", "_s"])
        .withColumn("_r", F.row_number().over(inside))
        .where("_r <= _room")
        .select("iter", "cell_idx")
    )


def _iter_list(iters: DataFrame):
    """Iteration numbers: their count is a run parameter, not data size."""
    return iters.agg(F.collect_list("iter")).scalar()


def complete_iterations(labels: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """Drop iterations in which any method is missing."""
    full = labels.groupBy("iter").agg(F.count_distinct("method").alias("n")).where(
        F.col("n") == len(methods)
    )
    return labels.join(full.select("iter"), "iter", "left_semi")


def _weights(weights: dict[str, float] | None) -> dict[str, float]:
    return {m: 1.0 for m in METHODS} if weights is None else weights


def _codes(labels: DataFrame, weights: dict[str, float] | None, cells: DataFrame | None) -> tuple[DataFrame, np.ndarray]:
    """(id, codes) of all cells, a label per run that has a weight, and those weights."""
    weights = _weights(weights)
    coded = labels.where(F.col("label") != NOISE).groupBy(F.col("cell_idx").alias("id")).agg(
        F.collect_list(F.struct(F.concat_ws("|", "iter", "method").alias("run"), "label")).alias("seen")
    )
    # Every cell has to appear, even if it is noise everywhere.
    everyone = (labels if cells is None else cells).select(F.col("cell_idx").alias("id")).distinct()
    coded = everyone.join(coded, "id", "left")
    runs = [
        (f"{r['iter']}|{r['method']}", float(weights.get(r["method"], 0.0)))
        for r in labels.select("iter", "method").distinct().collect()
    ]
    runs = sorted(r for r in runs if r[1] != 0)
    position = F.create_map(*[F.lit(x) for i, (run, _) in enumerate(runs) for x in (run, i)])
    by_run = F.map_from_entries(
        F.transform(
            F.filter("seen", lambda s: F.map_contains_key(position, s["run"])),
            lambda s: F.struct(position[s["run"]], s["label"]),
        )
    )
    packed = coded.select(
        "id",
        F.coalesce(by_run, F.create_map().cast("map<int,int>")).alias("m"),
    ).select(
        "id",
        V.let(
            F.col("m"),
            lambda m: F.transform(
                F.sequence(F.lit(0), F.lit(len(runs) - 1)),
                lambda i: F.coalesce(F.try_element_at(m, i), F.lit(NOISE)),
            ),
        ).alias("codes"),
    )
    return materialize(packed), np.array([v for _, v in runs])


def _counts(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the runs in which rows of ``a`` and ``b`` are both seen, and in which they have one label."""
    together = (a != NOISE) * w @ (b != NOISE).T.astype(float)
    same = np.zeros_like(together)
    for m in range(a.shape[1]):
        left = a[:, m][:, None]
        same += w[m] * ((left == b[:, m][None, :]) & (left != NOISE))
    return together, same


def co_clustering(
    labels: DataFrame, weights: dict[str, float] | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """(i, j, w_cluster, w_sample, value) for every i < j sampled or not.

    ``cells`` (column cell_idx) lists all cells; without it those in ``labels``
    are all there are.

    Cells are tiles of packed label rows; a pair of tiles is counted by NumPy in
    one task. Noise counts on neither side. Pairs never sampled together get 0.
    The result has one row per pair of cells by definition.
    """
    packed, w = _codes(labels, weights, cells)
    n_tiles = tiles.tile_count(packed)
    blocks = tiles.pack(packed, "id", {"c": F.col("codes")}, n_tiles)

    def kernel(row) -> pd.DataFrame | None:
        a = np.asarray(row.l_c, dtype=np.int64).reshape(len(row.l_k), -1)
        b = np.asarray(row.r_c, dtype=np.int64).reshape(len(row.r_k), -1)
        together, same = _counts(a, b, w)
        li, ri = np.asarray(row.l_k), np.asarray(row.r_k)
        if row.l_tile == row.r_tile:
            x, y = np.nonzero(li[:, None] < ri[None, :])
        else:
            x, y = (v.ravel() for v in np.indices(together.shape))
        s, c = together[x, y], same[x, y]
        return pd.DataFrame(
            {
                "i": np.minimum(li[x], ri[y]),
                "j": np.maximum(li[x], ri[y]),
                "w_cluster": c,
                "w_sample": s,
                "value": np.divide(c, s, out=np.zeros_like(c), where=s != 0),
            }
        )

    id_type = dict(labels.dtypes)["cell_idx"]
    schema = f"i {id_type}, j {id_type}, w_cluster double, w_sample double, value double"
    return tiles.reduce_blocks(blocks, blocks, n_tiles, n_tiles, kernel, schema, upper_only=True)


def consensus_auc(pairs: DataFrame) -> DataFrame:
    """Area under the empirical CDF of the upper triangle, by trapezoids.

    Equal values add no area except at their last occurrence, so the sum runs
    over distinct levels and needs only each level's successor.
    """
    return _area(materialize(O.level_table(pairs, "value")))


def consensus_auc_of(
    labels: DataFrame, weights: dict[str, float] | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """``consensus_auc`` of the pairs of ``co_clustering``, which are counted by value and not stored.

    Cells with the same labels in all runs are one row with their number.
    """
    packed, w = _codes(labels, weights, cells)
    kinds = packed.groupBy("codes").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
    kinds = materialize(kinds)
    n = tiles.tile_count(kinds)
    blocks = tiles.pack(kinds, "id", {"c": F.col("codes"), "m": F.col("m")}, n)

    def kernel(row) -> pd.DataFrame | None:
        lm, rm = np.asarray(row.l_m, dtype=np.int64), np.asarray(row.r_m, dtype=np.int64)
        a = np.asarray(row.l_c, dtype=np.int64).reshape(len(lm), -1)
        b = np.asarray(row.r_c, dtype=np.int64).reshape(len(rm), -1)
        together, same = _counts(a, b, w)
        pairs = lm[:, None] * rm[None, :]
        if row.l_tile == row.r_tile:
            pairs = np.triu(pairs, 1) + np.diag(lm * (lm - 1) // 2)
        value = np.divide(same, together, out=np.zeros_like(same), where=together != 0)
        return added(pd.DataFrame({"value": value[pairs > 0], "ties": pairs[pairs > 0]}))

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("value", as_index=False)["ties"].sum()

    parts = tiles.reduce_blocks(blocks, blocks, n, n, kernel, "value double, ties bigint", True, added)
    hist = parts.groupBy("value").agg(F.sum("ties").alias("ties"))
    return _area(materialize(O.levels_from_histogram(hist, "value")))


def _area(levels: DataFrame) -> DataFrame:
    inside = Window.partitionBy("_b").orderBy("value")
    first = levels.groupBy("_b").agg(F.min("value").alias("_f"))
    nxt = Window.orderBy("_b")
    follow = first.select("_b", F.lead("_f").over(nxt).alias("_nf"))
    steps = levels.join(follow, "_b").withColumn(
        "next_value", F.coalesce(F.lead("value").over(inside), F.col("_nf"))
    )
    at = (F.col("below") + F.col("ties")) / F.col("total")
    after = (F.col("below") + F.col("ties") + 1) / F.col("total")
    area = (F.col("next_value") - F.col("value")) * (at + after) / 2
    return steps.agg(F.sum(area).alias("auc"), F.max("total").alias("n_pairs"))


def gene_stability(scores: DataFrame, n_iter: int, top: int = 300) -> DataFrame:
    """Score statistics and detection rates per gene over all iterations.

    ``scores``: iter, gene, score; a missing row means not detected. Rates are
    relative to the requested number of iterations.
    """
    detected = scores.where(F.col("score") >= 0)
    base = detected.groupBy("gene").agg(
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.median("score").alias("median_score"),
        F.sum("score").alias("cumulative_score"),
        F.count(F.lit(1)).alias("freq_detected"),
        F.avg("score").alias("mean_score_when_detected"),
    )
    best = O.top_n(detected, "score", "gene", top, ["iter"])
    hits = best.groupBy("gene").agg(F.count(F.lit(1)).alias("freq_top300"))
    genes = scores.select("gene").distinct()
    out = genes.join(base, "gene", "left").join(hits, "gene", "left").fillna(0)
    return out.withColumn(
        "top300_rate", F.round(F.col("freq_top300") / n_iter * 100, 2)
    ).withColumn("detection_rate", F.round(F.col("freq_detected") / n_iter * 100, 2))


def sampling_counts(sampled: DataFrame, cells: DataFrame, n_iter: int) -> DataFrame:
    """How often each cell was drawn, zero included."""
    drawn = sampled.groupBy("cell_idx").agg(F.count(F.lit(1)).alias("n_sampled"))
    return cells.select("cell_idx").join(drawn, "cell_idx", "left").fillna(0).withColumn(
        "sampling_rate", F.col("n_sampled") / n_iter
    )


def label_table(labels: DataFrame, iters: list[int]) -> DataFrame:
    """Cell x iteration table of labels for one method."""
    return labels.groupBy("cell_idx").pivot("iter", iters).agg(F.first("label"))


def gene_importance(loadings: DataFrame, variance_ratio: list[float]) -> DataFrame:
    """Sum of squared loadings weighted by explained variance, scaled to 0..1."""
    ratio = F.array(*[F.lit(float(v)) for v in variance_ratio])
    raw = loadings.select(
        "gene", V.total(F.zip_with("vec", ratio, lambda l, r: l * l * r)).alias("raw")
    )
    return O.min_max(raw, "raw", "score").select("gene", "score")


# Agreement between labelings ------------------------------------------------------

def contingency(pairs: DataFrame, a: str = "true_label", b: str = "pred_label") -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame, a: str = "true_label", b: str = "pred_label") -> DataFrame:
    """One row: ARI, NMI (arithmetic mean) and FMI from a contingency table."""

    def choose2(c):
        return c * (c - 1) / 2

    def side(col: str, tag: str) -> DataFrame:
        per = table.groupBy(col).agg(F.sum("n").cast("double").alias("m"))
        return per.agg(
            F.sum(choose2(F.col("m"))).alias(f"{tag}_pairs"),
            F.sum(F.col("m") * F.log("m")).alias(f"{tag}_mlogm"),
        )

    n = F.col("n").cast("double")
    joint = table.agg(
        F.sum(n).alias("total"),
        F.sum(choose2(n)).alias("pairs"),
        F.sum(n * F.log(n)).alias("nlogn"),
    )
    # Each side is one row, read as a scalar.
    row = joint
    for col, tag in ((a, "a"), (b, "b")):
        one = side(col, tag).select(F.struct(f"{tag}_pairs", f"{tag}_mlogm").alias("s")).scalar()
        row = row.withColumns({f"{tag}_pairs": one[f"{tag}_pairs"], f"{tag}_mlogm": one[f"{tag}_mlogm"]})
    expected = F.try_divide(F.col("a_pairs") * F.col("b_pairs"), choose2(F.col("total")))
    ceiling = (F.col("a_pairs") + F.col("b_pairs")) / 2
    ari = F.coalesce(F.try_divide(F.col("pairs") - expected, ceiling - expected), F.lit(1.0))
    t = F.col("total")
    ha = F.log(t) - F.col("a_mlogm") / t
    hb = F.log(t) - F.col("b_mlogm") / t
    mutual = F.log(t) + (F.col("nlogn") - F.col("a_mlogm") - F.col("b_mlogm")) / t
    nmi = F.coalesce(F.try_divide(F.greatest(mutual, F.lit(0.0)), (ha + hb) / 2), F.lit(1.0))
    fmi = _ratio(F.col("pairs"), F.sqrt(F.col("a_pairs") * F.col("b_pairs")))
    return row.select(ari.alias("ari"), nmi.alias("nmi"), fmi.alias("fmi"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pair_consistency(table: DataFrame, a: str = "true_label", b: str = "pred_label") -> DataFrame:
    """Share of same-label pairs kept together, per true label."""
    n = F.col("n").cast("double")
    per = table.groupBy(a).agg(
        F.sum(n * (n - 1) / 2).alias("kept"), F.sum(n).alias("size")
    )
    return per.select(
        a,
        F.col("size").cast("bigint").alias("size"),
        _ratio(F.col("kept"), F.col("size") * (F.col("size") - 1) / 2).alias("consistency"),
    )


def purity(table: DataFrame, a: str = "true_label", b: str = "pred_label") -> DataFrame:
    """Largest true-label share of each cluster and its complement."""
    per = table.groupBy(b).agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return per.select(
        b,
        "size",
        (F.col("top") / F.col("size")).alias("purity"),
        (1 - F.col("top") / F.col("size")).alias("contamination"),
    )


def overall_purity(table: DataFrame, b: str = "pred_label") -> DataFrame:
    per = table.groupBy(b).agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return per.agg((F.sum("top") / F.sum("size")).alias("overall_purity"))


def method_weights(labels: DataFrame, methods: list[str] = METHODS) -> DataFrame:
    """Mean agreement of each method with the others, clipped at 0, summing to 1.

    ``labels``: cell_idx, method, label. The six pairings are computed in one
    job: one wide row per cell, exploded to six (pair, label, label) rows.
    """
    wide = labels.groupBy("cell_idx").agg(
        *[F.max(F.when(F.col("method") == m, F.col("label"))).alias(f"m{i}") for i, m in enumerate(methods)]
    )
    pairs = [
        F.struct(
            F.lit(i).alias("x"), F.lit(j).alias("y"), F.col(f"m{i}").alias("a"), F.col(f"m{j}").alias("b")
        )
        for i in range(len(methods))
        for j in range(i + 1, len(methods))
    ]
    rows = wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    rows = rows.where((F.col("a") != NOISE) & (F.col("b") != NOISE))
    cells = rows.groupBy("x", "y", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = materialize(cells)

    def c2(c):
        return c * (c - 1) / 2

    joint = cells.groupBy("x", "y").agg(F.sum(c2(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    left = cells.groupBy("x", "y", "a").agg(F.sum("n").alias("m")).groupBy("x", "y").agg(F.sum(c2(F.col("m"))).alias("sa"))
    right = cells.groupBy("x", "y", "b").agg(F.sum("n").alias("m")).groupBy("x", "y").agg(F.sum(c2(F.col("m"))).alias("sb"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), c2(F.col("t")))
    ari = F.coalesce(
        F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)
    )
    scored = joint.join(left, ["x", "y"]).join(right, ["x", "y"]).select("x", "y", ari.alias("ari"))
    both = scored.select(F.explode(F.array("x", "y")).alias("m"), "ari")
    raw = both.groupBy("m").agg(F.greatest(F.sum("ari") / (len(methods) - 1), F.lit(0.0)).alias("raw"))
    raw = materialize(raw)
    if not (raw.agg(F.sum("raw")).first()[0] or 0) > 0:
        raise ValueError("no method agrees with another: all weights are 0")
    whole = raw.agg(F.sum("raw")).scalar()
    name = F.element_at(F.array(*[F.lit(m) for m in methods]), F.col("m") + 1)
    return raw.select(name.alias("method"), (F.col("raw") / F.nullif(whole, F.lit(0.0))).alias("weight"))


def matched_accuracy(table: DataFrame, a: str = "true_label", b: str = "pred_label") -> float:
    """Accuracy under the best one-to-one matching of labels.

    The contingency table has labels x labels entries, not cells, so the
    assignment is solved on the driver.
    """
    rows = table.collect()
    truth = sorted({r[a] for r in rows})
    pred = sorted({r[b] for r in rows})
    size = max(len(truth), len(pred))
    gain = np.zeros((size, size))
    for r in rows:
        gain[truth.index(r[a]), pred.index(r[b])] = r["n"]
    chosen = best_assignment(gain.max() - gain)
    return float(sum(gain[i, j] for i, j in enumerate(chosen)) / gain.sum())


def best_assignment(cost: np.ndarray) -> list[int]:
    """Minimum-cost perfect matching (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        slack = np.full(n + 1, np.inf)
        via = np.zeros(n + 1, dtype=int)
        done = np.zeros(n + 1, dtype=bool)
        j = 0
        while owner[j]:
            done[j] = True
            row = owner[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            via[1:][better] = j
            open_slack = np.where(done[1:], np.inf, slack[1:])
            nxt = int(np.argmin(open_slack)) + 1
            delta = open_slack[nxt - 1]
            u[owner[done]] += delta
            v[done] -= delta
            slack[1:][~done[1:]] -= delta
            j = nxt
        while j:
            owner[j] = owner[via[j]]
            j = via[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out
