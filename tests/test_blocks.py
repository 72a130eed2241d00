"""Pairs of tiles in blocks: all of them, once, and each tile sent to few blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nucleoflow.operators import consensus, drivers, grn, linking, motif, neighbors, quality, tiles


def points(spark, x, label=0):
    rows = [(i, [float(v) for v in row], int(i % 3) if label else 0) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int")


def test_block_counts():
    assert tiles.block_counts(1, 1) == (1, 1) and tiles.block_counts(41, 41) == (8, 8)
    # ten times as many tiles: as many blocks, so a tile isn't sent to more of them
    assert tiles.block_counts(401, 401) == (8, 8)
    full = tiles.block_counts(2404, 2404)
    assert full == (19, 19) and 2404 / full[0] <= tiles.BLOCK_TILES
    assert tiles.block_counts(10_000, 2)[1] == 1


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("reduced", [False, True])
def test_every_pair_once(spark, monkeypatch, upper, reduced):
    monkeypatch.setattr(tiles, "HELD_ROWS", 5)
    monkeypatch.setattr(tiles, "SIDE", 3)
    packed = tiles.pack(points(spark, np.arange(60)[:, None]), "id", {"v": F.col("vec")}, 14)
    found = tiles.dealt(packed, packed, *tiles.block_counts(14, 14))
    used = packed.count()
    assert [side.count() for side in found] == [3 * used, 3 * used]

    def kernel(row):
        i, j = np.meshgrid(row.l_k, row.r_k, indexing="ij")
        if row.l_tile == row.r_tile and upper:
            i, j = i[np.triu_indices_from(i, 1)], j[np.triu_indices_from(j, 1)]
        i, j = i.ravel(), j.ravel()
        return pd.DataFrame({"i": i, "j": j, "n": np.ones(len(i), int)})

    def added(rows):
        return rows.groupby(["i", "j"], as_index=False)["n"].sum()

    out = tiles.reduce_blocks(packed, packed, 14, 14, kernel, "i bigint, j bigint, n bigint", upper, added if reduced else None)
    assert "BroadcastExchange" not in out._jdf.queryExecution().toString()
    got = sorted((min(r.i, r.j), max(r.i, r.j)) if upper else (r.i, r.j) for r in out.collect() for _ in range(r.n))
    every = [(i, j) for i in range(60) for j in range(60) if not upper or i < j]
    assert got == every


def test_silhouette_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 4)
    x = np.random.default_rng(4).standard_normal((50, 2))
    y = np.arange(50) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {r.id: r.silhouette for r in quality.silhouette(points(spark, x, True), "id").collect()}
    for i in range(50):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_knn_ties_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 4)
    x = np.random.default_rng(6).integers(0, 3, (60, 2)).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    out = neighbors.knn(points(spark, x), points(spark, x), 5, "id", "id", exclude_self=True)
    got = {(r.id, r.nn_rank): r.neighbor for r in out.collect()}
    assert got == {(i, k + 1): j for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5].tolist())}


def test_auc_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 4)
    rng = np.random.default_rng(7)
    rows = [(i, m, c, int(rng.integers(-1, 3))) for i in range(2) for m in ("Kmeans", "Seurat") for c in range(50) if (c + i) % 5]
    labels = spark.createDataFrame(rows, "iter int, method string, cell_idx bigint, label int")
    cells = spark.range(53).withColumnRenamed("id", "cell_idx")
    weights = {"Kmeans": 0.5, "Seurat": 0.25}
    want = consensus.consensus_auc(consensus.co_clustering(labels, weights, cells)).first()
    got = consensus.consensus_auc_of(labels, weights, cells).first()
    assert got.n_pairs == want.n_pairs == 53 * 52 // 2 and got.auc == pytest.approx(want.auc)


def test_links_in_parts_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(linking, "PART", 3)
    rng = np.random.default_rng(8)
    place = rng.integers(0, 60, 40) * 10
    peaks = spark.createDataFrame([(i, "a" if i % 4 else None, int(s), int(s) + 10) for i, s in enumerate(place)], "peak bigint, chr string, start bigint, end bigint")
    genes = peaks.select((F.col("peak") + 100).alias("gene"), "chr", "start", "end", F.lit("+").alias("strand"))
    vec = [(i, rng.standard_normal(8).tolist()) for i in range(35)]
    left = spark.createDataFrame(vec, "feature_id bigint, vec array<double>")
    right = left.withColumn("feature_id", F.col("feature_id") + 100)
    want = linking.correlate_pairs(linking.band_join(peaks, genes, 100.0), left, right, "peak", "gene", 8)
    got = linking.band_tests(peaks, genes, left, right, 100.0, 8)
    key = ["peak", "gene", "chr", "distance", "Correlation", "TStat", "pvalue"]
    plain = lambda df: sorted((*r[:4], *(round(x, 9) for x in r[4:])) for r in df.select(*key).collect())
    assert plain(got) == plain(want) and len(plain(got)) > 100


def test_programs_leave_no_factor_by_cell_table(spark, monkeypatch):
    monkeypatch.setattr(tiles.tile_count, "__defaults__", (7,))
    rng = np.random.default_rng(8)
    x = rng.poisson(0.3, (30, 12)).astype(float)
    x[:, 11] = 2.0  # no spread: counts as a target, adds nothing
    expr = [(i, f"g{j}", float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]]
    expr = spark.createDataFrame([*expr, (None, "g1", 3.0), (99, "g1", 3.0)], "cell_id bigint, gene string, value double")
    cells = spark.createDataFrame([(i,) for i in range(31)], "cell_id bigint")
    wanted = {f"t{t}": [t % 11, (t + 1) % 11, (t * 5 + 3) % 11] for t in range(15)} | {"last": [11, 2], "few": [4]}
    named = [(t, f"g{j}") for t, js in wanted.items() for j in js]
    targets = spark.createDataFrame([*named, (None, "g1"), (None, "g2")], "tf string, gene string")
    scores = drivers.program_scores(expr, targets, cells, 2)
    # nothing groups or joins the scores once tiles have met
    assert scores._jdf.queryExecution().optimizedPlan().nodeName() == "FlatMapCoGroupsInPandas"
    got = {(r.tf, r.cell_id): r for r in scores.collect()}
    full = np.vstack([x, np.zeros(12)])
    sd = full.std(0)
    z = (full - full.mean(0)) / np.where(sd > 0, sd, 1.0)
    want = {(t, i): z[i, js].mean() for t, js in wanted.items() if len(js) > 1 for i in range(30) if x[i, js].any()}
    assert got.keys() == want.keys()
    assert all(abs(got[k].program_score - v) < 1e-9 and got[k].n_targets == len(wanted[k[0]]) for k, v in want.items())
    rows = cells.selectExpr("cell_id", "array(1D, double(cell_id)) AS b")
    for r in drivers.program_sums(expr, targets, cells, rows, 2, 2).collect():
        s = z[:, wanted[r.TF]].mean(1)
        assert np.allclose([r.yy, r.sy, *r.xy], [s @ s, s.sum(), s.sum(), s @ np.arange(31)])


def test_programs_of_every_cell_and_factor(spark, monkeypatch):
    monkeypatch.setattr(tiles.tile_count, "__defaults__", (7,))
    rng = np.random.default_rng(9)
    x = rng.poisson(0.2, (30, 12)).astype(float)
    x[:, 11] = 2.0
    x[5] = 0.0  # one row in the table, of a gene that is no target
    x[29, 0] = 4.0  # stored under a null cell
    ids = [*range(29), None]
    expr = [(ids[i], f"g{j}", float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]]
    expr = spark.createDataFrame([*expr, (5, "other", 1.0)], "cell_id bigint, gene string, value double")
    wanted = {f"t{t}": [t % 11, (t + 1) % 11, (t * 5 + 3) % 11] for t in range(15)} | {"few": [4], None: [1, 2]}
    targets = spark.createDataFrame([(t, f"g{j}") for t, js in wanted.items() for j in js], "tf string, gene string")
    rows = drivers.whole_program_scores(expr, targets, expr.select("cell_id").distinct()).collect()
    got = {(r.tf, r.cell_id): r for r in rows}
    sd = x.std(0)
    x_of = np.where(np.arange(30)[:, None] == 29, 0.0, x)  # no one cell has what a null cell stores
    z = (x_of - x.mean(0)) / np.where(sd > 0, sd, np.inf)
    assert len(rows) == len(got) and got.keys() == {(t, c) for t in wanted for c in ids}
    for (t, c), r in got.items():
        assert abs(r.program_score - z[29 if c is None else c, wanted[t]].mean()) < 1e-9 and r.n_targets == len(wanted[t])


def test_deviations_from_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(motif, "BLOCK_CELLS", 7)
    rng = np.random.default_rng(3)
    x = rng.poisson(0.6, (20, 30)).astype(float)
    counts = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(20) for j in range(30) if x[i, j]], "cell_id bigint, peak bigint, value double")
    bound = {t: sorted(rng.choice(30, 9, replace=False).tolist()) for t in "abc"}
    match = spark.createDataFrame([(t, j, 1.0) for t, js in bound.items() for j in js] + [("a", 0, 0.0)], "tf string, peak bigint, score double")
    peaks = spark.createDataFrame([(j, float(j % 5), float(x[:, j].sum())) for j in range(30)], "peak bigint, gc double, depth double")
    out = motif.deviations(counts, match, peaks, 6)
    # what is seen of a set stays in the task that takes the factor and the block of cells
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.tf, r.cell_id): r for r in out.collect()}
    back = {}
    for r in motif.background_peaks(peaks, 6).collect():
        back.setdefault(r.set, {})[r.peak] = r.background

    def off(js):
        expected = x.sum(1) * x[:, js].sum() / x.sum()
        return np.divide(x[:, js].sum(1) - expected, expected, out=np.zeros(20), where=expected > 0)

    cells = [i for i in range(20) if x[i].any()]
    assert got.keys() == {(t, i) for t in bound for i in cells}
    for t, js in bound.items():
        d = np.stack([off([back[s][j] for j in js]) for s in range(6)])
        raw, z = off(js) - d.mean(0), (off(js) - d.mean(0)) / d.std(0, ddof=1)
        assert all(abs(got[t, i].deviation - raw[i]) < 1e-9 and abs(got[t, i].z - z[i]) < 1e-6 for i in cells)


def test_pairs_leave_from_stored_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 4)
    monkeypatch.setattr(tiles.tile_count, "__defaults__", (4,))
    monkeypatch.setattr(tiles, "READ_TILES", 2)
    x = np.random.default_rng(10).standard_normal((31, 6))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(31)], "feature_id bigint, vec array<double>")
    found = grn.correlation_blocks(rows.where("feature_id < 9"), rows, "tf", "gene", 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # no side is copied or sent to all
    got = {(r.tf, r.gene): r.correlation for r in found.collect()}
    want = np.corrcoef(x)
    assert got.keys() == {(i, j) for i in range(9) for j in range(31)}
    assert all(abs(r - want[k]) < 1e-9 for k, r in got.items())
