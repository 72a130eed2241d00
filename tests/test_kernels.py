import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleoflow.operators import (
    community,
    consensus,
    drivers,
    embed,
    gam,
    graph,
    hierarchy,
    neighbors,
    spanning,
    tiles,
)
from nucleoflow.operators.spline import fit_curve


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in np.atleast_1d(r)]) for i, r in enumerate(x)], "id bigint, vec array<double>")


def labels_of(df, col="label"):
    return [r[col] for r in df.orderBy("id").collect()]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def brute_tree(d):
    pairs = sorted((d[i, j], i, j) for i, j in itertools.combinations(range(len(d)), 2))
    root = list(range(len(d)))
    out = []
    for w, i, j in pairs:
        a, b = root[i], root[j]
        if a != b:
            root = [a if r == b else r for r in root]
            out.append((i, j, w))
    return out


def test_tree_clusters_small(spark):
    labels, curve = spanning.tree_clusters(points(spark, [0, 1, 2, 10, 11, 12]), "id", 2)
    assert labels_of(labels) == [0, 0, 0, 1, 1, 1] and curve == [24.0]


def test_tree_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 16)
    x = np.random.default_rng(3).integers(0, 6, (45, 2)).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tree = spanning.spanning_tree(points(spark, x), "id")
    assert sorted((r.u, r.v, r.dist) for r in tree.collect()) == sorted(brute_tree(d))


def plain_levels(edges):
    """Round in which taking away all leaves at once reaches each edge."""
    left, out, step = set(edges), {}, 0
    while left:
        step += 1
        degree = Counter(x for e in left for x in e)
        gone = {e for e in left if 1 in (degree[e[0]], degree[e[1]])}
        out |= dict.fromkeys(gone, step)
        left -= gone
    return out


@pytest.mark.parametrize("block", [1 << 16, 5])
def test_cutting_matches_peeling(spark, monkeypatch, block):
    x = np.random.default_rng(5).standard_normal((14, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tree = spark.createDataFrame([(int(i), int(j), float(w)) for i, j, w in brute_tree(d)], "u bigint, v bigint, dist double").cache()
    monkeypatch.setattr(spanning, "BLOCK_ARCS", block)
    forest, scores = spanning.cut_tree(tree, 5)
    left, want = [tuple(r) for r in tree.collect()], []
    for _ in range(4):
        level = plain_levels([(u, v) for u, v, _ in left])
        best = max(left, key=lambda e: (level[e[:2]] * e[2], -e[2], -e[0], -e[1]))
        want.append(level[best[:2]] * best[2])
        left.remove(best)
    assert np.allclose(scores, want)
    assert sorted(tuple(r) for r in forest.collect()) == sorted(left)


def test_line_clusters(spark):
    values = [0, 1, 2, 10, 11, 12, 30, 31]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    out, curve = spanning.line_clusters(df, "x", 2)
    got = {r.x: r.label for r in out.collect()}
    assert curve == [36.0] and [got[v] for v in values] == [0] * 6 + [1] * 2


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a, b in itertools.combinations(range(len(groups)), 2):
            ca, cb = x[groups[a]].mean(0), x[groups[b]].mean(0)
            na, nb = len(groups[a]), len(groups[b])
            h = 2 * na * nb / (na + nb) * ((ca - cb) ** 2).sum()
            if best is None or h < best[0]:
                best = (h, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    out = np.zeros(len(x), int)
    for g, members in enumerate(groups):
        out[members] = g
    return out


@pytest.mark.parametrize("block", [1024, 6])
def test_ward(spark, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    x = np.random.default_rng(1).standard_normal((24, 2))
    assert same_partition(labels_of(hierarchy.ward_clusters(points(spark, x), "id", 4)), brute_ward(x, 4))


@pytest.mark.parametrize("order", [None, "at"])
def test_knn(spark, monkeypatch, order):
    monkeypatch.setattr(tiles, "TILE_ROWS", 8)
    rng = np.random.default_rng(2)
    x = np.sort(rng.standard_normal(60))
    p = points(spark, np.column_stack([x, x**2])).withColumn("at", F.col("id"))
    q = rng.standard_normal((20, 2))
    out = neighbors.knn(points(spark, q), p, 3, "id", "id", point_order=order)
    d = np.sqrt(((q[:, None] - np.column_stack([x, x**2])[None]) ** 2).sum(-1))
    got = {(r.id, r.nn_rank): r.neighbor for r in out.collect()}
    assert all(got[i, k + 1] == int(np.argsort(d[i])[k]) for i in range(20) for k in range(3)) and len(got) == 60


def test_communities(spark):
    e = [(a, b, 1.0) for g in (0, 5) for a, b in itertools.combinations(range(g, g + 5), 2)] + [(0, 5, 1.0)]
    edges = spark.createDataFrame(e, "src bigint, dst bigint, weight double")
    nodes = spark.range(11).withColumnRenamed("id", "node")
    out = community.louvain(edges, nodes, [1.0]).withColumnRenamed("node", "id")
    got = labels_of(out)
    assert same_partition(got, [0] * 5 + [1] * 5 + [2])


def modularity(w, label, resolution):
    same = label[:, None] == label[None, :]
    k = w.sum(1)
    return (w[same].sum() - resolution * np.outer(k, k)[same].sum() / w.sum()) / w.sum()


@pytest.mark.parametrize("block", [4096, 9])
def test_communities_settle(spark, monkeypatch, block):
    """No move of one node to any other community, or to its own, raises the modularity; communities are connected."""
    monkeypatch.setattr(community, "BLOCK_NODES", block)
    rng = np.random.default_rng(4)
    group = np.arange(24) % 3
    w = np.triu((rng.random((24, 24)) < np.where(group[:, None] == group[None, :], 0.4, 0.08)) * rng.uniform(0.5, 1, (24, 24)), 1)
    w += w.T
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(np.triu(w)))], "src bigint, dst bigint, weight double")
    nodes = spark.range(24).withColumnRenamed("id", "node")
    out = community.louvain(edges, nodes, [0.5, 1.0]).cache()
    for resolution in (0.5, 1.0):
        label = np.array(labels_of(out.where(F.col("resolution") == resolution).withColumnRenamed("node", "id")))
        top = modularity(w, label, resolution)
        assert resolution != 1.0 or top > modularity(w, group, 1.0) - 0.02
        for i in range(24):
            for c in {*label.tolist(), -1}:
                moved = label.copy()
                moved[i] = c
                assert modularity(w, moved, resolution) <= top + 1e-9
        for c in set(label.tolist()):
            inside = np.flatnonzero(label == c)
            reach = np.linalg.matrix_power((w[np.ix_(inside, inside)] > 0) + np.eye(inside.size), inside.size)
            assert (reach > 0).all() and c == inside.min()
    assert [tuple(r)[1:] for r in community.stability(edges, out).collect()] == [(24, 0, 0)] * 2


def test_resolution_choice():
    grid = [(0.3, 5), (0.4, 6), (0.5, 6), (0.6, 6), (0.7, 9)]
    assert [community.pick_resolution(grid, t) for t in (6, 8, 7)] == [0.5, 0.7, 0.4]


def test_consensus_fixture(spark):
    rows = [(0, "Kmeans", 0, 0), (0, "Kmeans", 1, 0), (0, "Kmeans", 2, 1), (1, "Kmeans", 0, 0), (1, "Kmeans", 1, 1)]
    out = consensus.co_clustering(spark.createDataFrame(rows, "iter int, method string, cell_idx bigint, label int"))
    assert {(r.i, r.j): r.value for r in out.collect()} == {(0, 1): 0.5, (0, 2): 0.0, (1, 2): 0.0}


def test_assignment():
    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.integers(0, 20, (5, 5)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
        chosen = consensus.best_assignment(c)
        assert sorted(chosen) == list(range(5)) and sum(c[i, j] for i, j in enumerate(chosen)) == best


def test_betweenness_and_closeness(spark):
    e = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (2, 3, 1.0), (0, 3, 3.0), (3, 0, 2.0)]
    edges = spark.createDataFrame(e, "src bigint, dst bigint, weight double")
    got = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    adj = {}
    for a, b, w in e:
        adj.setdefault(a, {})[b] = w
    want = dict.fromkeys(range(4), 0.0)
    for s, t in itertools.permutations(range(4), 2):
        paths = []
        for r in range(3):
            for mid in itertools.permutations([v for v in range(4) if v not in (s, t)], r):
                p = (s, *mid, t)
                if all(b in adj.get(a, {}) for a, b in zip(p, p[1:])):
                    paths.append((sum(adj[a][b] for a, b in zip(p, p[1:])), p))
        short = [p for w, p in paths if w == min(paths)[0]]
        for v in range(4):
            want[v] += sum(v in p[1:-1] for p in short) / len(short) / 6
    assert all(abs(got[v] - want[v]) < 1e-12 for v in want) and max(want.values()) > 0


def test_normal_equations_equal_dense_fit(spark):
    rng = np.random.default_rng(4)
    t = rng.random(300)
    y = np.sin(4 * t) + 0.1 * rng.standard_normal(300)
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "cell_id bigint, pseudotime double")
    act = spark.createDataFrame([(i, "A", float(v)) for i, v in enumerate(y)] + [(i, "B", 1.0) for i in range(300)], "cell_id bigint, TF string, activity double")
    basis = gam.make_basis(cells)
    out = {r.TF: r for r in gam.smooth_per_group(gam.normal_equations(act, gam.basis_rows(cells, basis), "activity"), basis).collect()}
    assert out["A"].deviance_explained > 0.9 and out["A"].gam_pvalue < 1e-6 and out["B"].gam_pvalue == 1 and out["B"].Amp is None
    grid = np.linspace(t.min(), t.max(), 100)
    assert np.abs(np.array(out["A"].curve) - np.sin(4 * grid)).max() < 0.15


def test_program_equations_with_implicit_cells(spark):
    rng = np.random.default_rng(6)
    n, genes = 60, [f"g{i}" for i in range(12)]
    x = rng.poisson(0.15, (n, 12)).astype(float)
    expr = spark.createDataFrame([(i, genes[j], float(x[i, j])) for i in range(n) for j in range(12) if x[i, j]], "cell_id bigint, gene string, value double")
    cells = spark.createDataFrame([(i, i / n) for i in range(n)], "cell_id bigint, pseudotime double")
    act = spark.createDataFrame([(i, "A", float(np.cos(i / 9))) for i in range(n)], "cell_id bigint, TF string, activity double")
    used = [g for j, g in enumerate(genes) if x[:, j].sum()]
    targets = spark.createDataFrame([("A", g) for g in used], "tf string, gene string")
    out = gam.program_couple(expr, act, cells, targets).first()
    cols = [j for j, g in enumerate(genes) if g in used]
    z = (x[:, cols] - x[:, cols].mean(0)) / x[:, cols].std(0)
    dense = spark.createDataFrame([(i, "A", float(v)) for i, v in enumerate(z.mean(1))], "cell_id bigint, TF string, s double")
    basis = gam.make_basis(cells)
    rows = gam.basis_rows(cells, basis)
    a = gam.smooth_per_group(gam.normal_equations(act, rows, "activity"), basis).first().curve
    s = gam.smooth_per_group(gam.normal_equations(dense, rows, "s"), basis).first().curve
    assert out.status == "ok" and abs(out.ProgramCouple - abs(np.corrcoef(a, s)[0, 1])) < 1e-6


def test_svd_and_projection(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((40, 15)) @ np.diag(np.linspace(5, 0.5, 15))
    rows = spark.createDataFrame([(i, list(range(15)), [float(v) for v in r]) for i, r in enumerate(x)], "cell_id bigint, i array<int>, x array<double>")
    mean = x.mean(0)
    sigma, load = embed.truncated_svd(rows, 15, 3, mean)
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    assert np.allclose(sigma, s[:3], rtol=1e-6) and np.allclose(np.abs(load), np.abs(vt[:3].T), atol=1e-4)
    got = np.array([r.vec for r in embed.project(rows, load, mean).orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-3)


def test_joint_embedding_correlations(spark):
    rng = np.random.default_rng(8)
    z = rng.standard_normal((200, 2))
    x = np.column_stack([z + 0.3 * rng.standard_normal((200, 2)), rng.standard_normal((200, 3))])
    y = np.column_stack([z + 0.3 * rng.standard_normal((200, 2)), rng.standard_normal((200, 3))])
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "cell_id bigint, x array<double>, y array<double>")
    scores, tests = embed.joint_embedding(df)
    t = tests.orderBy("dim").collect()
    assert t[0].correlation > 0.9 and t[1].correlation > 0.85 and sum(r.kept for r in t) == 4
    assert len(scores.first().vec) == 4 and scores.count() == 200


def test_rank_aggregation_fixture(spark):
    # Four factors; the first is in two lists at position 1 and in none of the third.
    two = spark.createDataFrame([("a", 1), ("b", 2)], "TF string, rank int")
    third = spark.createDataFrame([("c", 1)], "TF string, rank int")
    universe = spark.createDataFrame([(x,) for x in "abcd"], "TF string")
    out = drivers.robust_rank_aggregation({"x": two, "y": two, "z": third}, universe, correction=False)
    got = {r.TF: r.RRA_pvalue for r in out.collect()}
    assert abs(got["a"] - 0.15625) < 1e-12 and "d" not in got


def test_driver_rules(spark):
    rows = [(i, f"t{i}", 0.9, i, i, i, 0.5, 20) for i in range(1, 41)]
    rows[0] = (1, "t1", 0.01, 1, 2, 30, 0.5, 20)
    df = spark.createDataFrame(rows, "rank int, TF string, RRA_FDR double, NetworkSupport_rank int, ActDyn_rank int, ProgramCouple_rank int, ProgramCouple double, target_program_n_targets int")
    got = {r.TF: r for r in drivers.assign_driver_classes(df).collect()}
    assert got["t1"].driver_class == "hub_like_network_driven" and not got["t1"].is_high_confidence_driver and got["t1"].n_top25_metrics == 2
    assert got["t2"].driver_class == "high_priority_dynamic_coupled" and got["t30"].driver_class == "other"


def test_curve_follows_points(spark):
    t = np.linspace(0, 3, 200)
    df = spark.createDataFrame([(float(v), [float(np.sin(v)), float(v)]) for v in t], "time double, vec array<double>")
    curve = fit_curve(df, "time", 2, dof=50, spar=1e-6)
    assert np.abs(curve(t) - np.column_stack([np.sin(t), t])).max() < 0.01


def test_graph_guards_and_filters(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 5.0), ("d", "d", 1.0)], "src string, dst string, weight double")
    near = {r.node: r.closeness for r in graph.closeness(e).collect()}
    assert np.isclose(near["c"], 2 / 5 * 2 / 3) and near["a"] == 0
    bad = e.union(spark.createDataFrame([("c", "a", -1.0)], e.schema))
    with pytest.raises(ValueError, match="negative"):
        graph.shortest_paths(bad)
    zero = e.union(spark.createDataFrame([("c", "b", 0.0)], e.schema))
    with pytest.raises(ValueError, match="non-positive"):
        graph.betweenness(zero)
    with pytest.raises(RuntimeError):
        graph.pagerank(e, iterations=1, tolerance=1e-12)
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    assert graph.filter_network(e, names).count() == 2 and graph.filter_network(e, names, names).count() == 0
    assert {r.node for r in graph.drop_isolates(graph.nodes(e), e).collect()} == {"a", "b", "c"}


def test_weighted_consensus_over_all_cells(spark):
    from nucleoflow.operators import ensemble

    rows = [(0, m, c, g) for m in ("Kmeans", "Seurat") for c, g in enumerate([0, 0, 1, 1])]
    rows += [(0, "ACM_WEP", c, g) for c, g in enumerate([0, 1, 0, 1])]
    labels = spark.createDataFrame(rows, "iter int, method string, cell_idx bigint, label int")
    cells = spark.range(5).withColumnRenamed("id", "cell_idx")
    weights = {"Kmeans": 0.5, "Seurat": 0.5, "ACM_WEP": 0.0}
    out, _ = ensemble.final_labels(labels, 3, cells, weights)
    got = {r.cell_idx: r.label for r in out.collect()}
    assert len(got) == 5 and same_partition([got[i] for i in range(5)], [0, 0, 1, 1, 2])
    out, _ = ensemble.final_labels(labels, 3, cells, {"ACM_WEP": 1.0})
    got = {r.cell_idx: r.label for r in out.collect()}
    assert same_partition([got[i] for i in range(5)], [0, 1, 0, 1, 2])
    with pytest.raises(ValueError):
        ensemble.final_labels(labels, 3, cells, {"Kmeans": 0.0})


def test_resumed_ensemble_runs_nothing_twice(spark, tmp_path, monkeypatch):
    from nucleoflow.operators import ensemble

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((12, 2)) + s for s in (0, 12)])
    calls = []
    base = ensemble.base_labels
    monkeypatch.setattr(ensemble, "base_labels", lambda *a: calls.append(1) or base(*a))
    args = (points(spark, x), "id", 2, 1, str(tmp_path))
    first = sorted(map(tuple, ensemble.run(*args, resolution=0.5, n_neighbors=5).collect()))
    again = sorted(map(tuple, ensemble.run(*args, resolution=0.5, n_neighbors=5).collect()))
    assert first == again and len(calls) == 1


def test_tf_deviations_draws_the_default_number_of_sets(spark, monkeypatch):
    import inspect

    from nucleoflow.operators import motif
    from nucleoflow.plans import catalog

    drawn, plain = [], inspect.signature(motif.deviations)

    def noted(*args, **more):
        call = plain.bind(*args, **more)
        call.apply_defaults()
        drawn.append(call.arguments["n_sets"])
        return spark.createDataFrame([(1, 1, 0.0, 0.0)], "cell_id long, tf long, deviation double, z double")

    monkeypatch.setattr(motif, "deviations", noted)
    catalog.QUERIES["tf_deviations"](spark, "/root/testdata/sf0.001")
    assert drawn == [plain.parameters["n_sets"].default]
