"""Triangles of a hub, a clique and loose ends against all triples."""

from itertools import combinations

from nucleoflow.operators import graph


def _edges():
    clique = [(a, b) for a, b in combinations(range(8), 2)]
    hub = [(100, k) for k in range(20)]
    twice = [(1, 0), (0, 1), (5, 5), (None, 3), (3, None), (30, 31)]
    return clique + hub + twice


def test_triangles(spark):
    found = graph.triangles(spark.createDataFrame([(a, b, 1.0) for a, b in _edges()], "src bigint, dst bigint, weight double"))
    pairs = {(min(e), max(e)) for e in _edges() if None not in e and e[0] != e[1]}
    nodes = sorted({x for e in pairs for x in e})
    want = {n: 0 for n in nodes}
    for t in combinations(nodes, 3):
        if all(e in pairs for e in combinations(t, 2)):
            for n in t:
                want[n] += 1
    assert {r.node: r.n_triangles for r in found.collect()} == want
    assert dict(found.dtypes)["n_triangles"] == "bigint"


def test_wedges_travel_as_arrays(spark):
    """A row for each wedge was shuffled before."""
    found = graph.triangles(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)], "src bigint, dst bigint, weight double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any(" AND " in line for line in joins)
