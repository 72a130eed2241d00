"""Network measures as joins and aggregations over (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoflow.session import materialize


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.node").alias("node")).agg(
        F.sum("e.o").alias("out_degree"),
        F.sum("e.i").alias("in_degree"),
        F.count(F.lit(1)).alias("degree"),
    )


def density(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg(F.count(F.lit(1))).scalar()
    return edges.agg(F.count(F.lit(1)).alias("n_edges")).select(
        n.alias("n_nodes"),
        "n_edges",
        F.try_divide(F.col("n_edges"), n * (n - 1)).alias("density"),
        F.try_divide(2 * F.col("n_edges"), n).alias("mean_degree"),
    )


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles and clustering coefficient per node, direction ignored.

    Every edge points from the lower to the higher degree, so a hub that holds
    most edges opens few wedges. Those of an edge travel as one array of ends.
    """
    flat = edges.where("src <> dst").select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).distinct()
    flat = materialize(flat)
    deg = flat.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("deg")
    )
    deg = materialize(deg)
    da = deg.select(F.col("node").alias("a"), F.col("deg").alias("da"))
    db = deg.select(F.col("node").alias("b"), F.col("deg").alias("db"))
    both = flat.join(da, "a").join(db, "b")
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    directed = materialize(
        both.select(
            F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"),
            F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"),
        )
    )
    above = directed.groupBy("lo").agg(F.collect_list("hi").alias("his"))
    beyond = above.select(F.col("lo").alias("hi"), F.col("his").alias("ends"))
    found = directed.join(beyond, "hi").join(above, "lo")
    found = found.select("lo", "hi", F.array_intersect("his", "ends").alias("ends"))
    entry = lambda node, n: F.struct(node.alias("node"), n.cast("bigint").alias("n"))
    corners = F.concat(
        F.array(entry(F.col("lo"), F.size("ends")), entry(F.col("hi"), F.size("ends"))),
        F.transform("ends", lambda x: entry(x, F.lit(1))),
    )
    per_node = found.select(F.inline(corners)).groupBy("node").agg(F.sum("n").alias("n_triangles"))
    out = deg.join(per_node, "node", "left").fillna(0, ["n_triangles"])
    d = F.col("deg")
    return out.select(
        "node",
        "n_triangles",
        F.when(d > 1, 2 * F.col("n_triangles") / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"),
    )


def pagerank(
    edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = None
) -> DataFrame:
    """Weighted PageRank; rank of nodes without out-edges is spread evenly.

    Runs ``iterations`` rounds, or stops once the summed change is below
    ``tolerance`` per node; with a tolerance, not to reach it raises ``RuntimeError``.
    """
    share = edges.groupBy("src").agg(F.sum("weight").alias("w"))
    links = materialize(
        edges.join(share, "src").select("src", "dst", (F.col("weight") / F.col("w")).alias("part"))
    )
    everyone = nodes(edges).join(share.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left")
    everyone = materialize(everyone)
    n = everyone.count()
    ranks = everyone.withColumn("r", F.lit(1.0 / n))
    for _ in range(iterations):
        dangling = ranks.where(F.col("has_out").isNull()).agg(F.coalesce(F.sum("r"), F.lit(0.0))).scalar()
        flow = links.join(ranks.select(F.col("node").alias("src"), "r"), "src").groupBy(
            F.col("dst").alias("node")
        ).agg(F.sum(F.col("part") * F.col("r")).alias("inflow"))
        new = (1 - damping) / n + damping * (F.coalesce("inflow", F.lit(0.0)) + dangling / n)
        nxt = materialize(
            ranks.withColumnRenamed("r", "old").join(flow, "node", "left").select("node", "has_out", "old", new.alias("r"))
        )
        if tolerance is not None:
            moved = nxt.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
            if moved < n * tolerance:
                ranks = nxt
                break
        ranks = nxt.drop("old")
    else:
        if tolerance is not None:
            raise RuntimeError(f"PageRank hasn't settled in {iterations} rounds")
    return ranks.select("node", F.col("r").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node id reachable when direction is ignored.

    Each round takes the least label among neighbours and then follows labels of
    labels, so long chains collapse quickly.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()
    both = materialize(both)
    labels = materialize(nodes(edges).select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(
            F.col("src").alias("node")
        ).agg(F.min("component").alias("m"))
        lower = materialize(
            labels.join(near, "node", "left").select(
                "node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("mid")
            )
        )
        jump = lower.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        nxt = materialize(
            lower.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component"))
        )
        changed = nxt.where(F.col("old") != F.col("component")).limit(1).count()
        labels = nxt.drop("old")
        if not changed:
            return labels


def _require_weights(edges: DataFrame, bad: str, what: str) -> None:
    found = edges.where(bad).limit(1).collect()
    if found:
        raise ValueError(f"{what} weight on the edge {found[0].src} -> {found[0].dst}")


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(s, v, dist) for every reachable pair, by relaxing changed entries only.

    A negative weight raises ``ValueError``: distances could fall for ever.
    """
    _require_weights(edges, "weight < 0", "negative")
    e = materialize(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight"))
    start = nodes(edges)
    dist = materialize(start.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("dist")))
    front = dist
    while not front.isEmpty():
        offers = front.withColumnRenamed("v", "u").join(e, "u").groupBy("s", "v").agg(
            F.min(F.col("dist") + F.col("weight")).alias("new")
        )
        merged = materialize(
            dist.join(offers, ["s", "v"], "full").select(
                "s",
                "v",
                F.least(F.coalesce("dist", "new"), F.coalesce("new", "dist")).alias("dist"),
                (F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))).alias("hit"),
            )
        )
        front = merged.where("hit").drop("hit")
        dist = merged.drop("hit")
    return dist


def betweenness(edges: DataFrame) -> DataFrame:
    """Normalised weighted betweenness from path counts and dependencies.

    Path counts grow and dependencies shrink by one tight edge per round. A
    weight of 0 or less raises ``ValueError``: tight edges could form a cycle,
    along which path counts never end.
    """
    _require_weights(edges, "weight <= 0", "non-positive")
    dist = materialize(shortest_paths(edges))
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
    du = dist.select("s", F.col("v").alias("u"), F.col("dist").alias("du"))
    tight = du.join(e, "u").join(dist, ["s", "v"]).where(
        F.abs(F.col("du") + F.col("weight") - F.col("dist")) <= 1e-9 * (1 + F.abs("dist"))
    )
    tight = materialize(tight.where("v <> s").select("s", "u", "v"))
    step = dist.where("s = v").select("s", "v", F.lit(1.0).alias("c"))
    parts = step
    while not step.isEmpty():
        step = materialize(
            step.withColumnRenamed("v", "u").join(tight, ["s", "u"]).groupBy("s", "v").agg(F.sum("c").alias("c"))
        )
        parts = parts.unionByName(step)
    sigma = materialize(parts.groupBy("s", "v").agg(F.sum("c").alias("sigma")))
    ratio = materialize(
        tight.join(sigma, ["s", "v"])
        .withColumnRenamed("sigma", "sv")
        .join(sigma.select("s", F.col("v").alias("u"), "sigma"), ["s", "u"])
        .select("s", "u", "v", (F.col("sigma") / F.col("sv")).alias("q"))
    )
    step = dist.where("s <> v").select("s", "v", F.lit(1.0).alias("x"))
    total = None
    while True:
        step = materialize(
            step.join(ratio, ["s", "v"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("x") * F.col("q")).alias("x")).where("s <> v")
        )
        if step.isEmpty():
            break
        total = step if total is None else total.unionByName(step)
    everyone = nodes(edges)
    n = everyone.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return everyone.withColumn("betweenness", F.lit(0.0))
    per = total.groupBy(F.col("v").alias("node")).agg((F.sum("x") * scale).alias("betweenness"))
    return everyone.join(per, "node", "left").fillna(0.0, ["betweenness"])


def closeness(edges: DataFrame) -> DataFrame:
    """Inward weighted closeness, scaled by the share of nodes that reach the node."""
    paths = shortest_paths(edges)
    n = nodes(edges).agg(F.count(F.lit(1))).scalar()
    per = paths.groupBy(F.col("v").alias("node")).agg(F.sum("dist").alias("d"), (F.count(F.lit(1)) - 1).alias("r"))
    value = F.try_divide(F.col("r"), F.col("d")) * F.col("r") / F.nullif(n - 1, F.lit(0))
    return per.select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def eigenvector(edges: DataFrame, iterations: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Leading eigenvector of in-links by shifted power iteration.

    Falls back to degree / (n - 1) when it has not settled.
    """
    e = materialize(edges.select("src", "dst", "weight"))
    everyone = materialize(nodes(edges))
    n = everyone.count()
    x = everyone.withColumn("x", F.lit(1.0 / n))
    for _ in range(iterations):
        flow = e.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.sum(F.col("x") * F.col("weight")).alias("f")
        )
        raw = materialize(
            x.withColumnRenamed("x", "old").join(flow, "node", "left").select(
                "node", "old", (F.col("old") + F.coalesce("f", F.lit(0.0))).alias("x")
            )
        )
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        x = raw.select("node", "old", (F.col("x") / norm).alias("x"))
        moved = x.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0]
        x = x.drop("old")
        if moved < n * tolerance:
            return x.withColumnRenamed("x", "eigenvector")
    return degrees(edges).select("node", (F.col("degree") / (n - 1)).alias("eigenvector"))


def centrality(edges: DataFrame) -> DataFrame:
    """All node measures side by side."""
    n = nodes(edges).agg(F.count(F.lit(1))).scalar()
    out = degrees(edges).withColumn("degree_centrality", F.col("degree") / F.nullif(n - 1, F.lit(0)))
    for part in (betweenness(edges), closeness(edges), eigenvector(edges), pagerank(edges, tolerance=1e-6)):
        out = out.join(part, "node")
    return out


def node_importance(measures: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Distance from the lowest corner in (z PageRank, z betweenness).

    Only nodes among ``factors`` (column ``name``) are rated, against each other; None rates all.
    """
    if factors is not None:
        measures = measures.join(factors.select(F.col("name").alias("node")).distinct(), "node", "left_semi")
    m = F.struct(
        F.avg("pagerank").alias("pm"),
        F.stddev_samp("pagerank").alias("ps"),
        F.avg("betweenness").alias("bm"),
        F.stddev_samp("betweenness").alias("bs"),
        F.min("pagerank").alias("pl"),
        F.min("betweenness").alias("bl"),
    ).alias("s")
    s = measures.agg(m).scalar()

    def above(x: str, low: str, sd: str):
        return F.coalesce((F.col(x) - s[low]) / F.nullif(s[sd], F.lit(0.0)), F.lit(0.0))

    a, b = above("pagerank", "pl", "ps"), above("betweenness", "bl", "bs")
    return measures.withColumn("importance", F.sqrt(a * a + b * b))


def filter_network(edges: DataFrame, factors: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Edges whose source is among ``factors`` and target among ``genes`` (one column ``name`` each); None keeps all."""
    for end, names in (("src", factors), ("dst", genes)):
        if names is not None:
            edges = edges.join(names.select(F.col("name").alias(end)).distinct(), end, "left_semi")
    return edges


def drop_isolates(everyone: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column ``node``) with at least one edge to another node."""
    return everyone.join(nodes(edges.where("src <> dst")), "node", "left_semi")
