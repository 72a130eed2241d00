"""Registered queries: network assembly and driver ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O
from nucleoflow.operators import drivers, exports, gam, graph, grn, plotdata
from nucleoflow.plans import pipelines
from nucleoflow.plans import proxies as P
from nucleoflow.plans import queries_qc  # noqa: F401  (shared CTEs)
from nucleoflow.plans.oracle_base import cte, r6 as R, sql
from nucleoflow.plans.registry import query, r6, rounded

cte("bcor", [], """SELECT l_suppkey AS tf, p_brand AS gene, covar_pop(l_quantity, l_extendedprice) /
    nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS correlation
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
cte("support", ["motif"], """SELECT tf, p_brand AS gene, count(*) AS n_peaks FROM motif JOIN part ON peak = p_partkey
    WHERE score > 0 GROUP BY 1, 2""")
cte("edges", ["support", "bcor"], "SELECT s.*, correlation FROM support s LEFT JOIN bcor USING (tf, gene)")
cte("weighted", ["edges"], """SELECT *, ms * es AS edge_weight FROM (SELECT *, (rank() OVER (ORDER BY n_peaks) +
    (count(*) OVER (PARTITION BY n_peaks) - 1) / 2.0) / count(*) OVER () AS ms, abs(coalesce(correlation, 0)) AS es FROM edges)""")
cte("netsup", ["weighted"], """SELECT tf AS "TF", sum(abs(edge_weight)) AS ns, sum(edge_weight) AS wo, count(DISTINCT gene) AS n_targets,
    count(*) AS n_edges, avg(edge_weight) AS me FROM weighted GROUP BY 1""")


def _edges(spark, d, threshold=None):
    return grn.infer_grn(
        P.motif_match(spark, d), P.brand_correlation(spark, d), P.brand_links(spark, d), threshold
    )


def _weighted(spark, d):
    return grn.add_edge_weights(_edges(spark, d))


@query("infer_grn", sql(["edges"], f"SELECT tf, gene, n_peaks, {R('correlation')} AS correlation FROM edges"))
def infer_grn(spark, d):
    return rounded(_edges(spark, d), "correlation")


@query("grn_threshold", sql(["edges"], f"""SELECT tf, gene, n_peaks, {R('correlation')} AS correlation FROM edges
    WHERE abs(correlation) >= 0.2"""))
def grn_threshold(spark, d):
    return rounded(_edges(spark, d, 0.2), "correlation")


@query("edge_weights", sql(["weighted"], f"""SELECT tf, gene, {R('ms')} AS motif_score, {R('es')} AS expr_score,
    {R('edge_weight')} AS edge_weight FROM weighted"""))
def edge_weights(spark, d):
    out = _weighted(spark, d).select("tf", "gene", "motif_score", "expr_score", "edge_weight")
    return rounded(out, "motif_score", "expr_score", "edge_weight")


@query("grn_network_support", sql(["netsup"], f"""SELECT "TF", {R('ns')} AS "NetworkSupport", {R('wo')} AS weighted_outdegree,
    {R('ns')} AS weighted_outdegree_abs, n_targets, n_edges, {R('me')} AS mean_edge_weight, {R('me')} AS mean_abs_edge_weight,
    row_number() OVER (ORDER BY ns DESC, "TF") AS "NetworkSupport_rank" FROM netsup"""))
def grn_network_support(spark, d):
    return rounded(
        grn.rank_network_support(_weighted(spark, d)),
        "NetworkSupport",
        "weighted_outdegree",
        "weighted_outdegree_abs",
        "mean_edge_weight",
        "mean_abs_edge_weight",
    )


@query("top_targets", sql(["weighted"], f"""SELECT tf, gene, {R('edge_weight')} AS edge_weight_abs, row_number() OVER w AS target_rank
    FROM weighted
    WINDOW w AS (PARTITION BY tf ORDER BY edge_weight DESC, es DESC, n_peaks DESC, gene) QUALIFY row_number() OVER w <= 5"""))
def top_targets(spark, d):
    return rounded(drivers.top_targets(_weighted(spark, d), 5), "edge_weight_abs")


@query("tf_activity_mean", f"""SELECT l_partkey AS cell_id, s_nationkey AS tf, {R('avg(v)')} AS activity, count(*) AS n_motifs FROM
    (SELECT l_partkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def tf_activity_mean(spark, d):
    li = P.table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("cell_id"), F.col("l_suppkey").alias("motif")
    ).agg(F.sum("l_quantity").alias("value"))
    names = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("motif"), F.col("s_nationkey").alias("tf"))
    return rounded(grn.mean_activity_by_name(li, names), "activity")


# Three rank lists over suppliers: balance, revenue, and volume for one half.
cte("l1", [], 'SELECT s_suppkey AS "TF", row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier')
cte("l2", [], 'SELECT l_suppkey AS "TF", row_number() OVER (ORDER BY round(sum(l_extendedprice), 2) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1')
cte("l3", [], """SELECT l_suppkey AS "TF", row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS rank FROM lineitem
    WHERE l_returnflag = 'A' GROUP BY 1 HAVING sum(l_quantity) % 2 = 0""")
cte("rr", ["l1", "l2", "l3"], """SELECT u.s_suppkey AS "TF", list_sort([coalesce(p1 / n, 1.0), coalesce(p2 / n, 1.0), coalesce(p3 / n, 1.0)]) AS s
    FROM supplier u LEFT JOIN (SELECT "TF" AS t1, rank() OVER (ORDER BY rank) AS p1 FROM l1) ON t1 = s_suppkey
    LEFT JOIN (SELECT "TF" AS t2, rank() OVER (ORDER BY rank) AS p2 FROM l2) ON t2 = s_suppkey
    LEFT JOIN (SELECT "TF" AS t3, rank() OVER (ORDER BY rank) AS p3 FROM l3) ON t3 = s_suppkey,
    (SELECT count(*)::DOUBLE AS n FROM supplier)""")
cte("rho", ["rr"], """SELECT "TF", least(1.0, 3 * least(3 * s[1] * pow(1 - s[1], 2) + 3 * pow(s[1], 2) * (1 - s[1]) + pow(s[1], 3),
    3 * pow(s[2], 2) * (1 - s[2]) + pow(s[2], 3), pow(s[3], 3))) AS p FROM rr""")
cte("rra", ["rho"], """SELECT "TF", p, least(1.0, min(raw) OVER (ORDER BY p, "TF" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr,
    rn AS rank FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, "TF") AS raw,
    row_number() OVER (ORDER BY round(p, 12), "TF") AS rn FROM rho)""")


def _lists(spark, d):
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("TF"), "s_acctbal")
    li = P.table(spark, d, "lineitem")
    rev = li.groupBy(F.col("l_suppkey").alias("TF")).agg(F.round(F.sum("l_extendedprice"), 2).alias("x"))
    vol = li.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("TF")).agg(F.sum("l_quantity").alias("x"))
    return {
        "NetworkSupport": O.dense_order(s, "s_acctbal", "TF", "rank").select("TF", "rank"),
        "ActDyn": O.dense_order(rev, "x", "TF", "rank").select("TF", "rank"),
        "ProgramCouple": O.dense_order(vol.where("x % 2 = 0"), "x", "TF", "rank").select("TF", "rank"),
    }


def _rra(spark, d, lists):
    universe = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("TF"))
    out = drivers.robust_rank_aggregation(lists, universe)
    # Equal sums differ in the last bits between engines; order by 12 digits.
    out = out.drop("rank").withColumn("_p", F.round("RRA_pvalue", 12))
    return O.dense_order(out, "_p", "TF", "rank", descending=False).drop("_p")


@query("rra_rank", sql(["rra"], f"""SELECT "TF", {R('p')} AS "RRA_pvalue", {R('fdr')} AS "RRA_FDR", rank FROM rra"""))
def rra_rank(spark, d):
    return rounded(_rra(spark, d, _lists(spark, d)), "RRA_pvalue", "RRA_FDR")


cte("merged", ["rra", "l1", "l2", "l3"], """SELECT r.*, l1.rank AS nr, l2.rank AS ar, l3.rank AS pr, l3.rank::DOUBLE % 10 / 10 AS pc,
    (l2.rank % 40)::INT AS tn FROM rra r LEFT JOIN l1 USING ("TF") LEFT JOIN l2 USING ("TF") LEFT JOIN l3 USING ("TF")""")
cte("classed", ["merged"], """SELECT *, coalesce((nr <= cut)::INT, 0) + coalesce((ar <= cut)::INT, 0) + coalesce((pr <= cut)::INT, 0) AS top
    FROM merged, (SELECT ceil(count(*) * 0.25) AS cut FROM merged)""")
_CLASS = """CASE WHEN coalesce(nr <= 10, false) AND (coalesce(ar > cut, false) OR coalesce(pr > cut, false) OR
    coalesce(pc < 0.1, false) OR pc IS NULL) THEN 'hub_like_network_driven'
    WHEN coalesce(fdr < 0.1 AND top >= 2 AND pc >= 0.1 AND tn >= 10, false) THEN 'top_candidate'
    WHEN coalesce(rank <= 10 AND top >= 2 AND pc >= 0.1 AND tn >= 10, false) THEN 'high_priority_dynamic_coupled' ELSE 'other' END"""


@query("driver_classes", sql(["classed"], f"""SELECT "TF", rank, nr AS "NetworkSupport_rank", ar AS "ActDyn_rank", pr AS "ProgramCouple_rank",
    {R('pc')} AS "ProgramCouple", top AS n_top25_metrics, {_CLASS} AS driver_class,
    ({_CLASS}) IN ('top_candidate', 'high_priority_dynamic_coupled') AS is_high_confidence_driver FROM classed"""))
def driver_classes(spark, d):
    lists = _lists(spark, d)
    named = {k: v.withColumnRenamed("rank", f"{k}_rank") for k, v in lists.items()}
    program = named["ProgramCouple"].withColumn(
        "ProgramCouple", F.col("ProgramCouple_rank").cast("double") % 10 / 10
    )
    act = named["ActDyn"].withColumn("target_program_n_targets", (F.col("ActDyn_rank") % 40).cast("int"))
    table = drivers.merge_metrics(_rra(spark, d, lists), named["NetworkSupport"], act, program)
    out = drivers.assign_driver_classes(table).drop("RRA_pvalue", "RRA_FDR", "target_program_n_targets")
    return rounded(out, "ProgramCouple")


@query("program_scores", sql(["rna", "weighted"], f"""WITH top AS (SELECT tf, gene FROM weighted QUALIFY row_number() OVER
    (PARTITION BY tf ORDER BY edge_weight DESC, es DESC, n_peaks DESC, gene) <= 15),
    cells AS (SELECT DISTINCT cell_id FROM rna), e AS (SELECT cell_id, p_brand AS gene, sum(value) AS value FROM rna
    JOIN part ON feature_id = p_partkey GROUP BY 1, 2),
    st AS (SELECT gene, sum(value) / n AS m, sqrt(sum(value * value) / n - pow(sum(value) / n, 2)) AS sd FROM e,
    (SELECT count(*) AS n FROM cells) GROUP BY gene, n)
    SELECT tf, c.cell_id, {R('avg((coalesce(e.value, 0) - m) / sd)')} AS program_score, count(*) AS n_targets FROM top JOIN st USING (gene)
    CROSS JOIN cells c LEFT JOIN e ON e.gene = top.gene AND e.cell_id = c.cell_id GROUP BY 1, 2""".replace("WITH top AS", "SELECT * FROM (WITH top AS", 1) + ")"))
def program_scores(spark, d):
    brand = P.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("gene"))
    expr = P.rna(spark, d).join(brand, "feature_id").groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))
    targets = drivers.top_targets(_weighted(spark, d), 15)
    out = drivers.whole_program_scores(expr, targets, expr.select("cell_id").distinct())
    return rounded(out, "program_score")


@query("gam_actdyn")
def gam_actdyn(spark, d):
    cells = O.min_max(P.cells(spark, d), "trajectory", "pseudotime").select("cell_id", "pseudotime")
    act = P.activity(spark, d).select("cell_id", F.col("feature_id").alias("TF"), F.col("value").alias("activity"))
    return gam.actdyn(act, cells)


@query("program_couple")
def program_couple(spark, d):
    brand = P.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("gene"))
    expr = P.rna(spark, d).join(brand, "feature_id").groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))
    cells = O.min_max(P.cells(spark, d), "trajectory", "pseudotime").select("cell_id", "pseudotime")
    act = P.activity(spark, d).select("cell_id", F.col("feature_id").alias("TF"), F.col("value").alias("activity"))
    return gam.program_couple(expr, act, cells, drivers.top_targets(_weighted(spark, d), 15))


@query("start_end_subset", sql(["cells"], """SELECT cell_id, CASE WHEN cell_type = s THEN 'start' ELSE 'end' END AS state FROM cells,
    (SELECT min_by(cell_type, f) AS s, max_by(cell_type, f) AS e FROM (SELECT cell_type, min(cell_id) AS f FROM cells GROUP BY 1))
    WHERE cell_type IN (s, e)"""))
def start_end_subset(spark, d):
    c = P.cells(spark, d)
    return exports.start_end_cells(c, "cell_type", "cell_id").select("cell_id", "state")


@query("ordered_states", sql(["cells"], """SELECT cell_id, cell_type, (list_position(['MACHINERY', 'BUILDING', 'FURNITURE'], cell_type) - 1)::INT
    AS state_order FROM cells WHERE cell_type IN ('MACHINERY', 'BUILDING', 'FURNITURE')"""))
def ordered_states(spark, d):
    c = P.cells(spark, d).select("cell_id", "cell_type")
    return exports.ordered_states(c, "cell_type", ["MACHINERY", "BUILDING", "FURNITURE"])


@query("network_export", sql(["edges"], f"""SELECT tf AS "TF", gene AS target, {R('correlation')} AS weight FROM edges WHERE correlation IS NOT NULL"""))
def network_export(spark, d):
    return rounded(exports.network_table(_edges(spark, d)), "weight")


@query("correlation_matrix", sql(["bcor"], "SELECT gene, " + ", ".join(
    f"""coalesce({R(f'any_value(correlation) FILTER (tf = {t})')}, 0.0) AS "{t}" """ for t in range(5)) + " FROM bcor GROUP BY gene"))
def correlation_matrix(spark, d):
    out = plotdata.correlation_matrix(P.brand_correlation(spark, d), list(range(5)))
    return rounded(out, *[str(t) for t in range(5)])


# The network as a graph: a supplier acts on parts, and part k is also factor k.
cte("ge", [], "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey")


def _graph(spark, d):
    return P.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")
    ).where("src <> dst").distinct().withColumn("weight", F.lit(1.0))


@query("degree_stats", sql(["ge"], """SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, (sum(o) + sum(i))::BIGINT AS degree FROM
    (SELECT src AS node, 1 AS o, 0 AS i FROM ge UNION ALL SELECT dst, 0, 1 FROM ge) GROUP BY 1"""))
def degree_stats(spark, d):
    return graph.degrees(_graph(spark, d))


@query("graph_density", sql(["ge"], f"""SELECT n AS n_nodes, m AS n_edges, {R('m / (n * (n - 1.0))')} AS density, {R('2.0 * m / n')} AS mean_degree FROM
    (SELECT (SELECT count(*) FROM (SELECT src FROM ge UNION SELECT dst FROM ge)) AS n, (SELECT count(*) FROM ge) AS m)"""))
def graph_density(spark, d):
    return rounded(graph.density(_graph(spark, d)), "density", "mean_degree")


cte("ug", ["ge"], "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ge")
cte("tri", ["ug"], """SELECT x.a, x.b, y.b AS c FROM ug x JOIN ug y ON x.b = y.a JOIN ug z ON z.a = x.a AND z.b = y.b""")


@query("triangles", sql(["ug", "tri"], f"""SELECT node, n_triangles, {R('CASE WHEN deg > 1 THEN 2.0 * n_triangles / (deg * (deg - 1)) ELSE 0 END')} AS clustering
    FROM (SELECT node, count(*) AS deg FROM (SELECT a AS node FROM ug UNION ALL SELECT b FROM ug) GROUP BY 1)
    JOIN (SELECT node, sum(t)::BIGINT AS n_triangles FROM (SELECT a AS node, 1 AS t FROM tri UNION ALL SELECT b, 1 FROM tri
    UNION ALL SELECT c, 1 FROM tri UNION ALL SELECT a, 0 FROM ug UNION ALL SELECT b, 0 FROM ug) GROUP BY 1) USING (node)"""))
def triangles(spark, d):
    return rounded(graph.triangles(_graph(spark, d)), "clustering")


_PR = ["""SELECT node, 1.0 / count(*) OVER () AS r FROM (SELECT src AS node FROM ge UNION SELECT dst FROM ge)"""]
cte("pr0", ["ge"], _PR[0])
cte("outd", ["ge"], "SELECT src, count(*) AS c FROM ge GROUP BY 1")
for _i in range(10):
    cte(f"pr{_i + 1}", [f"pr{_i}", "outd", "ge"], f"""SELECT p.node, 0.15 / n + 0.85 * (coalesce(s, 0) + dangling / n) AS r FROM pr{_i} p
        LEFT JOIN (SELECT dst, sum(r / c) AS s FROM ge JOIN pr{_i} ON node = src JOIN outd ON outd.src = ge.src GROUP BY 1) ON dst = p.node,
        (SELECT count(*) AS n, coalesce(sum(CASE WHEN outd.src IS NULL THEN r END), 0) AS dangling FROM pr{_i} LEFT JOIN outd ON outd.src = node)""")


@query("pagerank_fixed10", sql(["pr10"], f"SELECT node, {R('r')} AS pagerank FROM pr10"))
def pagerank_fixed10(spark, d):
    return rounded(graph.pagerank(_graph(spark, d), iterations=10), "pagerank")


@query("components", sql(["ge"], """SELECT node, min(node) OVER () AS component FROM (SELECT src AS node FROM ge UNION SELECT dst FROM ge)"""))
def components(spark, d):
    return graph.components(_graph(spark, d))


@query("centrality_table")
def centrality_table(spark, d):
    c = P.observations(spark, d).select("tf", "cell_id")
    nation = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tf"), F.col("s_nationkey").alias("src"))
    cust = P.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") + 0).alias("dst"))
    flows = c.join(nation, "tf").join(cust, "cell_id").where("src <> dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return graph.centrality(flows)


@query("circular_layout", sql(["ge"], f"""SELECT node, {R('cos(2 * pi() * (k - 1) / n)')} AS x, {R('sin(2 * pi() * (k - 1) / n)')} AS y FROM
    (SELECT node, row_number() OVER (ORDER BY node) AS k, count(*) OVER () AS n FROM (SELECT src AS node FROM ge UNION SELECT dst FROM ge))"""))
def circular_layout(spark, d):
    return rounded(plotdata.circular_layout(graph.nodes(_graph(spark, d))), "x", "y")


@query("driver_pipeline")
def driver_pipeline(spark, d):
    return pipelines.rank_drivers_from_tables(spark, d)


@query("grn_pipeline")
def grn_pipeline(spark, d):
    return pipelines.network_from_tables(spark, d)
