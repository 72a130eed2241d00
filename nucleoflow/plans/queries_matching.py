"""Registered queries: matching, guards, network filters, figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O
from nucleoflow.operators import annotate, graph, matching
from nucleoflow.plans import proxies as P
from nucleoflow.plans.oracle_base import r6 as R
from nucleoflow.plans.registry import query, rounded


@query(
    "symbol_fallback",
    """SELECT s.s_name AS name, p.id FROM (SELECT DISTINCT s_name FROM supplier) s JOIN
       (SELECT 'part' || p_partkey AS raw, 'Supplier#' || lpad((p_partkey % 500)::VARCHAR, 9, '0') AS name, p_partkey AS id FROM part) p ON p.name = s.s_name""",
)
def symbol_fallback(spark, d):
    part = P.table(spark, d, "part").select(F.concat(F.lit("part"), "p_partkey").alias("name"), F.col("p_partkey").alias("id"))
    symbol = F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 500).cast("string"), 9, "0"))
    names = P.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return matching.common_names(names, part, part.select("name", symbol.alias("symbol"))).select("name", "id")


@query("require_counts", "SELECT l_orderkey AS id, l_quantity AS value FROM lineitem")
def require_counts(spark, d):
    li = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("rna").alias("modality"), F.col("l_quantity").alias("value"))
    return matching.require_counts(li, "rna").select("id", "value")


@query(
    "match_cells",
    """SELECT cell, (row_number() OVER (ORDER BY cell) - 1)::BIGINT AS place, a AS first_at, b AS second_at FROM
       (SELECT c_name AS cell, min(c_custkey) AS a FROM customer GROUP BY 1) JOIN
       (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS cell, min(o_orderkey) AS b FROM orders GROUP BY 1) USING (cell)""",
)
def match_cells(spark, d):
    first = P.table(spark, d, "customer").select(F.col("c_name").alias("cell"), F.col("c_custkey").alias("at"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    second = P.table(spark, d, "orders").select(name.alias("cell"), F.col("o_orderkey").alias("at"))
    return matching.match_cells(first, second)


@query(
    "factor_time_points",
    f"SELECT l_suppkey AS tf, {R('arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber)')} AS time_point FROM lineitem GROUP BY 1",
)
def factor_time_points(spark, d):
    li = P.table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("tf"), F.col("l_extendedprice").alias("time_point"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return rounded(matching.time_points(rows), "time_point")


_COLOURS = ["red", "green", "blue", "grey"]


@query(
    "category_colours",
    """SELECT category, position, ['red', 'green', 'blue', 'grey'][(position % 4 + 1)::INT] AS colour FROM
       (SELECT p_type AS category, (row_number() OVER (ORDER BY p_type) - 1)::BIGINT AS position FROM (SELECT DISTINCT p_type FROM part))""",
)
def category_colours(spark, d):
    return matching.categories(P.table(spark, d, "part"), "p_type", _COLOURS)


@query("largest_by_text", "SELECT p_name, p_size FROM part ORDER BY p_size DESC, p_name LIMIT 50")
def largest_by_text(spark, d):
    part = P.table(spark, d, "part").select("p_name", F.col("p_size").alias("p_size"))
    kind = dict(part.dtypes)["p_size"]
    return matching.largest(part, "p_size", "p_name", 50).withColumn("p_size", F.col("p_size").cast(kind))


@query(
    "text_tie_order",
    "SELECT c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC, c_name) AS pos FROM customer",
)
def text_tie_order(spark, d):
    c = P.table(spark, d, "customer").select("c_name", "c_mktsegment", F.col("c_nationkey").cast("double").alias("v"))
    return O.dense_order(c, "v", "c_name", "pos", ["c_mktsegment"], fixed=True).select("c_name", "pos")


_FLOWS = """flows AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::DOUBLE AS weight FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def flows(spark, d):
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = P.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.join(o, "l_orderkey").join(s, "l_suppkey").join(c, "o_custkey")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("network_filter", f"WITH {_FLOWS} SELECT src, dst, weight FROM flows WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def network_filter(spark, d):
    n = P.table(spark, d, "nation").select(F.col("n_nationkey").alias("name"), "n_regionkey")
    return graph.filter_network(flows(spark, d), n.where("n_regionkey = 1"), n.where("n_regionkey = 2"))


@query("network_isolates", "SELECT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey <> o_custkey)")
def network_isolates(spark, d):
    nodes = P.table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    edges = P.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return graph.drop_isolates(nodes, edges)


@query(
    "weighted_closeness",
    f"""WITH RECURSIVE {_FLOWS}, step AS (SELECT src, dst, 1000.0::DOUBLE / weight AS w FROM flows),
        walk(s, v, dist, hops) AS (SELECT src, src, 0.0::DOUBLE, 0 FROM step UNION SELECT s, dst, dist, hops FROM
        (SELECT k.s, e.dst, min(k.dist + e.w) AS dist, k.hops + 1 AS hops FROM walk k JOIN step e ON e.src = k.v WHERE k.hops < 5 GROUP BY k.s, e.dst, k.hops)),
        best AS (SELECT s, v, min(dist) AS dist FROM walk GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM (SELECT src FROM step UNION SELECT dst FROM step))
        SELECT v AS node, {R('coalesce((count(*) - 1) / nullif(sum(dist), 0) * (count(*) - 1) / (max(n) - 1), 0)')} AS closeness FROM best, n GROUP BY 1""",
)
def weighted_closeness(spark, d):
    e = flows(spark, d).withColumn("weight", F.lit(1000.0) / F.col("weight"))
    return rounded(graph.closeness(e), "closeness")


@query(
    "components_by_status",
    "SELECT node, min(node) OVER (PARTITION BY node % 7) AS component FROM (SELECT DISTINCT c_custkey AS node FROM customer)",
)
def components_by_status(spark, d):
    """Seven components: each customer is joined to the one seven places on, or the last ones to the first."""
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("src")).distinct()
    edges = c.join(c.select((F.col("src") - 7).alias("_"), F.col("src").alias("dst")), F.col("src") == F.col("_")).select("src", "dst")
    return graph.components(edges)


@query(
    "message_tokens",
    """SELECT conv_id, sum(greatest(0, floor(len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '\\p{L}')) * 0.5
       + len(regexp_extract_all(text, '\\p{Nd}')) * 0.5 + len(regexp_extract_all(text, '[^\\p{L}\\p{Nd}\\s]')) * 0.3)))::BIGINT AS tokens FROM conversations GROUP BY 1""",
)
def message_tokens(spark, d):
    t = P.table(spark, d, "conversations")
    return t.groupBy("conv_id").agg(F.sum(annotate.token_estimate(F.col("text"))).alias("tokens"))
