"""Registered queries: labels, annotation, markers, text rules, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from nucleoflow.functions import strings as S
from nucleoflow.operators import annotate, markers, normalize
from nucleoflow.plans import proxies as P
from nucleoflow.plans import queries_qc  # noqa: F401  (shared CTEs)
from nucleoflow.plans.oracle_base import cte, r6 as R, sql
from nucleoflow.plans.registry import query, rounded

# Metadata lists customers of some segments under a bare name; cells carry a suffix.
cte("meta", [], """SELECT c_name AS barcode, c_mktsegment AS celltype FROM customer WHERE c_mktsegment <> 'BUILDING'""")


def _meta(spark, d):
    c = P.table(spark, d, "customer")
    return c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("barcode"), F.col("c_mktsegment").alias("celltype"))


@query("label_fallback_join", sql(["meta"], """SELECT n.name, coalesce(a.celltype, b.celltype, 'Unknown') AS celltype FROM
    (SELECT CASE WHEN c_acctbal < 5000 THEN c_name ELSE c_name || '-1' END AS name FROM customer) n
    LEFT JOIN meta a ON a.barcode = n.name LEFT JOIN meta b ON b.barcode = regexp_replace(n.name, '-1$', '')"""))
def label_fallback_join(spark, d):
    c = P.table(spark, d, "customer")
    names = c.select(F.when(F.col("c_acctbal") < 5000, F.col("c_name")).otherwise(F.concat("c_name", F.lit("-1"))).alias("name"))
    return annotate.label_with_fallback(names, _meta(spark, d), "barcode", "celltype")


@query("label_load", """SELECT trim(' ' || user_id || ' ') AS barcode, coalesce(nullif(trim(min_by(CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END, event_id)), ''),
    'Unknown') AS celltype FROM events GROUP BY 1""")
def label_load(spark, d):
    e = P.table(spark, d, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("barcode"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("celltype"),
        "event_id",
    )
    return annotate.clean_labels(e, "barcode", "celltype", "event_id")


@query("cluster_label_join", """SELECT c_custkey AS cell_id, coalesce(r_name, 'Unknown') AS cell_type FROM customer
    LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3 LEFT JOIN region ON r_regionkey = n_regionkey""")
def cluster_label_join(spark, d):
    cells = P.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("n_nationkey"))
    names = P.table(spark, d, "nation").where("n_regionkey < 3").join(
        P.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    return cells.join(names.select("n_nationkey", "r_name"), "n_nationkey", "left").select(
        "cell_id", F.coalesce("r_name", F.lit("Unknown")).alias("cell_type")
    )


@query("unmatched_cells", "SELECT c_custkey AS cell_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_cells(spark, d):
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"))
    return c.join(P.table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id")), "cell_id", "left_anti")


@query("key_sets", """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)
    UNION ALL SELECT 'cells_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)
    UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events)""")
def key_sets(spark, d):
    a = P.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = P.table(spark, d, "events").select(F.col("user_id").alias("k"))
    both, only, either = a.intersect(b), a.subtract(b), a.union(b).distinct()
    out = None
    for name, df in (("both", both), ("cells_only", only), ("either", either)):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("ordered_distinct", """SELECT conv_id, list_aggregate(list(role ORDER BY first), 'string_agg', ',') AS roles FROM
    (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, d):
    c = P.table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    ordered = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "role"))).alias("r"))
    return ordered.select("conv_id", F.array_join(F.array_distinct(F.col("r.role")), ",").alias("roles"))


cte("mk", [], """SELECT tissue, cell_type, gene, count(*) OVER (PARTITION BY tissue, cell_type)::INT AS total_markers FROM
    (SELECT DISTINCT upper(substr(lang, 1, 1)) || substr(lang, 2) AS tissue, source AS cell_type,
    unnest(string_split(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', ' ', 'g'), ' ')) AS gene FROM documents) WHERE length(gene) >= 4""")
cte("qy", [], """SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'En' END AS want, list_distinct(list_filter(
    string_split(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', ' ', 'g'), ' '), lambda x: length(x) >= 4)) AS genes FROM benchmark""")
cte("qh", ["mk", "qy"], """SELECT query_id, cell_type, tissue, count(*) AS hits, any_value(total_markers) AS total, any_value(len(genes)) AS nq, any_value(want) AS want
    FROM (SELECT query_id, want, genes, unnest(genes) AS gene FROM qy) JOIN mk USING (gene) GROUP BY 1, 2, 3""")
cte("cand", ["qh"], """SELECT *, round(hits / total, 4) AS recall, round(j, 4) AS jaccard, round(j * CASE WHEN tissue = want THEN 1.5 ELSE 1.0 END, 4) AS wj
    FROM (SELECT *, hits / (nq + total - hits) AS j FROM qh)""")


@query("marker_candidates", sql(["cand"], """SELECT query_id, cell_type, tissue, hits, recall, jaccard, wj AS weighted_jaccard, total AS total_markers,
    'Normal' AS cancer_type, row_number() OVER w AS candidate_rank FROM cand
    WINDOW w AS (PARTITION BY query_id ORDER BY wj DESC, cell_type, tissue) QUALIFY row_number() OVER w <= 3"""))
def marker_candidates(spark, d):
    return annotate.candidates(P.benchmark_queries(spark, d), P.document_markers(spark, d), 3)


@query("annotation_batch", sql(["cand", "qy"], """SELECT q.query_id, CASE WHEN q.query_id % 2 = 0 THEN 'en' END AS tissue, cell_type, c.tissue AS matched_tissue,
    wj AS weighted_jaccard, CASE WHEN len(genes) = 0 THEN 'null value' WHEN cell_type IS NULL THEN 'No candidate found' ELSE '(API not called)' END AS status
    FROM qy q LEFT JOIN (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY wj DESC, cell_type, tissue) = 1) c
    ON c.query_id = q.query_id"""))
def annotation_batch(spark, d):
    out = annotate.batch_annotate(P.benchmark_queries(spark, d), P.document_markers(spark, d))
    return out.select("query_id", "tissue", "cell_type", "matched_tissue", "weighted_jaccard", "status")


@query("token_estimate", """SELECT doc_id, floor(len(regexp_extract_all(text, '[一-鿿]')) + 0.5 * len(regexp_extract_all(text, '\\p{L}'))
    + 0.5 * len(regexp_extract_all(text, '\\p{Nd}')) + 0.3 * len(regexp_extract_all(text, '[^\\p{L}\\p{Nd}\\s]')))::BIGINT AS tokens FROM documents""")
def token_estimate(spark, d):
    return P.table(spark, d, "documents").select("doc_id", annotate.token_estimate(F.col("text")).alias("tokens"))


@query("gene_tokens", """SELECT item_id, list_aggregate(list_filter(list_transform(regexp_split_to_array(text, '[,;\\s]+'), lambda x: upper(trim(replace(x, 'ß', 'ss')))),
    lambda x: x <> ''), 'string_agg', '|') AS genes FROM benchmark""")
def gene_tokens(spark, d):
    return P.table(spark, d, "benchmark").select(
        "item_id", F.array_join(S.gene_tokens(F.col("text"), r"[,;\s]+"), "|").alias("genes")
    )


@query("name_rules", """SELECT p_partkey AS id, upper(regexp_replace(p_name || '(var.' || p_size || ')', '\\(var\\.\\d+\\)$', '')) AS factor,
    upper(substr(trim(p_type), 1, 1)) || lower(substr(trim(p_type), 2)) AS tissue, upper(trim(split_part(p_name, ' ', 1))) AS main,
    upper(trim(split_part(p_name, ' ', 2))) AS alias, p_brand AS quoted FROM part""")
def name_rules(spark, d):
    p = P.table(spark, d, "part")
    gene = F.concat(F.split("p_name", " ")[0], F.lit(" ("), F.split("p_name", " ")[1], F.lit(")"))
    return p.select(
        F.col("p_partkey").alias("id"),
        S.factor_name(F.concat("p_name", F.lit("(var."), F.col("p_size").cast("string"), F.lit(")"))).alias("factor"),
        S.tissue_key(F.col("p_type")).alias("tissue"),
        S.marker_main(gene).alias("main"),
        S.marker_alias(gene).alias("alias"),
        S.quoted_name(F.concat(F.lit('MA "'), "p_brand", F.lit('" x'))).alias("quoted"),
    )


@query("safe_divide", f"""SELECT l_orderkey, l_linenumber, {R('coalesce(l_extendedprice / nullif(l_discount, 0), -1)')} AS ratio FROM lineitem""")
def safe_divide(spark, d):
    li = P.table(spark, d, "lineitem")
    out = li.select("l_orderkey", "l_linenumber", S.safe_divide(F.col("l_extendedprice"), F.col("l_discount"), -1.0).alias("ratio"))
    return rounded(out, "ratio")


cte("cl", [], "SELECT c_custkey AS cell_id, c_mktsegment AS cluster FROM customer")
cte("lnc", ["rna", "cl"], """SELECT cell_id, feature_id, cluster, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1e4) AS v FROM rna JOIN cl USING (cell_id)""")
cte("rk", ["lnc"], """SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY v) + (count(*) OVER (PARTITION BY feature_id, v) - 1) / 2.0 AS rnk FROM lnc""")
cte("gs", ["lnc"], """SELECT feature_id, sum(c) AS nnz_all, sum(c * v) AS tot, sum(c * c * c - c) AS tie FROM
    (SELECT feature_id, v, count(*)::DOUBLE AS c FROM lnc GROUP BY 1, 2) GROUP BY 1""")
cte("st", ["rk"], "SELECT feature_id, cluster, sum(rnk) AS rp, count(*) AS nnz, sum(v) AS tin FROM rk GROUP BY 1, 2")
cte("mw", ["gs", "st", "cl"], """SELECT *, rp + nnz * n0 + (n1 - nnz) * (n0 + 1) / 2 - n1 * (n1 + 1) / 2 AS u, sqrt(greatest(0, n1 * n2 / 12 * ((nn + 1)
    - (tie + n0 * n0 * n0 - n0) / (nn * (nn - 1))))) AS sd FROM (SELECT g.feature_id, k.cluster, coalesce(rp, 0) AS rp, coalesce(nnz, 0) AS nnz,
    coalesce(tin, 0) AS tin, tot, tie, nn - nnz_all AS n0, n1, nn - n1 AS n2, nn FROM gs g CROSS JOIN (SELECT cluster, count(*)::DOUBLE AS n1 FROM cl GROUP BY 1) k
    CROSS JOIN (SELECT count(*)::DOUBLE AS nn FROM cl) LEFT JOIN st ON st.feature_id = g.feature_id AND st.cluster = k.cluster)""")
cte("mwz", ["mw"], """SELECT feature_id, cluster, u, CASE WHEN sd > 1e-9 THEN greatest((abs(u - n1 * n2 / 2) - 0.5) / sd, 0) END AS z,
    (tin / n1 - (tot - tin) / n2) / ln(2) AS fc FROM mw""")


def _labelled(spark, d):
    return P.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cluster"))


@query("marker_ranksum", sql(["mwz"], f"""SELECT feature_id, cluster, {R('u')} AS u_stat, {R('z')} AS z, {R('fc')} AS "log2FC" FROM mwz"""))
def marker_ranksum(spark, d):
    cells = _labelled(spark, d)
    out = markers.rank_sum(normalize.log_normalize(P.rna(spark, d)), markers.keep_large_clusters(cells, "cluster"))
    return rounded(out, "u_stat", "z", "log2FC")


@query("top_markers")
def top_markers(spark, d):
    tested = markers.marker_test(normalize.log_normalize(P.rna(spark, d)), _labelled(spark, d))
    return markers.top_markers(tested, 10, 0.9999, 0.05)


@query("marker_lists")
def marker_lists(spark, d):
    tested = markers.marker_test(normalize.log_normalize(P.rna(spark, d)), _labelled(spark, d))
    top = markers.top_markers(tested, 10, 1.01, 0.0).withColumn("gene", F.col("feature_id"))
    return annotate.marker_lists(top)


@query("small_cluster_filter", """SELECT conv_id::BIGINT AS cell_id, role AS cluster FROM conversations WHERE role IN
    (SELECT role FROM conversations GROUP BY 1 HAVING count(*) >= 40)""")
def small_cluster_filter(spark, d):
    c = P.table(spark, d, "conversations").select(F.col("conv_id").alias("cell_id"), F.col("role").alias("cluster"))
    return markers.keep_large_clusters(c, "cluster", 40)


@query("cluster_order", """SELECT brand, row_number() OVER (ORDER BY n NULLS LAST, brand) AS pos FROM
    (SELECT DISTINCT p_brand AS brand, try_cast(split_part(p_brand, '#', 2) AS INT) AS n FROM part)""")
def cluster_order(spark, d):
    b = P.table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    from pyspark.sql.window import Window

    n = F.split("brand", "#")[1].try_cast("int")
    # One row per cluster name, a handful by nature.
    return b.select("brand", F.row_number().over(Window.orderBy(n.asc_nulls_last(), "brand")).cast("bigint").alias("pos"))
