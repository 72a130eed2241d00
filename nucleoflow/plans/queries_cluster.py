"""Registered queries: consensus, agreement, quality, embeddings, clusterers."""

from __future__ import annotations

from pyspark.sql import functions as F

from nucleoflow.operators import (
    community,
    consensus,
    embed,
    ensemble,
    hierarchy,
    motif,
    neighbors,
    normalize,
    quality,
    spanning,
)
from nucleoflow.plans import proxies as P
from nucleoflow.plans import queries_trajectory  # noqa: F401  (shared CTEs)
from nucleoflow.plans.oracle_base import cte, r6 as R, sql
from nucleoflow.plans.queries_qc import lognorm
from nucleoflow.plans.registry import query, rounded
from nucleoflow.session import materialize

cte("draw", [], """SELECT iter, cell_idx FROM (SELECT iter, vec_id AS cell_idx, row_number() OVER (PARTITION BY iter ORDER BY
    md5(iter || ':' || vec_id)) AS r FROM embeddings, (SELECT unnest(range(0, 3))::INT AS iter))
    WHERE r <= floor((SELECT count(*) FROM embeddings) * 0.8)""")
cte("lab", [], """SELECT iter, m AS method, vec_id AS cell_idx, (CASE m WHEN 'Kmeans' THEN label WHEN 'Seurat' THEN (label + (vec_id + iter) % 2) % 10
    WHEN 'ACM_WEP' THEN (label + vec_id % (iter + 2)) % 5 ELSE CASE WHEN (vec_id + iter) % 7 = 0 THEN -1 ELSE label % 4 END END)::INT AS label
    FROM embeddings, (SELECT unnest(range(0, 3))::INT AS iter), (SELECT unnest(['Kmeans', 'Seurat', 'ACM_WEP', 'Hierarchical']) AS m)""")
cte("il", ["lab", "draw"], "SELECT lab.* FROM lab JOIN draw USING (iter, cell_idx)")
_W = {"Kmeans": 0.4, "Seurat": 0.3, "ACM_WEP": 0.2, "Hierarchical": 0.1}


def _pairs_sql(name: str, w: str) -> None:
    cte(f"{name}_n", ["il"], f"""SELECT a.cell_idx AS i, b.cell_idx AS j, sum(CASE WHEN a.label = b.label THEN {w} ELSE 0 END) AS c, sum({w}) AS s
        FROM il a JOIN il b ON a.iter = b.iter AND a.method = b.method AND a.cell_idx < b.cell_idx WHERE a.label <> -1 AND b.label <> -1 GROUP BY 1, 2""")
    cte(name, ["il", f"{name}_n"], f"""SELECT x.cell_idx AS i, y.cell_idx AS j, coalesce(c, 0)::DOUBLE AS c, coalesce(s, 0)::DOUBLE AS s, coalesce(c / nullif(s, 0), 0)::DOUBLE AS v
        FROM (SELECT DISTINCT vec_id AS cell_idx FROM embeddings) x JOIN (SELECT DISTINCT vec_id AS cell_idx FROM embeddings) y ON x.cell_idx < y.cell_idx
        LEFT JOIN {name}_n n ON n.i = x.cell_idx AND n.j = y.cell_idx""")


_pairs_sql("cons_w", "CASE a.method WHEN 'Kmeans' THEN 0.4::DOUBLE WHEN 'Seurat' THEN 0.3::DOUBLE WHEN 'ACM_WEP' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END")
_pairs_sql("cons_u", "1::DOUBLE")
_PAIR_COLS = f"i, j, {R('c')} AS w_cluster, {R('s')} AS w_sample, {R('v')} AS value"


@query("sampled_cells", sql(["draw"], "SELECT iter, cell_idx FROM draw"))
def sampled_cells(spark, d):
    cells = P.vectors(spark, d).select("cell_idx")
    return consensus.sample_cells(cells, P.iterations(spark), 0.8)


@query("consensus_pairs", sql(["cons_w"], f"SELECT {_PAIR_COLS} FROM cons_w"))
def consensus_pairs(spark, d):
    out = consensus.co_clustering(consensus.complete_iterations(P.iter_labels(spark, d)), _W, P.vectors(spark, d))
    return rounded(out, "w_cluster", "w_sample", "value")


@query("consensus_unweighted", sql(["cons_u"], f"SELECT {_PAIR_COLS} FROM cons_u"))
def consensus_unweighted(spark, d):
    return rounded(consensus.co_clustering(P.iter_labels(spark, d), cells=P.vectors(spark, d)), "w_cluster", "w_sample", "value")


@query("consensus_auc", sql(["cons_u"], f"""SELECT {R('sum((nv - v) * ((rn + rn + 1) / 2.0 / n))')} AS auc, max(n) AS n_pairs FROM
    (SELECT v, lead(v) OVER (ORDER BY v) AS nv, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM cons_u)"""))
def consensus_auc(spark, d):
    return rounded(consensus.consensus_auc_of(P.iter_labels(spark, d), cells=P.vectors(spark, d)), "auc")


cte("gsc", [], """SELECT s_nationkey AS iter, l_partkey AS gene, ln(1 + avg(l_quantity)) / 4 AS score FROM lineitem
    JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")


@query("gene_stability", sql(["gsc"], f"""SELECT gene, {R('max(score)')} AS max_score, {R('min(score)')} AS min_score, {R('median(score)')} AS median_score,
    {R('sum(score)')} AS cumulative_score, count(*) AS freq_detected, {R('avg(score)')} AS mean_score_when_detected,
    count(*) FILTER (rn <= 300) AS freq_top300, round(count(*) FILTER (rn <= 300) / 25.0::DOUBLE * 100, 2) AS top300_rate,
    round(count(*) / 25.0::DOUBLE * 100, 2) AS detection_rate FROM
    (SELECT *, row_number() OVER (PARTITION BY iter ORDER BY score DESC, gene) AS rn FROM gsc) GROUP BY 1"""))
def gene_stability(spark, d):
    out = consensus.gene_stability(P.gene_scores(spark, d), 25)
    return rounded(out, "max_score", "min_score", "median_score", "cumulative_score", "mean_score_when_detected")


@query("sampling_counts", sql(["draw"], f"""SELECT vec_id AS cell_idx, count(draw.iter) AS n_sampled, {R('count(draw.iter) / 3.0')} AS sampling_rate
    FROM embeddings LEFT JOIN draw ON draw.cell_idx = vec_id GROUP BY 1"""))
def sampling_counts(spark, d):
    cells = P.vectors(spark, d).select("cell_idx")
    drawn = consensus.sample_cells(cells, P.iterations(spark), 0.8)
    return rounded(consensus.sampling_counts(drawn, cells, 3), "sampling_rate")


@query("label_pivot", sql(["il"], "SELECT cell_idx, " + ", ".join(
    f"""any_value(label) FILTER (iter = {i}) AS "{i}" """ for i in range(3)) + " FROM il WHERE method = 'Kmeans' GROUP BY 1"))
def label_pivot(spark, d):
    return consensus.label_table(P.iter_labels(spark, d).where("method = 'Kmeans'"), [0, 1, 2])


cte("imp", ["vecs"], """SELECT cell_idx AS gene, list_sum(list_transform(range(1, 65), lambda i: vec[i] * vec[i] / (i + 1))) AS raw FROM vecs""")


@query("gene_importance", sql(["imp"], f"SELECT gene, {R('(raw - lo) / (hi - lo)')} AS score FROM imp, (SELECT min(raw) AS lo, max(raw) AS hi FROM imp)"))
def gene_importance(spark, d):
    v = P.vectors(spark, d).select(F.col("cell_idx").alias("gene"), "vec")
    return rounded(consensus.gene_importance(v, [1 / (i + 2) for i in range(64)]), "score")


cte("ct", [], """SELECT label AS true_label, (CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END)::INT AS pred_label, count(*) AS n
    FROM embeddings GROUP BY 1, 2""")


def _table(spark, d):
    return consensus.contingency(P.predicted(spark, d))


@query("contingency", sql(["ct"], "SELECT * FROM ct"))
def contingency(spark, d):
    return _table(spark, d)


cte("agr", ["ct"], """SELECT *, ap * bp / (t * (t - 1) / 2) AS ex FROM (SELECT sum(n)::DOUBLE AS t, sum(n * (n - 1) / 2)::DOUBLE AS p, sum(n * ln(n)) AS nl FROM ct),
    (SELECT sum(m * (m - 1) / 2)::DOUBLE AS ap, sum(m * ln(m)) AS al FROM (SELECT sum(n) AS m FROM ct GROUP BY true_label)),
    (SELECT sum(m * (m - 1) / 2)::DOUBLE AS bp, sum(m * ln(m)) AS bl FROM (SELECT sum(n) AS m FROM ct GROUP BY pred_label))""")


@query("cluster_eval", sql(["agr"], f"""SELECT {R('(p - ex) / ((ap + bp) / 2 - ex)')} AS ari,
    {R('greatest(ln(t) + (nl - al - bl) / t, 0) / ((ln(t) - al / t + ln(t) - bl / t) / 2)')} AS nmi, {R('p / sqrt(ap * bp)')} AS fmi FROM agr"""))
def cluster_eval(spark, d):
    return rounded(consensus.agreement(materialize(_table(spark, d))), "ari", "nmi", "fmi")


@query("pair_consistency", sql(["ct"], f"""SELECT true_label, sum(n)::BIGINT AS size, {R('sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2)')} AS consistency
    FROM ct GROUP BY 1"""))
def pair_consistency(spark, d):
    return rounded(consensus.pair_consistency(_table(spark, d)), "consistency")


@query("cluster_purity", sql(["ct"], f"""SELECT pred_label, sum(n)::BIGINT AS size, {R('max(n) / sum(n)')} AS purity, {R('1 - max(n) / sum(n)')} AS contamination
    FROM ct GROUP BY 1"""))
def cluster_purity(spark, d):
    return rounded(consensus.purity(_table(spark, d)), "purity", "contamination")


@query("overall_purity", sql(["ct"], f"SELECT {R('sum(m) / sum(s)')} AS overall_purity FROM (SELECT max(n) AS m, sum(n) AS s FROM ct GROUP BY pred_label)"))
def overall_purity(spark, d):
    return rounded(consensus.overall_purity(_table(spark, d)), "overall_purity")


@query("matched_accuracy", """SELECT round(count(*) FILTER (vec_id % 3 <> 0) / count(*), 6) AS accuracy FROM embeddings""")
def matched_accuracy(spark, d):
    acc = consensus.matched_accuracy(_table(spark, d))
    return spark.createDataFrame([(round(acc, 6),)], "accuracy double")


cte("l0", ["lab"], "SELECT * FROM lab WHERE iter = 0")
_PAIRS = [(a, b) for i, a in enumerate(consensus.METHODS) for b in consensus.METHODS[i + 1 :]]
cte("aris", ["l0"], "\nUNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, (p - ap * bp / tt) / ((ap + bp) / 2 - ap * bp / tt) AS ari FROM
    (WITH j AS (SELECT x.label AS la, y.label AS lb, count(*)::DOUBLE AS n FROM l0 x JOIN l0 y USING (cell_idx) WHERE x.method = '{a}' AND y.method = '{b}'
    AND x.label <> -1 AND y.label <> -1 GROUP BY 1, 2) SELECT (SELECT sum(n * (n - 1) / 2) FROM j) AS p, (SELECT sum(n) * (sum(n) - 1) / 2 FROM j) AS tt,
    (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM j GROUP BY la)) AS ap, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM j GROUP BY lb)) AS bp)"""
    for a, b in _PAIRS))


@query("method_weights", sql(["aris"], f"""SELECT method, {R('w / sum(w) OVER ()')} AS weight FROM (SELECT method, greatest(sum(ari) / 3, 0) AS w FROM
    (SELECT a AS method, ari FROM aris UNION ALL SELECT b, ari FROM aris) GROUP BY 1)"""))
def method_weights(spark, d):
    labels = P.all_labels(spark, d).where("iter = 0").drop("iter")
    return rounded(consensus.method_weights(labels), "weight")


cte("dist", ["vecs"], """SELECT a.cell_idx AS i, b.cell_idx AS j, a.label AS la, b.label AS lb, list_distance(a.vec, b.vec) AS d FROM vecs a
    JOIN vecs b ON a.cell_idx <> b.cell_idx""")


@query("silhouette", sql(["dist"], f"""SELECT i AS cell_idx, {R('(b - a) / greatest(a, b)')} AS silhouette FROM (SELECT i, max(CASE WHEN la = lb THEN m END) AS a,
    min(CASE WHEN la <> lb THEN m END) AS b FROM (SELECT i, la, lb, avg(d) AS m FROM dist GROUP BY 1, 2, 3) GROUP BY 1)"""))
def silhouette(spark, d):
    out = quality.silhouette(P.vectors(spark, d), "cell_idx").select("cell_idx", "silhouette")
    return rounded(out, "silhouette")


@query("dunn_index", sql(["dist"], f"SELECT {R('min(d) FILTER (la <> lb) / (max(d) FILTER (la = lb) + 1e-12)')} AS dunn FROM dist"))
def dunn_index(spark, d):
    return rounded(quality.dunn(P.vectors(spark, d), "cell_idx"), "dunn")


cte("gcent", ["vecs"], "SELECT list(m ORDER BY d) AS g FROM (SELECT d, avg(vec[d]) AS m FROM vecs, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1)")
cte("scat", ["near", "cent"], """SELECT n.label, count(*)::DOUBLE AS n, avg(dist) AS s, sum(dist * dist) AS w, any_value(c) AS c FROM near n
    JOIN cent USING (label) GROUP BY 1""")


@query("davies_bouldin_calinski", sql(["scat", "gcent"], f"""SELECT (SELECT {R('avg(r)')} FROM (SELECT max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM scat a
    JOIN scat b ON a.label <> b.label GROUP BY a.label)) AS dbi, {R('(sum(n * pow(list_distance(c, g), 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*)))')} AS ch
    FROM scat, gcent"""))
def davies_bouldin_calinski(spark, d):
    return rounded(quality.davies_bouldin_calinski(P.vectors(spark, d), 64), "dbi", "ch")


cte("sg", ["vecs"], """SELECT label, sqrt(sum(v)) AS sigma FROM (SELECT label, d, var_pop(vec[d]) AS v FROM vecs, (SELECT unnest(range(1, 65)) AS d)
    GROUP BY 1, 2) GROUP BY 1""")
cte("sr", ["sg", "vecs"], """SELECT avg(sigma) AS m, sqrt(avg(sigma * sigma)) AS rad, (SELECT sqrt(sum(v)) FROM (SELECT var_pop(vec[d]) AS v FROM vecs,
    (SELECT unnest(range(1, 65)) AS d) GROUP BY d)) AS alls FROM sg""")
cte("own", ["near", "sr"], "SELECT label, count(*) FILTER (dist <= rad) AS k FROM near, sr GROUP BY 1")
cte("mid", ["cent"], """SELECT a.label AS la, b.label AS lb, list_transform(range(1, 65), lambda i: 0.5 * (a.c[i] + b.c[i])) AS mm FROM cent a
    JOIN cent b ON a.label < b.label""")
cte("dm", ["mid", "vecs", "sr"], """SELECT la, lb, count(*) FILTER (list_distance(vec, mm) <= rad) AS k FROM mid JOIN vecs v ON v.label IN (la, lb), sr GROUP BY 1, 2""")


@query("s_dbw_index", sql(["sr", "own", "dm"], f"""SELECT {R('any_value(sr.m) / (any_value(alls) + 1e-12) + avg(dm.k / greatest(x.k, y.k, 1))')} AS s_dbw
    FROM dm JOIN own x ON x.label = la JOIN own y ON y.label = lb, sr"""))
def s_dbw_index(spark, d):
    return rounded(quality.s_dbw(P.vectors(spark, d), 64), "s_dbw")


@query("cluster_shape", sql(["l0"], f"""SELECT count(*) FILTER (label <> -1) AS k, {R('100.0 * sum(n) FILTER (label = -1) / sum(n)')} AS noise_ratio,
    {R('100.0 * max(n) FILTER (label <> -1) / sum(n)')} AS max_cluster_ratio FROM (SELECT label, count(*) AS n FROM l0 WHERE method = 'Hierarchical' GROUP BY 1)"""))
def cluster_shape(spark, d):
    labels = P.all_labels(spark, d).where("iter = 0 AND method = 'Hierarchical'")
    return rounded(quality.shape(labels), "noise_ratio", "max_cluster_ratio")


@query("knn_graph", sql(["dist"], f"""SELECT i AS cell_idx, j AS neighbor, {R('d')} AS distance, rn AS nn_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j)::INT AS rn FROM dist) WHERE rn <= 15"""))
def knn_graph(spark, d):
    v = P.vectors(spark, d)
    return rounded(neighbors.knn(v, v, 15, "cell_idx", "cell_idx", exclude_self=True), "distance")


@query("knn_cosine", sql(["vecs"], f"""SELECT i AS cell_idx, j AS neighbor, {R('d')} AS distance, rn AS nn_rank FROM (SELECT *, row_number() OVER
    (PARTITION BY i ORDER BY d, j)::INT AS rn FROM (SELECT a.cell_idx AS i, b.cell_idx AS j, list_cosine_distance(a.vec, b.vec) AS d FROM vecs a
    JOIN vecs b ON a.cell_idx <> b.cell_idx)) WHERE rn <= 5"""))
def knn_cosine(spark, d):
    v = P.vectors(spark, d)
    return rounded(neighbors.knn(v, v, 5, "cell_idx", "cell_idx", "cosine", exclude_self=True), "distance")


def _line_sql(k: int) -> str:
    """Chained cuts over the sorted values: each CTE picks the best gap."""
    parts = ["""t AS MATERIALIZED (SELECT p_partkey AS id, p_retailprice * (1 + p_size / 50.0) AS x FROM part)""",
             """g AS MATERIALIZED (SELECT x, nx - x AS gap, pos, n FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx, row_number() OVER (ORDER BY x) AS pos,
             count(*) OVER () AS n FROM t) WHERE nx > x)"""]
    cuts: list[str] = []
    for i in range(k - 1):
        los = ", ".join(["0", *[f"CASE WHEN pos > (SELECT pos FROM c{j}) THEN (SELECT pos FROM c{j}) ELSE 0 END" for j in range(i)]])
        his = ", ".join(["n", *[f"CASE WHEN pos < (SELECT pos FROM c{j}) THEN (SELECT pos FROM c{j}) ELSE n END" for j in range(i)]])
        notcut = " AND ".join(["true", *[f"pos <> (SELECT pos FROM c{j})" for j in range(i)]])
        parts.append(f"""c{i} AS MATERIALIZED (SELECT x, pos, gap * least(pos - greatest({los}, 0), least({his}, n) - pos) AS score FROM g WHERE {notcut}
            ORDER BY score DESC, gap, pos LIMIT 1)""")
        cuts.append(f"(x > (SELECT x FROM c{i}))::INT")
    return f"WITH {', '.join(parts)} SELECT id, ({' + '.join(cuts)})::INT AS label FROM t"


@query("gene_score_clusters", _line_sql(4))
def gene_score_clusters(spark, d):
    p = P.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") * (1 + F.col("p_size") / 50.0)).alias("x")
    )
    labels, _ = spanning.line_clusters(p, "x", 4)
    return p.join(labels.select("x", "label"), "x").select("id", "label")


#: Rounds in which the SQL twin joins components by their shortest edges; each halves them, so 2^12 vectors are covered.
_ROUNDS = 12
cte("join0", ["vecs"], "SELECT cell_idx AS id, cell_idx AS comp FROM vecs")
for _r in range(1, _ROUNDS + 1):
    _b = f"join{_r - 1}"
    cte(f"short{_r}", ["dist", _b], f"""SELECT a.comp, min({{'d': d, 'u': least(i, j), 'v': greatest(i, j)}}) AS e FROM dist JOIN {_b} a ON a.id = i
        JOIN {_b} b ON b.id = j WHERE a.comp <> b.comp GROUP BY 1""")
    cte(f"join{_r}", [_b, f"short{_r}"], f"""WITH RECURSIVE links AS (SELECT x.comp AS a, y.comp AS b FROM short{_r} JOIN {_b} x ON x.id = e.u
        JOIN {_b} y ON y.id = e.v), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(a, b) AS (SELECT DISTINCT comp, comp FROM {_b}
        UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
        SELECT id, m AS comp FROM {_b} JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = comp""")
_EDGES = " UNION ".join(f"SELECT e.u AS u, e.v AS v, e.d AS d FROM short{r}" for r in range(1, _ROUNDS + 1))
cte("cut0", [f"short{r}" for r in range(1, _ROUNDS + 1)], _EDGES)
for _r in range(1, 8):
    # the longest way from a node by each neighbour; what is longest without the edge's own other end is the height of that side
    cte(f"best{_r}", [f"cut{_r - 1}"], f"""WITH RECURSIVE ways AS (SELECT u AS a, v AS b FROM cut{_r - 1} UNION ALL SELECT v, u FROM cut{_r - 1}),
        walk(s, f, p, c, n) AS (SELECT a, b, a, b, 1 FROM ways UNION ALL SELECT s, f, c, b, n + 1 FROM walk JOIN ways ON a = c AND b <> p),
        h AS (SELECT s, f, max(n) AS h FROM walk GROUP BY 1, 2)
        SELECT u, v, d, (1 + least(max(coalesce(x.h, 0)), max(coalesce(y.h, 0)))) * d AS score FROM cut{_r - 1} LEFT JOIN h x ON x.s = u AND x.f <> v
        LEFT JOIN h y ON y.s = v AND y.f <> u GROUP BY u, v, d ORDER BY score DESC, d, u, v LIMIT 1""")
    cte(f"cut{_r}", [f"cut{_r - 1}", f"best{_r}"], f"SELECT u, v, d FROM cut{_r - 1} ANTI JOIN best{_r} USING (u, v)")
cte("parts", ["vecs", "cut4"], """WITH RECURSIVE ways AS (SELECT u AS a, v AS b FROM cut4 UNION ALL SELECT v, u FROM cut4), reach(a, b) AS
    (SELECT cell_idx, cell_idx FROM vecs UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
    SELECT a AS cell_idx, min(b) AS part FROM reach GROUP BY 1""")


@query("mst_edges", sql(["cut0"], f"SELECT u, v, {R('d')} AS dist FROM cut0"))
def mst_edges(spark, d):
    return rounded(spanning.spanning_tree(P.vectors(spark, d), "cell_idx"), "dist")


@query("tree_clusters", sql(["parts"], "SELECT cell_idx, (dense_rank() OVER (ORDER BY part) - 1)::INT AS label FROM parts"))
def tree_clusters(spark, d):
    return spanning.tree_clusters(P.vectors(spark, d), "cell_idx", 5)[0]


@query("tree_cut_curve", sql([f"best{r}" for r in range(1, 8)], " UNION ALL ".join(f"SELECT {r} AS step, {R('score')} AS score FROM best{r}" for r in range(1, 8))))
def tree_cut_curve(spark, d):
    tree = materialize(spanning.spanning_tree(P.vectors(spark, d), "cell_idx"))
    return rounded(spanning.curve_table(spark, spanning.cut_tree(tree, 8)[1]), "score")


def _merges_sql(method: str) -> str:
    """One merge a step: ``st`` holds every pair of clusters, ``s`` what their pairs sum up to, ``d`` their dissimilarity."""
    ward = method == "ward"
    joined = {"average": "sum(s)", "complete": "max(s)", "ward": "sum(CASE WHEN met THEN (oa + ob) * s ELSE s END)"}[method]
    start = "sum((p.x - q.x) * (p.x - q.x))" if ward else "sqrt(sum((p.x - q.x) * (p.x - q.x)))"
    s = "CASE WHEN met THEN (s - nk * md) / (na + nb) ELSE s END" if ward else "s"
    d = "s / (na * nb)" if method == "average" else s
    return f"""pt AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
    st(step, a, b, na, nb, s, d) AS (
        SELECT 0, p.id, q.id, 1, 1, {start}, {start} FROM pt p JOIN pt q ON p.k = q.k AND p.id < q.id GROUP BY p.id, q.id
        UNION ALL
        SELECT step, a, b, na, nb, {s}, {d} FROM (
            SELECT step + 1 AS step, least(x, y) AS a, greatest(x, y) AS b, min(CASE WHEN x < y THEN nx ELSE ny END) AS na,
                min(CASE WHEN x < y THEN ny ELSE nx END) AS nb, {joined} AS s, bool_or(met) AS met, min(CASE WHEN x = m_a THEN ny ELSE nx END) AS nk, min(md) AS md
            FROM (SELECT st.step, st.s, st.na AS oa, st.nb AS ob, m.a AS m_a, m.d AS md, st.a IN (m.a, m.b) OR st.b IN (m.a, m.b) AS met,
                    CASE WHEN st.a = m.b THEN m.a ELSE st.a END AS x, CASE WHEN st.b = m.b THEN m.a ELSE st.b END AS y,
                    CASE WHEN st.a IN (m.a, m.b) THEN m.na + m.nb ELSE st.na END AS nx, CASE WHEN st.b IN (m.a, m.b) THEN m.na + m.nb ELSE st.nb END AS ny
                FROM st, (SELECT a, b, na, nb, d FROM st ORDER BY d, a, b LIMIT 1) m)
            WHERE x <> y GROUP BY 1, 2, 3)),
    mg AS (SELECT arg_min(a, (d, a, b)) AS a, arg_min(b, (d, a, b)) AS b, {"sqrt(min(d))" if ward else "min(d)"} AS height,
        arg_min(na + nb, (d, a, b))::DOUBLE AS size FROM st GROUP BY step)"""


def _dendrogram_sql(method: str) -> str:
    return f"WITH RECURSIVE {_merges_sql(method)} SELECT a, b, {R('height')} AS height, size FROM mg"


def _cut_sql(method: str, k: int) -> str:
    return f"""WITH RECURSIVE {_merges_sql(method)},
    kept AS MATERIALIZED (SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY height DESC, size DESC, a, b) AS r FROM mg) WHERE r > {k - 1}),
    up(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT up.id, kept.a FROM up JOIN kept ON kept.b = up.root)
    SELECT id AS cell_idx, (dense_rank() OVER (ORDER BY root) - 1)::INT AS label FROM (SELECT id, min(root) AS root FROM up GROUP BY id)"""


@query("ward_clusters", _cut_sql("ward", 10))
def ward_clusters(spark, d):
    return hierarchy.ward_clusters(P.vectors(spark, d), "cell_idx", 10)


@query("ward_dendrogram", _dendrogram_sql("ward"))
def ward_dendrogram(spark, d):
    return rounded(hierarchy.ward_merges(P.vectors(spark, d), "cell_idx"), "height")


def _linkage(spark, d, method):
    v = P.vectors(spark, d)
    return hierarchy.vector_pairs(v, "cell_idx"), v.select(F.col("cell_idx").alias("node")), method


@query("average_dendrogram", _dendrogram_sql("average"))
def average_dendrogram(spark, d):
    return rounded(hierarchy.linkage_merges(*_linkage(spark, d, "average")), "height")


@query("complete_dendrogram", _dendrogram_sql("complete"))
def complete_dendrogram(spark, d):
    return rounded(hierarchy.linkage_merges(*_linkage(spark, d, "complete")), "height")


@query("complete_clusters", _cut_sql("complete", 10))
def complete_clusters(spark, d):
    pairs, nodes, method = _linkage(spark, d, "complete")
    return hierarchy.linkage_clusters(pairs, nodes, 10, method).withColumnRenamed("node", "cell_idx")


@query("kmeans_labels")
def kmeans_labels(spark, d):
    return embed.kmeans(P.vectors(spark, d), "cell_idx", 10)


@query("community_labels")
def community_labels(spark, d):
    v = P.vectors(spark, d)
    g = materialize(community.neighbor_graph(v, "cell_idx", 15))
    return community.louvain(g, v.select(F.col("cell_idx").alias("node")), [0.8])


@query("community_stability", "SELECT count(*) AS nodes, 0 AS improving, 0 AS parts_missing FROM embeddings")
def community_stability(spark, d):
    """Nodes that would better the modularity by a move, and parts of communities without links, of community_labels."""
    v = P.vectors(spark, d)
    g = materialize(community.neighbor_graph(v, "cell_idx", 15))
    labels = materialize(community.louvain(g, v.select(F.col("cell_idx").alias("node")), [0.8]))
    return community.stability(g, labels).select("nodes", "improving", "parts_missing")


@query("resolution_search")
def resolution_search(spark, d):
    v = P.vectors(spark, d)
    g = materialize(community.neighbor_graph(v, "cell_idx", 15))
    best, labels = community.search_resolution(g, v.select(F.col("cell_idx").alias("node")), 10)
    return community.cluster_counts(labels).withColumn("chosen", F.col("resolution") == best)


@query("consensus_clusters")
def consensus_clusters(spark, d):
    labels = consensus.complete_iterations(P.iter_labels(spark, d))
    return ensemble.final_labels(labels, 5, P.vectors(spark, d), _W)[0]


def _genes(spark, d):
    return P.features(spark, d).select("feature_id")


@query("pca_scores")
def pca_scores(spark, d):
    scores, _, _ = embed.pca(lognorm(spark, d), _genes(spark, d), 5)
    return scores.select("cell_id", F.transform("vec", lambda x: F.round(x, 4)).alias("vec"))


@query("lsi_scores")
def lsi_scores(spark, d):
    scores, _, _ = embed.lsi(normalize.tf_idf(P.atac(spark, d)), _genes(spark, d), 5)
    return scores.select("cell_id", F.transform("vec", lambda x: F.round(x, 4)).alias("vec"))


def _xy(spark, d):
    v = P.vectors(spark, d)
    return v.select(F.col("cell_idx").alias("cell_id"), F.slice("vec", 1, 16).alias("x"), F.slice("vec", 17, 12).alias("y"))


@query("joint_embedding")
def joint_embedding(spark, d):
    scores, _ = embed.joint_embedding(_xy(spark, d))
    return scores.select("cell_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("joint_tests")
def joint_tests(spark, d):
    return rounded(embed.joint_embedding(_xy(spark, d))[1], "correlation", "p_value", "fdr")


@query("motif_scan")
def motif_scan(spark, d):
    seq = P.table(spark, d, "documents").select(
        F.col("doc_id").alias("peak"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")
    )
    b = P.table(spark, d, "benchmark").select(
        F.concat(F.lit("M"), F.col("item_id").cast("string")).alias("tf"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s")
    )
    letters = b.select("tf", F.posexplode(F.split(F.substring("s", 1, 10), "")).alias("pos", "c")).where("c <> ''")
    pwm = letters.select("tf", "pos", *[F.when(F.col("c") == x, 0.91).otherwise(0.03).alias(x) for x in "ACGT"])
    return rounded(motif.scan(seq, pwm, 1e-4), "score")


@query("tf_deviations")
def tf_deviations(spark, d):
    counts = P.atac(spark, d).withColumnRenamed("feature_id", "peak")
    f = P.features(spark, d).select(F.col("feature_id").alias("peak"), F.col("p_size").alias("gc"))
    depth = counts.groupBy("peak").agg(F.sum("value").alias("depth"))
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tf"), F.col("s_nationkey"))
    match = P.motif_match(spark, d).join(s, "tf").groupBy("peak", F.col("s_nationkey").alias("tf")).agg(F.sum("score").alias("score"))
    return rounded(motif.deviations(counts, match, f.join(depth, "peak")), "deviation", "z")
