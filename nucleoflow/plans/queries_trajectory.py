"""Registered queries: ordering functions, pseudotime, profiles, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O
from nucleoflow.operators import grn, linking, plotdata, spline, trajectory
from nucleoflow.plans import proxies as P
from nucleoflow.plans.oracle_base import cte, r6 as R, sql
from nucleoflow.plans.registry import query, r6, rounded


@query("empirical_quantile", sql(["cells"], f"SELECT cell_id, {R('trajectory / 100')} AS q FROM cells"))
def empirical_quantile(spark, d):
    return P.cells(spark, d).select("cell_id", r6(F.col("trajectory") / 100).alias("q"))


_AVG = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


@query("empirical_quantile_round5", f"""SELECT c_custkey AS cell_id, round({_AVG.format(x='c_acctbal')} / count(*) OVER (), 5)::DOUBLE AS q
    FROM customer""")
def empirical_quantile_round5(spark, d):
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), "c_acctbal")
    return O.with_ranks(c, "c_acctbal", {"q": O.empirical_quantile("round5")}, fixed=True).select("cell_id", "q")


@query("pct_rank_avg", f"""SELECT c_custkey AS id, c_mktsegment AS grp,
    {R('''(rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal / 100)) + (count(*) OVER (PARTITION BY c_mktsegment,
    round(c_acctbal / 100)) - 1) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment)''')} AS pct FROM customer""")
def pct_rank_avg(spark, d):
    c = P.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), F.round(F.col("c_acctbal") / 100).alias("x")
    )
    return rounded(O.with_ranks(c, "x", {"pct": O.percent_rank_average()}, ["grp"]).select("id", "grp", "pct"), "pct")


@query("min_rank_desc", """SELECT p_partkey AS id, rank() OVER (ORDER BY p_size DESC)::BIGINT AS rank_desc,
    row_number() OVER (ORDER BY p_size DESC, p_partkey)::BIGINT AS row_desc FROM part""")
def min_rank_desc(spark, d):
    p = P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    ranked = O.with_ranks(p, "p_size", {"rank_desc": O.min_rank_desc()})
    return O.dense_order(ranked, "p_size", "id", "row_desc").select("id", "rank_desc", "row_desc")


@query("rank_scaled_high", f"""WITH t AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier)
    SELECT id, {R(f"1 - ({_AVG.format(x='x DESC')} - 1) / (count(*) OVER () - 1)")} AS scaled FROM t""".replace(
    "PARTITION BY x DESC", "PARTITION BY x"))
def rank_scaled_high(spark, d):
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return rounded(O.with_ranks(s, "x", {"scaled": O.scaled_rank_high_better()}).select("id", "scaled"), "scaled")


@query("bh_fdr", f"""WITH t AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * 7919 % 100003) / 100003 AS p FROM lineitem),
    k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_orderkey, l_linenumber) AS raw,
    row_number() OVER (ORDER BY p, l_orderkey, l_linenumber) AS rn FROM t)
    SELECT l_orderkey, l_linenumber, {R('p')} AS p,
    {R('least(1, min(raw) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS fdr FROM k""")
def bh_fdr(spark, d):
    li = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_extendedprice") * 7919 % 100003) / 100003).alias("p")
    )
    return rounded(O.benjamini_hochberg(li, "p", "fdr"), "p", "fdr")


@query("zscore_pop", f"""SELECT p_partkey AS id, {R('''(p_retailprice - avg(p_retailprice) OVER w) / nullif(stddev_pop(p_retailprice)
    OVER w, 0)''')} AS z, {R('(p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part)')} AS z_all
    FROM part WINDOW w AS (PARTITION BY p_brand)""")
def zscore_pop(spark, d):
    p = P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size", "p_brand")
    out = O.zscore(O.zscore(p, "p_retailprice", "z", ["p_brand"]), "p_size", "z_all")
    return rounded(out.select("id", "z", "z_all"), "z", "z_all")


@query("pseudotime_minmax", sql(["cells"], f"""SELECT cell_id, {R('(trajectory - lo) / (hi - lo)')} AS pseudotime FROM cells,
    (SELECT min(trajectory) AS lo, max(trajectory) AS hi FROM cells)"""))
def pseudotime_minmax(spark, d):
    return rounded(O.min_max(P.cells(spark, d), "trajectory", "pseudotime").select("cell_id", "pseudotime"), "pseudotime")


@query("pseudotime_bins", sql(["bins"], "SELECT bin, count(*) AS n_cells FROM bins GROUP BY 1"))
def pseudotime_bins(spark, d):
    bins = trajectory.assign_bins(P.cells(spark, d))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n_cells"))


def _profiles(spark, d, which, **kw):
    source = {"rna": P.rna, "atac": P.atac, "act": P.activity}[which]
    return trajectory.profiles(source(spark, d), P.cells(spark, d), **kw)


def _long(profile):
    return rounded(trajectory.unpack(profile, "v"), "v")


@query("traj_bin_means", sql(["rna_raw"], f"SELECT feature_id, bin, {R('v')} AS v FROM rna_raw"))
def traj_bin_means(spark, d):
    return _long(_profiles(spark, d, "rna", scale_to=None, log2=False, window=0))


@query("traj_scaled_log2", sql(["rna_log"], f"SELECT feature_id, bin, {R('v')} AS v FROM rna_log"))
def traj_scaled_log2(spark, d):
    return _long(_profiles(spark, d, "rna", window=0))


@query("traj_smoothed", sql(["rna_s11"], f"SELECT feature_id, bin, {R('v')} AS v FROM rna_s11"))
def traj_smoothed(spark, d):
    return _long(_profiles(spark, d, "rna"))


@query("traj_activity_smoothed", sql(["act_s7"], f"SELECT feature_id, bin, {R('v')} AS v FROM act_s7"))
def traj_activity_smoothed(spark, d):
    return _long(_profiles(spark, d, "act", window=7))


cte("rna_trunc", ["rna_log"], """SELECT feature_id, bin, avg(v) OVER (PARTITION BY feature_id ORDER BY bin
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM rna_log""")


@query("rolling_truncated", sql(["rna_trunc"], f"SELECT feature_id, bin, {R('v')} AS v FROM rna_trunc"))
def rolling_truncated(spark, d):
    p = _profiles(spark, d, "rna", window=0)
    return _long(p.withColumn("vec", O.rolling_mean_truncated(F.col("vec"), P.N_BINS, 7)))


def _var(name: str, source: str, cut: float | None = 0.9) -> None:
    keep = "" if cut is None else f"WHERE rn <= floor((1 - {cut}::DOUBLE) * n)"
    cte(name, [source], f"""SELECT feature_id, var FROM (SELECT feature_id, var,
        row_number() OVER (ORDER BY round(var, 9) DESC, feature_id) AS rn, count(*) OVER () AS n FROM
        (SELECT feature_id, var_samp(v) AS var FROM {source} GROUP BY 1) WHERE var > 0) {keep}""")


_var("rna_var", "rna_s7")
_var("rna_all", "rna_s7", None)
_var("act_all", "act_s7", None)


@query("variance_cutoff", sql(["rna_var"], f"SELECT feature_id, {R('var')} AS variance FROM rna_var"))
def variance_cutoff(spark, d):
    out = trajectory.variance_cutoff(_profiles(spark, d, "rna", window=7), 0.9)
    return rounded(out.select("feature_id", "variance"), "variance")


def _z(name: str, source: str, var: str) -> None:
    cte(name, [source, var], f"""SELECT feature_id, bin, greatest(-1.5, least(1.5, (v - avg(v) OVER w) / stddev_samp(v) OVER w)) AS z
        FROM {source} WHERE feature_id IN (SELECT feature_id FROM {var}) WINDOW w AS (PARTITION BY feature_id)""")


_z("rna_z", "rna_s7", "rna_var")
_z("act_z", "act_s7", "act_all")


@query("scaled_profiles", sql(["rna_z"], f"SELECT feature_id, bin, {R('z')} AS v FROM rna_z"))
def scaled_profiles(spark, d):
    return _long(trajectory.scaled_profiles(_profiles(spark, d, "rna", window=7)).select("feature_id", "vec"))


@query("heatmap_rows", sql(["act_s7"], f"""SELECT feature_id, bin, {R('''greatest(-2, least(2, coalesce((v - avg(v) OVER w) /
    nullif(stddev_pop(v) OVER w, 0), 0)))''')} AS z FROM act_s7 WINDOW w AS (PARTITION BY feature_id)"""))
def heatmap_rows(spark, d):
    out = plotdata.heatmap_matrix(_profiles(spark, d, "act", window=7), 2.0)
    return rounded(trajectory.unpack(out.select("feature_id", "vec"), "z"), "z")


cte("act_peak", ["act_s7"], "SELECT feature_id, min_by(bin, bin) FILTER (v = m) AS peak_bin FROM (SELECT *, max(v) OVER (PARTITION BY feature_id) AS m FROM act_s7) GROUP BY 1")


@query("peak_positions", sql(["act_peak"], f"""SELECT feature_id, peak_bin, {R('''1 + 99.0 * (row_number() OVER
    (ORDER BY peak_bin, feature_id) - 1) / (count(*) OVER () - 1)''')} AS time_point FROM act_peak"""))
def peak_positions(spark, d):
    return rounded(trajectory.time_points(_profiles(spark, d, "act", window=7)), "time_point")


cte("vecs", [], "SELECT vec_id AS cell_idx, label, embedding::DOUBLE[] AS vec FROM embeddings")


def _cent(name: str, source: str) -> None:
    cte(name, [source], f"""SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(vec[d]) AS m FROM {source},
        (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2) GROUP BY 1""")


_cent("cent", "vecs")
cte("near", ["vecs", "cent"], "SELECT cell_idx, v.label, vec, list_distance(vec, c) AS dist FROM vecs v JOIN cent c ON v.label = c.label")
cte("kept", ["near"], """SELECT * FROM near n JOIN (SELECT label AS l2, quantile_cont(dist, 0.9) AS cut FROM near GROUP BY 1)
    ON label = l2 WHERE dist <= cut""")
_cent("kcent", "kept")
PATH = ["3", "1", "7", "4"]
_PATH_SQL = "(SELECT * FROM (VALUES (3, 0, 1, false), (1, 1, 7, false), (7, 2, 4, false), (4, 3, 7, true)) p(label, step, toward, is_last))"
cte("aimed", ["kept", "kcent"], f"""SELECT cell_idx, k.label, step, is_last, list_distance(vec, c.c) AS dist FROM kept k
    JOIN {_PATH_SQL} p ON k.label = p.label JOIN kcent c ON c.label = p.toward""")


@query("prefilter_cells", sql(["kept"], f"SELECT cell_idx, label, {R('dist')} AS distance FROM kept"))
def prefilter_cells(spark, d):
    out = trajectory.distance_filter(P.vectors(spark, d), "label", 64)
    return rounded(out.select("cell_idx", "label", "distance"), "distance")


_Q = "floor(rank() OVER (PARTITION BY label ORDER BY dist) + (count(*) OVER (PARTITION BY label, dist) - 1) / 2.0) / count(*) OVER (PARTITION BY label)"


@query("initial_time", sql(["aimed"], f"""SELECT cell_idx, label::VARCHAR AS label, {R(f'CASE WHEN is_last THEN {_Q} + step ELSE 1 - {_Q} + step END')}
    AS time0 FROM aimed"""))
def initial_time(spark, d):
    kept = trajectory.distance_filter(P.vectors(spark, d), "label", 64)
    out = trajectory.initial_times(kept, PATH, "label", 64)
    return rounded(out.select("cell_idx", "label", "time0"), "time0")


_Q5 = "round((rank() OVER (PARTITION BY label ORDER BY dist) + (count(*) OVER (PARTITION BY label, dist) - 1) / 2.0) / count(*) OVER (PARTITION BY label), 5)"


@query("initial_time_one_based", sql(["aimed"], f"""SELECT cell_idx, {R(f'CASE WHEN is_last THEN {_Q5} + step + 1 ELSE 1 - {_Q5} + step + 1 END')}
    AS time0 FROM aimed"""))
def initial_time_one_based(spark, d):
    kept = trajectory.distance_filter(P.vectors(spark, d), "label", 64)
    out = trajectory.initial_times(kept, PATH, "label", 64, mode="round5", base=1)
    return rounded(out.select("cell_idx", "time0"), "time0")


@query("trajectory_inference")
def trajectory_inference(spark, d):
    out = spline.infer_trajectory(P.vectors(spark, d), PATH, "label", 64, key="cell_idx", dof=20)
    return rounded(out, "trajectory")


@query("trajectory_inference_round5")
def trajectory_inference_round5(spark, d):
    out = spline.infer_trajectory(
        P.vectors(spark, d), PATH, "label", 64, key="cell_idx", dof=20, mode="round5", base=1
    )
    return rounded(out, "trajectory")


cte("gtss", ["features"], """SELECT feature_id AS gene, chr, (CASE WHEN strand = '+' THEN start ELSE "end" END)::DOUBLE AS tss FROM features""")
cte("band", ["features", "gtss"], f"""SELECT p.feature_id AS peak, g.gene, p.chr, abs((p.start + p."end") / 2 - tss) AS distance,
    (p.start + p."end") / 2 AS peak_center, tss AS gene_tss FROM features p JOIN gtss g ON p.chr = g.chr
    AND abs((p.start + p."end") / 2 - tss) <= {P.LINK_DISTANCE}""")


@query("peak_gene_band_join", sql(["band"], "SELECT * FROM band"))
def peak_gene_band_join(spark, d):
    return linking.band_join(P.peaks(spark, d), P.genes(spark, d), P.LINK_DISTANCE)


def _unit(name: str, source: str, value: str = "v") -> None:
    cte(name, [source], f"""SELECT feature_id, list(u ORDER BY bin) AS u FROM (SELECT feature_id, bin, c / (CASE WHEN nn > 1e-12
        THEN nn ELSE 1 END) AS u FROM (SELECT feature_id, bin, c, sqrt(sum(c * c) OVER (PARTITION BY feature_id)) AS nn FROM
        (SELECT feature_id, bin, {value} - avg({value}) OVER (PARTITION BY feature_id) AS c FROM {source}))) GROUP BY 1""")


_unit("gu", "rna_s7")
_unit("pu", "atac_s7")
_unit("au", "act_s7")
_unit("gzu", "rna_z", "z")
_unit("azu", "act_z", "z")

# Two-sided Student tail for 98 degrees of freedom as a finite trigonometric sum.
_TH = "atan(abs({t}) / sqrt(98.0))"
_COEF = []
_c = 1.0
for _k in range(49):
    if _k:
        _c *= (2 * _k - 1) / (2 * _k)
    _COEF.append(_c)


def tail98(t: str) -> str:
    th = _TH.format(t=t)
    powers = ", ".join(f"{c!r}::DOUBLE" for c in _COEF)
    return (
        f"greatest(0.0, 1 - sin({th}) * list_sum(list_transform(range(0, 49), lambda k: "
        f"[{powers}][k + 1] * pow(cos({th}), 2 * k))))"
    )


def _tested(name: str, pairs: str, left: str, right: str, lk: str, rk: str, extra: str) -> None:
    cte(f"{name}_r", [pairs, left, right], f"""SELECT {extra}, list_dot_product(l.u, r.u) AS r FROM {pairs} b
        JOIN {left} l ON l.feature_id = b.{lk} JOIN {right} r ON r.feature_id = b.{rk}""")
    cte(f"{name}_t", [f"{name}_r"], f"SELECT *, r / sqrt(greatest(1 - r * r, 1e-16) / 98) AS t FROM {name}_r")
    cte(f"{name}_p", [f"{name}_t"], f"SELECT *, {tail98('t')} AS p FROM {name}_t")
    cte(name, [f"{name}_p"], f"""SELECT *, least(1, min(raw) OVER (ORDER BY p, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr
        FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, {lk}, {rk}) AS raw,
        row_number() OVER (ORDER BY p, {lk}, {rk}) AS rn FROM {name}_p)""")


_tested("links", "band", "pu", "gu", "peak", "gene", "b.*")


def _links(spark, d):
    return linking.link_peaks_to_genes(
        _profiles(spark, d, "atac", window=7),
        _profiles(spark, d, "rna", window=7),
        P.peaks(spark, d),
        P.genes(spark, d),
        P.LINK_DISTANCE,
    )


_LINK_COLS = f"""peak, gene, chr, distance, {R('r')} AS "Correlation", {R('t')} AS "TStat", {R('p')} AS pvalue, {R('fdr')} AS "FDR" """


@query("peak_gene_links", sql(["links"], f"SELECT {_LINK_COLS} FROM links"))
def peak_gene_links(spark, d):
    out = _links(spark, d).drop("peak_center", "gene_tss")
    return rounded(out, "Correlation", "TStat", "pvalue", "FDR")


cte("vgenes_u", ["gu", "rna_var"], "SELECT * FROM gu WHERE feature_id IN (SELECT feature_id FROM rna_var)")
_tested("vlinks", "band", "pu", "vgenes_u", "peak", "gene", "b.*")


@query("select_genes", sql(["vlinks"], f"SELECT {_LINK_COLS} FROM vlinks WHERE distance > 300 AND r > 0.1 AND fdr < 0.5"))
def select_genes(spark, d):
    out = grn.select_genes(
        _profiles(spark, d, "atac", window=7),
        _profiles(spark, d, "rna", window=7),
        P.peaks(spark, d),
        P.genes(spark, d),
        0.9,
        P.LINK_DISTANCE,
        300.0,
        0.1,
        0.5,
    )
    return rounded(out.drop("peak_center", "gene_tss"), "Correlation", "TStat", "pvalue", "FDR")


cte("allpairs", ["azu", "gzu"], "SELECT a.feature_id AS tf, g.feature_id AS gene FROM azu a CROSS JOIN gzu g")
_tested("tgc", "allpairs", "azu", "gzu", "tf", "gene", "b.*")


@query("tf_gene_correlation", sql(["tgc"], f"""SELECT tf, gene, {R('r')} AS correlation, {R('t')} AS t_stat, {R('p')} AS p_value,
    {R('fdr')} AS fdr FROM tgc"""))
def tf_gene_correlation(spark, d):
    out = grn.tf_gene_correlation(_profiles(spark, d, "act", window=7), _profiles(spark, d, "rna", window=7))
    return rounded(out, "correlation", "t_stat", "p_value", "fdr")


cte("tfpair", ["au", "gu"], "SELECT a.feature_id AS tf, a.feature_id AS gene FROM au a JOIN gu g ON g.feature_id = a.feature_id")
_tested("tfsel", "tfpair", "au", "gu", "tf", "gene", "b.*")
cte("tfsel_f", ["tfsel", "act_peak"], f"""SELECT s.*, (fdr < 0.5 AND r > 0.05) AS pass_filters, rank() OVER (ORDER BY r DESC)::BIGINT AS rk,
    tp FROM tfsel s LEFT JOIN (SELECT feature_id, 1 + 99.0 * (row_number() OVER (ORDER BY peak_bin, feature_id) - 1)
    / (count(*) OVER () - 1) AS tp FROM act_peak) q ON q.feature_id = s.tf""")


@query("select_tfs", sql(["tfsel_f"], f"""SELECT tf, {R('r')} AS correlation, {R('t')} AS t_stat, {R('p')} AS p_value, {R('fdr')} AS adj_p,
    pass_filters, rk AS correlation_rank_all, CASE WHEN pass_filters THEN rank() OVER (PARTITION BY pass_filters ORDER BY r DESC)
    END::BIGINT AS correlation_rank_passed, pass_filters AND row_number() OVER (PARTITION BY pass_filters ORDER BY r DESC, tf) <= 10
    AS selected, {R('tp')} AS time_point FROM tfsel_f"""))
def select_tfs(spark, d):
    out = grn.select_tfs(
        _profiles(spark, d, "act", window=7), _profiles(spark, d, "rna", window=7), 0.05, 0.5, n_tfs=10
    )
    return rounded(out, "correlation", "t_stat", "p_value", "adj_p", "time_point")


@query("trajectory_colour_clip", sql(["cells"], f"""SELECT cell_id, {R('least(hi, greatest(lo, c_acctbal))')} AS colour FROM cells,
    (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM cells)"""))
def trajectory_colour_clip(spark, d):
    return rounded(plotdata.clip_colour(P.cells(spark, d), "c_acctbal", "colour").select("cell_id", "colour"), "colour")


cte("arrow", ["cells", "vecs"], """SELECT floor(c.trajectory / 1.01)::BIGINT AS slot, avg(v.vec[1]) AS x, avg(v.vec[2]) AS y
    FROM cells c JOIN vecs v ON v.cell_idx = c.cell_id GROUP BY 1""")


@query("trajectory_arrow", sql(["arrow"], f"""SELECT slot, {R('avg(x) OVER w')} AS x, {R('avg(y) OVER w')} AS y FROM arrow
    WINDOW w AS (ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""))
def trajectory_arrow(spark, d):
    v = P.vectors(spark, d).select(
        F.col("cell_idx").alias("cell_id"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")
    )
    cells = P.cells(spark, d).join(v, "cell_id")
    return rounded(plotdata.arrow_path(cells, 5), "x", "y")
