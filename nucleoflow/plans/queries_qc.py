"""Registered queries: quality control, filters, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from nucleoflow.functions import strings as S
from nucleoflow.operators import annotate, normalize, qc
from nucleoflow.plans import proxies as P
from nucleoflow.plans.oracle_base import cte, r6 as R, sql
from nucleoflow.plans.registry import query, r6, rounded

LIMITS = qc.QcLimits(
    min_features=20,
    max_features=60,
    min_counts=300,
    max_counts=1800,
    max_pct_mt=20.0,
    min_cells_per_gene=10,
    min_cells_per_peak=10,
    exclude_genes=["^old", "BOLT$"],
)
MT = "red"

cte("qc_cells", ["rna", "features"], """SELECT cell_id, count(*) FILTER (value > 0) AS n_feature, sum(value) AS n_count,
    coalesce(sum(CASE WHEN symbol LIKE 'red%' THEN value ELSE 0 END) / nullif(sum(value), 0), 0) * 100 AS pct_mt
    FROM rna JOIN features USING (feature_id) GROUP BY 1""")
cte("good_cells", ["qc_cells"], """SELECT cell_id FROM qc_cells WHERE n_feature BETWEEN 20 AND 60
    AND n_count BETWEEN 300 AND 1800 AND pct_mt <= 20""")
cte("rna_kept", ["rna", "good_cells"], "SELECT rna.* FROM rna JOIN good_cells USING (cell_id)")
cte("rna_f", ["rna_kept", "features"], """SELECT r.* FROM rna_kept r JOIN features f USING (feature_id)
    WHERE feature_id IN (SELECT feature_id FROM rna_kept WHERE value > 0 GROUP BY 1 HAVING count(*) >= 10)
    AND NOT regexp_matches(symbol, '(?i)(?:^old)|(?:BOLT$)')""")
cte("std_peaks", ["peak_names"], """SELECT feature_id, name FROM peak_names WHERE
    regexp_extract(name, '^(chr[^:\\-]+)', 1) IN (SELECT 'chr' || unnest(range(1, 23)) UNION ALL
    SELECT unnest(['chrX', 'chrY', 'chrM']))""")
cte("atac_std", ["atac", "std_peaks"], "SELECT a.* FROM atac a JOIN std_peaks USING (feature_id)")
cte("atac_f", ["atac_std"], """SELECT * FROM atac_std WHERE feature_id IN
    (SELECT feature_id FROM atac_std WHERE value > 0 GROUP BY 1 HAVING count(*) >= 10)""")


def _gene_names(spark, d):
    return P.features(spark, d).select("feature_id", "symbol")


def _metrics(spark, d):
    flagged = P.features(spark, d).select(
        "feature_id", qc.mitochondrial(F.col("symbol"), MT).alias("is_mt")
    )
    return qc.cell_metrics(P.rna(spark, d), flagged)


@query("scan_modalities", sql(["rna", "atac"], f"""SELECT modality, count(*) AS n_values,
    count(DISTINCT cell_id) AS n_cells, count(DISTINCT feature_id) AS n_features, {R('sum(value)')} AS total
    FROM (SELECT 'rna' AS modality, * FROM rna UNION ALL SELECT 'atac', * FROM atac) GROUP BY 1"""))
def scan_modalities(spark, d):
    both = P.rna(spark, d).withColumn("modality", F.lit("rna")).unionByName(
        P.atac(spark, d).withColumn("modality", F.lit("atac"))
    )
    return both.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_distinct("cell_id").alias("n_cells"),
        F.count_distinct("feature_id").alias("n_features"),
        r6(F.sum("value")).alias("total"),
    )


@query("raw_count_check", sql(["rna", "act"], f"""SELECT modality, {R('max(abs(value - round(value)))')} AS max_fraction,
    max(abs(value - round(value))) < 1e-9 AS is_counts, count(*) AS n_values FROM (
    SELECT 'rna' AS modality, value FROM rna UNION ALL SELECT 'price', l_extendedprice FROM lineitem) GROUP BY 1"""))
def raw_count_check(spark, d):
    price = P.table(spark, d, "lineitem").select(F.lit("price").alias("modality"), F.col("l_extendedprice").alias("value"))
    rna = P.rna(spark, d).select(F.lit("rna").alias("modality"), "value")
    return rounded(qc.looks_like_counts(rna.unionByName(price)), "max_fraction")


@query("unique_feature_names", """SELECT p_partkey AS feature_id, p_name AS symbol, CASE WHEN k = 1 THEN p_name
    ELSE p_name || '-' || (k - 1) END AS unique_name FROM
    (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def unique_feature_names(spark, d):
    return qc.unique_names(_gene_names(spark, d), "symbol", "feature_id")


@query("qc_cell_metrics", sql(["qc_cells"], f"""SELECT cell_id, n_feature, {R('n_count')} AS n_count,
    {R('pct_mt')} AS pct_mt FROM qc_cells"""))
def qc_cell_metrics(spark, d):
    return rounded(_metrics(spark, d), "n_count", "pct_mt")


@query("qc_pass_flags", sql(["qc_cells", "good_cells"], """SELECT cell_id, cell_id IN (SELECT cell_id FROM good_cells)
    AS pass_qc FROM qc_cells"""))
def qc_pass_flags(spark, d):
    return qc.flag_cells(_metrics(spark, d), LIMITS).select("cell_id", "pass_qc")


@query("qc_filtered_counts", sql(["rna_f"], f"SELECT cell_id, feature_id, {R('value')} AS value FROM rna_f"))
def qc_filtered_counts(spark, d):
    return rounded(qc.filter_rna(P.rna(spark, d), _gene_names(spark, d), LIMITS, MT), "value")


@query("qc_filtered_peaks", sql(["atac_f"], f"SELECT cell_id, feature_id, {R('value')} AS value FROM atac_f"))
def qc_filtered_peaks(spark, d):
    return rounded(qc.filter_atac(P.atac(spark, d), P.peak_names(spark, d), 10), "value")


@query("qc_summary", sql(["qc_cells"], "\nUNION ALL ".join(
    f"""SELECT '{m}' AS metric, {R(f'avg({m})')} AS mean, {R(f'stddev_samp({m})')} AS std,
    {R(f'median({m}::DOUBLE)')} AS median FROM qc_cells""" for m in ("n_feature", "n_count", "pct_mt"))))
def qc_summary(spark, d):
    out = qc.metric_summary(_metrics(spark, d), ["n_feature", "n_count", "pct_mt"])
    return rounded(out, "mean", "std", "median")


@query("qc_metric_long", sql(["qc_cells"], "\nUNION ALL ".join(
    f"SELECT '{m}' AS metric, {R(f'{m}::DOUBLE')} AS value FROM qc_cells" for m in ("n_feature", "n_count", "pct_mt"))))
def qc_metric_long(spark, d):
    return rounded(qc.metric_long(_metrics(spark, d), ["n_feature", "n_count", "pct_mt"]), "value")


_BOTH = """(SELECT 'rna' AS modality, * FROM rna_f UNION ALL SELECT 'atac', * FROM {atac})"""


@query("qc_pipeline", sql(["rna_f", "atac_f"], f"""SELECT modality, cell_id, count(*) AS n_values,
    {R('sum(value)')} AS total FROM {_BOTH.format(atac='atac_f')} WHERE cell_id IN (SELECT cell_id FROM rna_f)
    AND cell_id IN (SELECT cell_id FROM atac_f) GROUP BY 1, 2"""))
def qc_pipeline(spark, d):
    out = qc.quality_control(
        P.rna(spark, d), P.atac(spark, d), _gene_names(spark, d), P.peak_names(spark, d), LIMITS, MT
    )
    return out.groupBy("modality", "cell_id").agg(
        F.count(F.lit(1)).alias("n_values"), r6(F.sum("value")).alias("total")
    )


cte("atac_synced", ["atac_std", "rna_f"], "SELECT * FROM atac_std WHERE cell_id IN (SELECT cell_id FROM rna_f)")
cte("atac_sf", ["atac_synced"], """SELECT * FROM atac_synced WHERE feature_id IN
    (SELECT feature_id FROM atac_synced WHERE value > 0 GROUP BY 1 HAVING count(*) >= 10)""")


@query("qc_pipeline_sync_first", sql(["rna_f", "atac_sf"], f"""SELECT modality, cell_id, count(*) AS n_values,
    {R('sum(value)')} AS total FROM {_BOTH.format(atac='atac_sf')} WHERE cell_id IN (SELECT cell_id FROM rna_f)
    AND cell_id IN (SELECT cell_id FROM atac_sf) GROUP BY 1, 2"""))
def qc_pipeline_sync_first(spark, d):
    out = qc.quality_control(
        P.rna(spark, d), P.atac(spark, d), _gene_names(spark, d), P.peak_names(spark, d), LIMITS, MT, sync_first=True
    )
    return out.groupBy("modality", "cell_id").agg(
        F.count(F.lit(1)).alias("n_values"), r6(F.sum("value")).alias("total")
    )


@query("cells_sync", """SELECT DISTINCT o_custkey AS cell_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN
    (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def cells_sync(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"), "o_orderstatus")
    return qc.shared_cells(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")).orderBy("cell_id")


@query("std_chrom_filter", sql(["std_peaks"], "SELECT feature_id, name FROM std_peaks"))
def std_chrom_filter(spark, d):
    return P.peak_names(spark, d).where(S.is_standard_chromosome(F.col("name"))).select("feature_id", "name")


@query("chrom_prefix_filter", sql(["peak_names"], """SELECT feature_id, name FROM peak_names
    WHERE starts_with(name, 'chr1') AND NOT contains(name, 'chr11') AND NOT contains(name, '99')"""))
def chrom_prefix_filter(spark, d):
    return P.peak_names(spark, d).where(
        S.has_chromosome_prefix(F.col("name"), "chr1", ["chr11", "99"])
    ).select("feature_id", "name")


_PAT = "^(chr[^:\\-]+)[:\\-](\\d+)-(\\d+)$"


@query("peak_parse", sql(["peak_names"], f"""SELECT name, regexp_extract(name, '{_PAT}', 1) AS chr,
    regexp_extract(name, '{_PAT}', 2)::BIGINT AS start, regexp_extract(name, '{_PAT}', 3)::BIGINT AS "end",
    TRUE AS valid, regexp_replace(name, '^([^:\\-]+)-(\\d+-\\d+)$', '\\1:\\2') AS colon_name FROM peak_names"""))
def peak_parse(spark, d):
    names = P.peak_names(spark, d)
    return names.select("name", S.parse_peak(F.col("name")).alias("p"), S.colon_peak(F.col("name")).alias("colon_name")).select(
        "name", "p.*", "colon_name"
    )


cte("ln", ["rna"], """SELECT cell_id, feature_id, value, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 1e4) AS norm
    FROM rna""")


def lognorm(spark, d):
    return normalize.log_normalize(P.rna(spark, d))


def n_cells(spark, d):
    return P.rna(spark, d).agg(F.count_distinct("cell_id").cast("double")).scalar()


@query("lognorm_counts", sql(["ln"], f"SELECT cell_id, feature_id, {R('norm')} AS norm FROM ln"))
def lognorm_counts(spark, d):
    return rounded(lognorm(spark, d).select("cell_id", "feature_id", "norm"), "norm")


@query("tfidf_counts", sql(["atac"], f"""SELECT cell_id, feature_id, {R('''ln(1 + value / sum(value) OVER
    (PARTITION BY cell_id) * 1e4) * ln(1 + (SELECT count(DISTINCT cell_id) FROM atac) / sum(value) OVER
    (PARTITION BY feature_id))''')} AS tfidf FROM atac"""))
def tfidf_counts(spark, d):
    return rounded(normalize.tf_idf(P.atac(spark, d)).select("cell_id", "feature_id", "tfidf"), "tfidf")


cte("hvg_m", ["ln"], """SELECT feature_id, s / n AS mu, (q - s * s / n) / (n - 1) AS var FROM (SELECT feature_id,
    sum(exp(norm) - 1) AS s, sum((exp(norm) - 1) * (exp(norm) - 1)) AS q,
    (SELECT count(DISTINCT cell_id) FROM ln) AS n FROM ln GROUP BY 1)""")
cte("hvg_d", ["hvg_m"], """SELECT feature_id, ln(1 + mu) AS mean, ln(nullif(var / mu, 0)) AS dispersion FROM hvg_m WHERE mu > 0""")
cte("hvg_b", ["hvg_d"], """SELECT *, greatest(0, least(19, coalesce(ceil((mean - lo) / nullif((hi - lo) / 20, 0)) - 1, 0)))::INT AS bin
    FROM hvg_d, (SELECT min(mean) AS lo, max(mean) AS hi FROM hvg_d)""")
cte("hvg", ["hvg_b"], """SELECT feature_id, mean, dispersion, bin, CASE WHEN stddev_samp(dispersion) OVER w IS NULL THEN 1.0
    ELSE (dispersion - avg(dispersion) OVER w) / nullif(stddev_samp(dispersion) OVER w, 0) END AS dispersion_norm
    FROM hvg_b WINDOW w AS (PARTITION BY bin)""")


@query("hvg_dispersion", sql(["hvg"], f"""SELECT feature_id, {R('mean')} AS mean, {R('dispersion')} AS dispersion, bin,
    {R('dispersion_norm')} AS dispersion_norm,
    row_number() OVER (ORDER BY dispersion_norm DESC, feature_id) <= 300 AS highly_variable
    FROM hvg WHERE dispersion_norm IS NOT NULL"""))
def hvg_dispersion(spark, d):
    out = normalize.highly_variable(lognorm(spark, d), n_cells(spark, d), 300)
    return rounded(out, "mean", "dispersion", "dispersion_norm")


cte("sc_m", ["ln"], """SELECT feature_id, s / n AS mu, (q - s * s / n) / (n - 1) AS var FROM (SELECT feature_id, sum(norm) AS s,
    sum(norm * norm) AS q, (SELECT count(DISTINCT cell_id) FROM ln) AS n FROM ln GROUP BY 1)""")
_SD = "(CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END)"


@query("scaled_counts", sql(["ln", "sc_m"], f"""SELECT cell_id, feature_id,
    {R(f'greatest(-10, least(10, (norm - mu) / {_SD}))')} AS scaled,
    {R(f'greatest(-10, least(10, -mu / {_SD}))')} AS zero_scaled FROM ln JOIN sc_m USING (feature_id)"""))
def scaled_counts(spark, d):
    out = normalize.scale_clip(lognorm(spark, d), n_cells(spark, d))
    return rounded(out.select("cell_id", "feature_id", "scaled", "zero_scaled"), "scaled", "zero_scaled")


cte("freq", ["atac"], "SELECT feature_id, count(*) AS n_cells FROM atac WHERE value > 0 GROUP BY 1")


@query("top_features_n", sql(["freq"], """SELECT feature_id, n_cells FROM freq
    QUALIFY row_number() OVER (ORDER BY n_cells DESC, feature_id) <= 500"""))
def top_features_n(spark, d):
    return normalize.top_features(P.atac(spark, d), n_top=500)


@query("top_features_quantile", sql(["freq"], """SELECT feature_id, n_cells FROM freq
    WHERE n_cells >= (SELECT quantile_cont(n_cells::DOUBLE, 0.75) FROM freq)"""))
def top_features_quantile(spark, d):
    return normalize.top_features(P.atac(spark, d), min_cutoff="q75")


_FRAG = "SELECT DISTINCT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') || '-1' AS barcode FROM events"


@query("fragment_barcode_overlap", f"""WITH seen AS ({_FRAG}), n AS (SELECT DISTINCT c_name AS name FROM customer)
    SELECT 'cells' AS how, count(*) AS n FROM customer
    UNION ALL SELECT 'direct', count(*) FROM n WHERE name IN (SELECT barcode FROM seen)
    UNION ALL SELECT 'suffix_removed', count(*) FROM (SELECT DISTINCT regexp_replace(name, '-1$', '') AS m FROM n)
        WHERE m IN (SELECT barcode FROM seen)
    UNION ALL SELECT 'suffix_added', count(*) FROM (SELECT DISTINCT name || '-1' AS m FROM n)
        WHERE m IN (SELECT barcode FROM seen)""")
def fragment_barcode_overlap(spark, d):
    names = P.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return annotate.barcode_overlap(names, _fragments(spark, d))


def _fragments(spark, d):
    return P.table(spark, d, "events").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("-1")).alias("barcode")
    )


@query("fragment_barcode_rewrite", "SELECT c_name AS name, c_name || '-1' AS fragment_name FROM customer")
def fragment_barcode_rewrite(spark, d):
    names = P.table(spark, d, "customer").select(F.col("c_name").alias("name"))
    return annotate.rewrite_for_fragments(names, _fragments(spark, d), 0.01)


@query("qc_violin_quantiles", sql(["qc_cells"], "\nUNION ALL ".join(
    f"""SELECT '{m}' AS metric, {R(f'quantile_cont({m}::DOUBLE, 0.25)')} AS q25, {R(f'quantile_cont({m}::DOUBLE, 0.75)')} AS q75
    FROM qc_cells""" for m in ("n_feature", "n_count", "pct_mt"))))
def qc_violin_quantiles(spark, d):
    from nucleoflow.functions import ordering as O

    long = qc.metric_long(_metrics(spark, d), ["n_feature", "n_count", "pct_mt"])
    return rounded(O.exact_quantiles(long, "value", {"q25": 0.25, "q75": 0.75}, ["metric"]), "q25", "q75")
