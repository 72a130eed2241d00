"""The canonical tables, derived from the star-schema test tables.

A customer is a cell, a part is a gene and a peak, a supplier is a factor, and
line items are the observations. Each function reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoflow.functions import ordering as O

LINK_DISTANCE = 2500.0
N_BINS = 100


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("cell_id"),
        F.col("l_partkey").alias("feature_id"),
        F.col("l_suppkey").alias("tf"),
        "l_quantity",
        "l_discount",
        "o_orderstatus",
    )


def rna(spark, folder) -> DataFrame:
    return observations(spark, folder).groupBy("cell_id", "feature_id").agg(
        F.sum("l_quantity").alias("value")
    )


def atac(spark, folder) -> DataFrame:
    return observations(spark, folder).groupBy("cell_id", "feature_id").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def activity(spark, folder) -> DataFrame:
    """Signed factor activity per cell."""
    gain = F.col("l_quantity") * (F.round(F.col("l_discount") * 100) - 5)
    return observations(spark, folder).groupBy("cell_id", F.col("tf").alias("feature_id")).agg(
        F.sum(gain).alias("value")
    )


def cells(spark, folder) -> DataFrame:
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("cell_type"),
        "c_acctbal",
    )
    return O.with_ranks(c, "c_acctbal", {"_q": O.empirical_quantile()}, fixed=True).select(
        "cell_id", "name", "cell_type", "c_acctbal", (F.col("_q") * 100).alias("trajectory")
    )


def features(spark, folder) -> DataFrame:
    position = F.col("p_size").cast("bigint") * 1000 + F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("feature_id"),
        F.col("p_name").alias("symbol"),
        F.col("p_brand").alias("chr"),
        position.alias("start"),
        (position + 100).alias("end"),
        F.when(F.col("p_type").isin("SMALL", "PROMO"), "-").otherwise("+").alias("strand"),
        F.col("p_type").alias("kind"),
        F.col("p_size"),
    )


def genes(spark, folder) -> DataFrame:
    return features(spark, folder).select(F.col("feature_id").alias("gene"), "chr", "start", "end", "strand")


def peaks(spark, folder) -> DataFrame:
    return features(spark, folder).select(F.col("feature_id").alias("peak"), "chr", "start", "end")


def peak_names(spark, folder) -> DataFrame:
    """Text keys in both notations, some on non-standard chromosomes."""
    f = features(spark, folder)
    sep = F.when(F.col("kind").isin("LARGE", "MEDIUM"), "-").otherwise(":")
    return f.select(
        "feature_id",
        F.concat(
            F.lit("chr"), F.col("p_size").cast("string"), sep, F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")
        ).alias("name"),
    )


def motif_match(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").alias("peak"), F.col("l_suppkey").alias("tf")
    ).agg(F.count(F.lit(1)).cast("double").alias("score"))


def brand_correlation(spark, folder) -> DataFrame:
    """(tf, gene=brand, correlation) of quantity and price, from moments."""
    li = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    j = li.join(part, li.l_partkey == part.p_partkey)
    m = j.groupBy(F.col("l_suppkey").alias("tf"), F.col("p_brand").alias("gene")).agg(
        F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")
    )
    return m.select("tf", "gene", F.try_divide(F.col("c"), F.col("sx") * F.col("sy")).alias("correlation"))


def brand_links(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("peak"), F.col("p_brand").alias("gene")
    )


def vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cell_idx"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def predicted(spark, folder) -> DataFrame:
    """Truth and a label that disagrees on a third of the cells."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cell_idx"),
        F.col("label").alias("true_label"),
        F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10)
        .otherwise(F.col("label"))
        .cast("int")
        .alias("pred_label"),
    )


N_ITER = 3


def iterations(spark) -> DataFrame:
    return spark.range(N_ITER).select(F.col("id").cast("int").alias("iter"))


def all_labels(spark, folder) -> DataFrame:
    """Labels of four methods for every cell and iteration, -1 for noise."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("cell_idx"), "label")
    e = e.withColumn("iter", F.explode(F.array(*[F.lit(i) for i in range(N_ITER)])))
    v, l, t = F.col("cell_idx"), F.col("label"), F.col("iter")
    methods = F.array(
        F.struct(F.lit("Kmeans").alias("method"), l.cast("int").alias("label")),
        F.struct(F.lit("Seurat").alias("method"), ((l + (v + t) % 2) % 10).cast("int").alias("label")),
        F.struct(F.lit("ACM_WEP").alias("method"), ((l + v % (t + 2)) % 5).cast("int").alias("label")),
        F.struct(
            F.lit("Hierarchical").alias("method"),
            F.when((v + t) % 7 == 0, -1).otherwise(l % 4).cast("int").alias("label"),
        ),
    )
    return e.select("cell_idx", "iter", F.explode(methods).alias("m")).select("iter", "m.method", "cell_idx", "m.label")


def iter_labels(spark, folder) -> DataFrame:
    from nucleoflow.operators import consensus

    cells_ = table(spark, folder, "embeddings").select(F.col("vec_id").alias("cell_idx"))
    drawn = consensus.sample_cells(cells_, iterations(spark), 0.8)
    return all_labels(spark, folder).join(drawn, ["iter", "cell_idx"], "left_semi")


def gene_scores(spark, folder) -> DataFrame:
    """Score of a part (gene) per supplier nation (iteration)."""
    li = table(spark, folder, "lineitem")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy(
        F.col("s_nationkey").alias("iter"), F.col("l_partkey").alias("gene")
    ).agg((F.log1p(F.avg("l_quantity")) / 4).alias("score"))


def document_markers(spark, folder) -> DataFrame:
    """Words are genes, a document's source is a cell type, its language a tissue."""
    docs = table(spark, folder, "documents")
    words = docs.select(
        F.col("lang").alias("tissue_raw"),
        F.col("source").alias("cell_type"),
        F.explode(F.split(F.regexp_replace(F.upper("text"), "[^A-Z]+", " "), " ")).alias("gene"),
    ).where(F.length("gene") >= 4).distinct()
    total = words.groupBy("tissue_raw", "cell_type").agg(
        F.count(F.lit(1)).cast("int").alias("total_markers")
    )
    return words.join(total, ["tissue_raw", "cell_type"]).select(
        F.concat(F.upper(F.substring("tissue_raw", 1, 1)), F.substring("tissue_raw", 2, 10)).alias("tissue"),
        "cell_type",
        "gene",
        F.lit(None).cast("string").alias("alias"),
        "total_markers",
        F.lit("Normal").alias("cancer_type"),
    )


def benchmark_queries(spark, folder) -> DataFrame:
    b = table(spark, folder, "benchmark")
    words = F.split(F.regexp_replace(F.upper("text"), "[^A-Z]+", " "), " ")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("item_id") % 2 == 0, "en").alias("tissue"),
        F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4)).alias("genes"),
    )
