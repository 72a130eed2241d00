"""Cell-type candidates from a marker table, and supplied-label lookups."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nucleoflow.functions import strings as S


def candidates(queries: DataFrame, markers: DataFrame, top_k: int | None = 3) -> DataFrame:
    """Best (cell type, tissue) entries for every gene list at once.

    ``queries``: query_id, tissue (NULL allowed), genes ARRAY<STRING>.
    ``markers``: tissue, cell_type, gene, alias, total_markers, cancer_type.
    Genes match the main name, else the alias. Scores are rounded to 4 digits
    before they are ordered; ties fall to cell type then tissue.
    """
    q = queries.select(
        "query_id", S.tissue_key(F.col("tissue")).alias("want"), F.array_distinct("genes").alias("genes")
    ).withColumn("n_query", F.size("genes"))
    wanted = q.select("query_id", F.explode("genes").alias("hit"))
    main = markers.select("tissue", "cell_type", F.col("gene").alias("hit"), "alias")
    by_main = wanted.join(main.drop("alias"), "hit")
    # The alias counts only where the main name of that marker is not in the query.
    by_alias = (
        wanted.join(
            markers.where(F.col("alias").isNotNull()).select(
                "tissue", "cell_type", "gene", F.col("alias").alias("hit")
            ),
            "hit",
        )
        .join(wanted.withColumnRenamed("hit", "gene"), ["query_id", "gene"], "left_anti")
        .drop("gene")
    )
    hits = (
        by_main.unionByName(by_alias)
        .distinct()
        .groupBy("query_id", "cell_type", "tissue")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    sizes = markers.groupBy("cell_type", "tissue").agg(
        F.max("total_markers").alias("total_markers"), F.min("cancer_type").alias("cancer_type")
    )
    scored = hits.join(sizes, ["cell_type", "tissue"]).join(q.drop("genes"), "query_id")
    jaccard = S.safe_divide(F.col("hits"), F.col("n_query") + F.col("total_markers") - F.col("hits"))
    weight = F.when(F.col("tissue") == F.col("want"), F.lit(1.5)).otherwise(F.lit(1.0))
    scored = scored.select(
        "query_id",
        "cell_type",
        "tissue",
        "hits",
        F.round(S.safe_divide(F.col("hits"), F.col("total_markers")), 4).alias("recall"),
        F.round(jaccard, 4).alias("jaccard"),
        F.round(jaccard * weight, 4).alias("weighted_jaccard"),
        "total_markers",
        "cancer_type",
    )
    if top_k is None:
        return scored
    order = Window.partitionBy("query_id").orderBy(
        F.desc("weighted_jaccard"), F.asc("cell_type"), F.asc("tissue")
    )
    return scored.withColumn("candidate_rank", F.row_number().over(order)).where(
        F.col("candidate_rank") <= top_k
    )


def explode_knowledge_base(kb: DataFrame) -> DataFrame:
    """Marker rows from (tissue, gene_index MAP, cell_metadata MAP)."""
    per_gene = kb.select("tissue", "cell_metadata", F.explode("gene_index").alias("g", "types"))
    rows = per_gene.select(
        "tissue",
        F.explode("types").alias("cell_type"),
        S.marker_main(F.col("g")).alias("gene"),
        S.marker_alias(F.col("g")).alias("alias"),
        "cell_metadata",
    )
    meta = F.try_element_at("cell_metadata", "cell_type")
    return rows.select(
        "tissue",
        "cell_type",
        "gene",
        "alias",
        F.coalesce(meta["total_markers"], F.lit(0)).alias("total_markers"),
        F.coalesce(meta["cancer_type"], F.lit("Unknown")).alias("cancer_type"),
    )


def batch_annotate(queries: DataFrame, markers: DataFrame) -> DataFrame:
    """One row per query: the offline answer, or why there is none."""
    empty = F.col("genes").isNull() | (F.size("genes") == 0)
    best = candidates(queries.where(~empty), markers, 1).drop("candidate_rank")
    best = best.withColumnsRenamed({"tissue": "matched_tissue"})
    return (
        queries.select("query_id", "tissue", empty.alias("_e"))
        .join(best, "query_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_e"), "null value")
            .when(F.col("cell_type").isNull(), "No candidate found")
            .otherwise("(API not called)"),
        )
        .drop("_e")
    )


#: Seconds to wait after each attempt that failed but the last.
BACK_OFF = (1.0, 2.0, 4.0)


def annotate_with(
    queries: DataFrame, call: Callable[[str], str], prompt: str = "prompt", back_off: tuple[float, ...] = BACK_OFF
) -> DataFrame:
    """Send each prompt to a caller-supplied function; failures become text.

    A prompt is tried once and again after each wait of ``back_off``. A null
    prompt isn't sent and has a null answer.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for text in batch[prompt]:
                if pd.isna(text):
                    answers.append(None)
                    continue
                error = None
                for wait in (0.0, *back_off):
                    time.sleep(wait)
                    try:
                        answers.append(call(text))
                        break
                    except Exception as exc:
                        error = exc
                else:
                    answers.append(f"ERROR: {error}")
            yield batch.assign(answer=answers)

    return queries.mapInPandas(run, f"{fields}, answer string")


def marker_lists(markers: DataFrame, n: int = 10) -> DataFrame:
    """First n marker names per cluster joined by comma, in rank order."""
    first = markers.where(F.col("marker_rank") <= n).groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("marker_rank", F.col("gene").alias("g")))).alias("m")
    )
    return first.select(
        "cluster", F.array_join(F.transform("m", lambda x: x["g"].cast("string")), ", ").alias("markers")
    )


def clean_labels(metadata: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Trimmed key, first row per key in ``order``, empty label -> Unknown."""
    text = F.coalesce(F.nullif(F.trim(F.col(label)), F.lit("")), F.lit("Unknown"))
    return metadata.groupBy(F.trim(F.col(key)).alias(key)).agg(
        F.min_by(text, F.col(order)).alias(label)
    )


def label_with_fallback(
    names: DataFrame, metadata: DataFrame, key: str, label: str, default: str = "Unknown"
) -> DataFrame:
    """Look a barcode up as it is, else without ``-1``; unmatched gets the default.

    ``metadata`` has unique keys.
    """
    exact = metadata.select(F.col(key).alias("name"), F.col(label).alias("_a"))
    short = metadata.select(F.col(key).alias("_short"), F.col(label).alias("_b"))
    joined = (
        names.withColumn("_short", S.without_barcode_suffix(F.col("name")))
        .join(exact, "name", "left")
        .join(short, "_short", "left")
    )
    return joined.withColumn(label, F.coalesce("_a", "_b", F.lit(default))).drop("_a", "_b", "_short")


def barcode_overlap(cells: DataFrame, fragments: DataFrame) -> DataFrame:
    """Cells found among fragment barcodes directly, without and with ``-1``.

    One row. Distinct barcodes are joined, never gathered.
    """
    seen = fragments.where(F.col("barcode").isNotNull()).select("barcode").distinct()
    counts = []
    for how, name in (
        ("direct", F.col("name")),
        ("suffix_removed", S.without_barcode_suffix(F.col("name"))),
        ("suffix_added", S.with_barcode_suffix(F.col("name"))),
    ):
        keyed = cells.select(name.alias("barcode")).distinct()
        found = keyed.join(seen, "barcode", "left_semi")
        counts.append(found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n"))
    total = cells.agg(F.count(F.lit(1)).alias("n")).select(F.lit("cells").alias("how"), "n")
    out = total
    for c in counts:
        out = out.unionByName(c)
    return out


def rewrite_for_fragments(cells: DataFrame, fragments: DataFrame, min_rate: float = 0.1) -> DataFrame:
    """Add the suffix to every barcode when only that makes them match."""
    stats = {r["how"]: r["n"] for r in barcode_overlap(cells, fragments).collect()}
    need = stats["direct"] == 0 and stats["suffix_added"] >= min_rate * max(stats["cells"], 1)
    name: Column = S.with_barcode_suffix(F.col("name")) if need else F.col("name")
    return cells.withColumn("fragment_name", name)


def token_estimate(text: Column) -> Column:
    """Length estimate by character class, truncated.

    Ideographs count once on their own and again as letters.
    """
    ideographs = F.regexp_count(text, F.lit("[\\x{4e00}-\\x{9fff}]"))
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    digits = F.regexp_count(text, F.lit("\\p{Nd}"))
    symbols = F.regexp_count(text, F.lit("[^\\p{L}\\p{Nd}\\s]"))
    return F.floor(ideographs + letters * 0.5 + digits * 0.5 + symbols * 0.3).cast("bigint")
