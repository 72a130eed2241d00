"""Incremental forms of the two resumable batch steps.

Files that arrive in a folder are annotated once each, with the answers kept as
they come; a restart continues from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nucleoflow.operators import annotate

QUERY_SCHEMA = "query_id BIGINT, tissue STRING, genes ARRAY<STRING>"


def annotate_arrivals(
    spark: SparkSession, folder: str, markers: DataFrame, out: str, checkpoint: str, schema: str = QUERY_SCHEMA
):
    """Annotate every JSON file of ``folder`` not seen before, then stop.

    Each micro-batch is saved under its own number, so a replayed batch replaces
    its own rows and nothing is stored twice.
    """

    def save(batch: DataFrame, number: int) -> None:
        annotate.batch_annotate(batch, markers).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(folder)
    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
