"""Session construction and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "nucleoflow", master: str | None = None, **conf) -> SparkSession:
    """Create a session; on a cluster ``master`` is left to spark-submit.

    Shuffle partitions start high and are merged by adaptive execution, so the
    same code serves a laptop and a thousand executors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Tile rows carry whole blocks, so a batch must not hold many of them.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_nucleoflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="nucleoflow-src-")) / "nucleoflow-src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._nucleoflow_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only by a local master, where the driver's disk is every task's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="nucleoflow-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(configured)
    return configured


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run inside go as soon as it has run, not when the driver's memory is next collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(key)
    except PySparkException:  # Spark before 4.1 has no such setting
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(spark: SparkSession) -> None:
    """Have the driver's memory collected, so that Spark removes the checkpoints of frames that are gone (``cleanCheckpoints``)."""
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store reliably, and drop the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that its shuffles go


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back.

    Unlike a checkpoint it carries no constraints on: in loops of self-joins
    those double with every round, and with them the time to plan it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with tidy_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
