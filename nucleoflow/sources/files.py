"""Small files in whatever file system their path names, through Spark's own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str):
    """(file system, path) as the cluster sees them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = located(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = located(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of one small file."""
    row = spark.read.text(str(path), wholetext=True).first()
    return row.value if row else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it exists; missing folders are made."""
    fs, target = located(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def newest(spark: SparkSession, folder: str, pattern: str) -> str:
    """Most recently changed match of ``pattern`` in ``folder``; of equally old ones the last by name."""
    fs, target = located(spark, f"{folder}/{pattern}")
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(target) or []]
    if not found:
        raise FileNotFoundError(f"nothing matches {pattern} in {folder}")
    return max(found)[1]
