from pathlib import Path

from pyspark.sql import functions as F

from nucleoflow import session


def test_shuffles_go_with_what_needed_them(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if Path(f).name.startswith("shuffle_")}

    before = shuffled()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = session.materialize(counts), session.written(counts)
    assert shuffled() <= before
    assert [x.count() for x in kept] == [7, 7] and counts.count() == 7
