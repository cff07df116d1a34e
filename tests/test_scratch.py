from pyspark.sql import functions as F

from commitloom import scratch


def test_a_kept_table_leaves_no_shuffle_files(spark):
    files = lambda: [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]
    before, setting = set(files()), spark.conf.get(scratch.CLEANUP)
    rows = spark.range(10_000).select((F.col("id") % 1_000).alias("k"), "id").groupBy("k").agg(F.sum("id").alias("n"))
    kept, _ = scratch.keep(rows.join(rows.withColumnRenamed("n", "m"), "k"))
    assert set(files()) <= before
    assert spark.conf.get(scratch.CLEANUP) == setting
    assert (kept.count(), rows.count(), rows.count()) == (1_000, 1_000, 1_000)
