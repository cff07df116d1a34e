"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Setting by which Spark deletes an execution's shuffle files once it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one, on local masters only, a new one in the warehouse; elsewhere it must be set."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


@contextmanager
def cleaned(spark: SparkSession):
    """What is executed inside leaves no shuffle files: its plans are executed once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, *folders: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read again, and where it lies; values of columns named in ``folders`` get a folder each.

    Its shuffle files go with the write, so a chain of kept tables needs no more disk than its largest step and the tables.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with cleaned(spark):
        (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a kept table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
