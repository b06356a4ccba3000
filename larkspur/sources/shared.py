"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, computes each row once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/larkspur/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once all that reads them has been written too; others are left alone."""
    for table in tables:
        path = table.__dict__.get("_written_to")
        if path:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
