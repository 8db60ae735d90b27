"""Tables written once and read again: parsed grids, so that no file is decoded twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share. A session on one machine that
    names none gets a temporary one; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gridloom-grid-{uuid.uuid4().hex}"


#: Rows in one file of a kept table, so that what comes from one file of a source is read again by many tasks.
ROWS = 1 << 12


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """df from a written table, and the table's folder."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
