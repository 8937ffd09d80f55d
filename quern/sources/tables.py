"""Input tables, and tables that a query writes on its way."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, amount: int | None, each: int) -> int:
    """Into how many partitions to deal so that one gets about `each` of the amount: a task stays as small on larger tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((amount or 0) / each))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A session in one process may do without: it gets one of its own."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def written(df: DataFrame) -> DataFrame:
    """df computed once: written to the shared folder and read from there. The files go with dropped(), or when the application ends."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what written() has made. Nothing that is still to be computed may read it."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
