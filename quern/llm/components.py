"""Connected components of links between ids, as Spark jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table with two or three numbers each that is broadcast at most; larger ones are joined by a shuffle.
FEW_ROWS = 500_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster shares. A session in one process may do without: it gets a folder of its own."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def _delete(df: DataFrame, path: str, on_exit: bool) -> None:
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place) if on_exit else files.delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the checkpoint folder that the cluster shares, and read from there: its lineage ends here.

    The files go when forget() is called, or else when the application ends.
    """
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _delete(df, path, on_exit=True)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what cut() has written. Nothing that is still to be computed may read it."""
    for df in tables:
        _delete(df, df._cut_path, on_exit=False)


def few(df: DataFrame) -> DataFrame:
    """A table of small rows for the second side of a join: broadcast if it is known to be small. df should be cut."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that a link names; component_id is the smallest id that links reach.

    Links become stars around the smallest id by turns of large-star and small-star steps, in a number of rounds that
    grows with the logarithm of the longest path, until a round changes nothing. A step joins each link with the least
    neighbour of its end, so no task holds all the neighbours of an id, and Spark can split the joins of frequent ones.
    Links with a null end are left out; repeated links and links of an id with itself are harmless.
    """
    kept = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    # A link of an id with itself stays beside the others, as a row that no step changes.
    edges = cut(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    wide = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(20,0)")) for seed in (1, 2)]
    state, now = None, edges.agg(F.count("*"), *wide).first()
    while now != state and now[0]:
        state, before = now, edges
        alone, apart = edges.where("u = v"), edges.where("u != v")
        # Large star: neighbours above an id go to the least of its neighbours and itself.
        both = apart.union(apart.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: an id and its neighbours below go to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.union(alone).distinct())
        now = edges.agg(F.count("*"), *wide).first()
        forget(before)
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = found.select(F.col("component_id").alias("id"), "component_id")
    return found.union(roots).groupBy("id").agg(F.min("component_id").alias("component_id"))
