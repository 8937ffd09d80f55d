"""Rankings, budgets, islands and as-of lookups over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank. Spark keeps only n rows of a group before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, number).where(F.col(rank) <= n)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so rows are thinned out before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*keys, "__last.*")


def islands(df: DataFrame, keys: list[str], time: str, gap_seconds: int) -> DataFrame:
    """df with the number of its island: a row more than the gap after the one before starts a new one."""
    order = Window.partitionBy(*keys).orderBy(time)
    apart = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp"))
    starts = F.coalesce(apart > gap_seconds * 1_000_000, F.lit(True)).cast("long")
    return df.withColumn("__starts", starts).withColumn("island", F.sum("__starts").over(order)).drop("__starts")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows whose running cost, in order, stays within the budget."""
    so_far = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", so_far).where(F.col("used") <= budget)


def as_of(df: DataFrame, others: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """df with the value of the last other row of its keys at or before its time.

    Both sides are merged by one sort on keys and time: no pairs are made.
    """
    left = df.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(others.schema[value].dataType)})
    right = others.select(*keys, time, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("__v", ignorenulls=True).over(order)).where("__side = 1").drop("__side", "__v")


def covered_time(df: DataFrame, key: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """(key, n, total, covered, span, islands): of the intervals of each key their number, summed length, the length of
    what they cover together, from the first start to the last end, and the number of stretches without a gap.

    start and end are whole numbers of seconds; intervals that touch leave no gap. Intervals of a key are dealt by the
    time they start, so that no task sorts all of a frequent key; what is still open at the start of a piece of time
    comes from the latest ends of the pieces before. Intervals with a null, or an end before the start, are left out.
    """
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s <= e")
    rows = rows.withColumn("piece", F.floor(F.col("s") / bucket_seconds))
    # A row for each key and piece of time.
    earlier = Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    open_ = rows.groupBy("k", "piece").agg(F.max("e").alias("last")).withColumn("open", F.max("last").over(earlier)).select(F.col("k").alias("k2"), F.col("piece").alias("p2"), "open")
    rows = rows.join(open_, F.col("k").eqNullSafe(F.col("k2")) & (F.col("piece") == F.col("p2")))
    before = Window.partitionBy("k", "piece").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reached", F.greatest(F.max("e").over(before), F.col("open")))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))
    apart = F.col("reached").isNull() | (F.col("s") > F.col("reached"))
    told = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("total"), F.sum(new).alias("covered"), (F.max("e") - F.min("s")).alias("span"), F.count_if(apart).alias("islands")
    )
    return told.withColumnRenamed("k", key)
