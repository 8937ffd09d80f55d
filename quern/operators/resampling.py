"""Tests of a mean difference whose rows come in clusters: cluster bootstrap and sign flips.

Turns of one conversation tend to pass and fail together, so whole clusters are drawn and flipped. A cluster is its sum
and its number of rows; clusters equal in both are one kind. Every resample needs the kinds only, never the rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .metrics import nearest_rank

#: Up to so many clusters of a kind are drawn one by one; of more, the sum of the draws is taken as a rounded normal number.
ONE_BY_ONE = 32


def poisson_bounds(least: float = 1e-12) -> list[float]:
    """P(X <= k), k = 0, 1, ..., for a Poisson number of mean 1, until the rest is below `least`."""
    sums = itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(40))
    return [*itertools.takewhile(lambda p: p < 1 - least, sums)]


def cluster_test(df: DataFrame, cluster: str, value: str, times: int = 2_000) -> DataFrame:
    """One row (n_rows, n_clusters, delta, low, high, p_value) for the mean of `value`, resampling whole clusters.

    low, high: bounds of 95 % of the means over `times` Poisson resamples of the clusters (weights of mean 1).
    p_value: (1 + flips at least as far from 0 as delta) / (1 + times), a sign drawn for each cluster.
    All draws follow from the resample and the kind of a cluster (its rounded sum and its size), so results repeat.
    Rows without cluster or value are left out; without rows, delta and bounds are null and p_value is 1.
    """
    rows = df.select(F.col(cluster).alias("c"), F.col(value).cast("double").alias("v")).where("c IS NOT NULL AND v IS NOT NULL")
    sums = rows.groupBy("c").agg(F.round(F.sum("v"), 9).alias("s"), F.count("*").alias("m"))
    # -0.0 + 0.0 is 0.0: the sum's text is part of the draws' key.
    kinds = sums.groupBy((F.col("s") + 0.0).alias("s"), "m").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("few", F.col("n") <= ONE_BY_ONE).withColumn("name", F.concat_ws(":", F.round(F.col("s") * 10**9).cast("decimal(38,0)").cast("string"), F.col("m").cast("string")))
    drawn = kinds.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(1), F.when(F.col("few"), F.col("n")).otherwise(F.lit(1)))))
    key = F.concat_ws(":", F.col("r").cast("string"), "name", F.col("j").cast("string"))
    u = {part: tx.bucket(key, part) for part in ("weight", "sign", "radius", "angle", "radius2", "angle2")}

    def normal(radius: Column, angle: Column) -> Column:
        return F.sqrt(-2 * F.log(1 - radius)) * F.cos(2 * math.pi * angle)

    alone = sum((u["weight"] >= b).cast("double") for b in poisson_bounds())
    many = F.greatest(F.round(F.col("n") + F.sqrt("n") * normal(u["radius"], u["angle"])), F.lit(0.0))
    weight = F.when(F.col("few"), alone).otherwise(many)
    ups = F.least(F.greatest(F.round(F.col("n") / 2 + F.sqrt("n") / 2 * normal(u["radius2"], u["angle2"])), F.lit(0.0)), F.col("n").cast("double"))
    sign = F.when(F.col("few"), F.when(u["sign"] < 0.5, 1.0).otherwise(-1.0)).otherwise(2 * ups - F.col("n"))
    each = drawn.select("r", "s", "m", weight.alias("w"), sign.alias("f"))
    resamples = each.groupBy("r").agg(F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum(F.col("w") * F.col("m")).alias("wm"), F.sum(F.col("f") * F.col("s")).alias("fs"))
    whole = kinds.agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_clusters"), F.sum(F.col("s") * F.col("n")).alias("total"))
    # One row on this side: what is joined is the resamples.
    joined = F.broadcast(whole).join(resamples, F.col("n_rows") > 0, "left")
    mean = F.when(F.col("wm") > 0, F.round(F.col("ws") / F.col("wm"), 6))
    out = joined.withColumn("mean", mean).groupBy("n_rows", "n_clusters", "total").agg(
        nearest_rank("mean", 0.025).alias("low"),
        nearest_rank("mean", 0.975).alias("high"),
        F.count_if(F.abs("fs") >= F.abs("total") - 1e-9).alias("far"),
    )
    p = F.when(F.col("n_rows") > 0, F.round((F.col("far") + 1) / (times + 1), 6)).otherwise(1.0)
    return out.select("n_rows", "n_clusters", F.round(F.col("total") / F.when(F.col("n_rows") > 0, F.col("n_rows")), 6).alias("delta"), "low", "high", p.alias("p_value"))
