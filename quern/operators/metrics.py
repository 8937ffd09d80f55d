"""Measures over evaluation and telemetry rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of a share."""
    p = hits / n
    centre, width, base = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (centre - width) / base, (centre + width) / base


def nearest_rank(value: str, q: float) -> Column:
    """The ceil(q n)-th smallest value."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("n"))


def label_report(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Support, precision, recall and F1 of each label; empty denominators give 0."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("s")), F.struct(F.col(said).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("s")))).alias("x"), (F.col(truth) == F.col(said)).cast("int").alias("hit"))
    sums = sides.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.s").alias("said"), F.sum(F.col("x.t") * F.col("hit")).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("said"), 0.0), ratio(F.col("tp"), F.col("support"), 0.0)
    return sums.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r, 0.0), 6).alias("f1"))


def threshold_sweep(df: DataFrame, score: str, truth: str, steps: int) -> DataFrame:
    """tp, fp, fn, tn at each of steps + 1 even thresholds (said: score >= threshold).

    Scores are counted by the highest threshold that they reach; running sums over these few counts give the rest.
    """
    reached = df.select(F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).cast("int").alias("step"), F.col(truth).alias("y"))
    counts = reached.groupBy("step").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    every = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    counts = every.join(counts, "step", "left").fillna(0)
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counts.select("step", F.sum("pos").over(down).alias("tp"), F.sum(F.col("n") - F.col("pos")).over(down).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("n").over(whole).alias("all"))
    return out.select("step", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("all") - F.col("p") - F.col("fp")).alias("tn"))


def calibration(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Mean score and share of true rows in equal bins of the score; the last bin is closed, empty ones are left out."""
    number = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(number).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("accuracy"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: observed agreement, agreement by chance, and Cohen's kappa."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("x"))
    columns = cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    both = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("all"), F.col("xy") / (F.col("all") * F.col("all"))
    return both.select(F.round(po, 6).alias("observed"), F.round(pe, 6).alias("chance"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


def resampled_means(counts: DataFrame, group: str, value: str, n: str, times: int) -> DataFrame:
    """(group, low, high, n): bounds of the mean of each group over resamples, from how often each value occurs.

    n rows of one value have Poisson weights of 1 each; the weight of all of them is Poisson of n, taken here as
    round(n + sqrt(n) z), z normal from two numbers that follow from the resample, the group and the value. So a
    resample costs one number for each distinct value, however many rows there are.
    """
    rows = counts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("r", group, value)])
    z = F.sqrt(-2 * F.log(1 - tx.bucket(key, "radius"))) * F.cos(2 * math.pi * tx.bucket(key, "angle"))
    weight = F.greatest(F.round(F.col(n) + F.sqrt(n) * z), F.lit(0.0))
    sums = rows.groupBy(group, "r").agg(F.sum(weight * F.col(value)).alias("s"), F.sum(weight).alias("w")).where("w > 0")
    means = sums.select(group, F.round(F.col("s") / F.col("w"), 6).alias("mean"))
    return means.groupBy(group).agg(nearest_rank("mean", 0.025).alias("low"), nearest_rank("mean", 0.975).alias("high"), F.count("*").alias("n"))
