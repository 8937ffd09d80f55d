"""Splits, samples and variants that follow from keys alone, so they are alike on every run and machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx


def holdout(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """df with is_test; rows of a group stay together."""
    return df.withColumn("is_test", tx.bucket(F.col(group), seed) < share)


def shared_texts(df: DataFrame, text: str) -> DataFrame:
    """Digests of texts that stand on both sides of a split."""
    sides = df.groupBy(F.md5(text).alias("h")).agg(F.max("is_test").alias("a"), F.min("is_test").alias("b"))
    return sides.where("a AND NOT b").select("h")


def variant(key: Column, seed: str, shares: list[tuple[str, float]]) -> Column:
    """The variant of a key by cumulative shares; what is left goes to the last."""
    at, out, bucket = 0.0, None, tx.bucket(key, seed)
    for name, share in shares[:-1]:
        at += share
        out = F.when(bucket < at, name) if out is None else out.when(bucket < at, name)
    return out.otherwise(shares[-1][0])


def sample_per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, those of the least bucket."""
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(tx.bucket(F.col(key), seed), key))
    return df.withColumn("__r", order).where(F.col("__r") <= n).drop("__r")
