"""Texts cut into chunks: one row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx


def word_windows(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of words that share `overlap` words; texts without words give no row."""
    rows = df.withColumn("__w", tx.words(F.col(text)))
    rows = rows.select("*", F.posexplode(tx.word_windows(F.col("__w"), size, overlap)).alias("position", "__at"))
    own = F.slice("__w", F.col("__at") + 1, F.lit(size))
    rows = rows.withColumns({"position": F.col("position").cast("long"), "n_words": F.size(own), "chunk": F.array_join(own, " ")})
    return rows.drop("__w", "__at")


def char_windows(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of characters that share `overlap` of them."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int")
    rows = df.where(n > 0).withColumn("position", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumns({"chunk": F.substring(F.col(text), F.col("position") * (size - overlap) + 1, F.lit(size)), "position": F.col("position").cast("long")})


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of a text with where each starts."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("position", "chunk"))
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("chunk") + 1).over(before), F.lit(0)).cast("long")
    return rows.select(key, F.col("position").cast("long").alias("position"), start.alias("char_start"), F.length("chunk").cast("long").alias("n_chars"), "chunk")
