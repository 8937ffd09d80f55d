"""Copies and near copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import pieces, written
from .graphs import components


PRIME = 2_147_483_647
#: Keys that are broadcast at most; shingles of sets that one task compares, about; longs of a set's sketch.
FEW, SHINGLES, LONGS = 500_000, 4_000_000, 8


def dropped_copies(df: DataFrame, scope: list[str], text: str, key: str) -> DataFrame:
    """(dropped, kept): of equal texts in the same scope the newest (largest key) stays.

    Only digests and keys are shuffled; they are added up before the shuffle.
    """
    rows = df.select(*scope, F.md5(text).alias("h"), F.col(key).alias("k"))
    newest = rows.groupBy(*scope, "h").agg(F.max("k").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(newest, [*scope, "h"]).where("k != kept").select(F.col("k").alias("dropped"), "kept")


def minhash(codes: Column, hashes: int, seed: int = 7) -> Column:
    """The least of each of several hashes of a set of 64-bit hashes, and behind them the set's sketch: set by set in Arrow batches, all hashes of a set at once."""
    numbers = np.arange(hashes)
    a = (2 * ((seed * 7_919 + numbers * 104_729) % 1_000_003) + 1).astype(np.int64)
    b = ((seed * 15_485_863 + numbers * 32_452_843) % PRIME).astype(np.int64)

    @F.pandas_udf("array<long>")
    def least(sets: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or not len(s) else np.append(_least(np.asarray(s), a, b), _sketch(np.asarray(s))) for s in sets], dtype=object)

    return least(F.transform(codes, lambda s: F.pmod(s, F.lit(PRIME))))


def _least(codes: np.ndarray, a: np.ndarray, b: np.ndarray, piece: int = 4096) -> np.ndarray:
    out = np.full(len(a), PRIME, np.int64)
    for at in range(0, len(codes), piece):
        out = np.minimum(out, ((codes[at : at + piece, None] * a + b) % PRIME).min(axis=0))
    return out


def _sketch(codes: np.ndarray) -> np.ndarray:
    """LONGS words whose bits are the parities of how many codes fall to them: sets differ in as many members, at least, as sketches in bits."""
    return np.packbits((np.bincount(codes % (64 * LONGS), minlength=64 * LONGS) & 1).astype(np.uint8)).view(np.int64)


def _classes(rows: DataFrame) -> DataFrame:
    """Classes of equal texts (h), whose smallest key stands for them: only digests and keys are shuffled."""
    return rows.groupBy("h").agg(F.min("k").alias("k"))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, t): texts that are not blank, with their digests."""
    return df.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(k, h, s) of texts with words: the 64-bit hashes of their shingles."""
    words = rows.where(F.col("t").rlike("[^ \t\n\r]")).select("k", "h", tx.words(F.col("t")).alias("w"))  # a column of its own, or each shingle would cut the text anew
    return words.select("k", "h", F.transform(tx.shingles(F.col("w"), width), lambda x: F.xxhash64(x)).alias("s"))


def _among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows with one of the keys; these are broadcast if they are few, and else hashed, so that rows are not sorted."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys.hint("shuffle_hash"), on, "left_semi")


def minhash_pairs(df: DataFrame, key: str, text: str, least: float, width: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """(a, b, jaccard): pairs of distinct texts that share a band of their MinHash signatures and are similar enough.

    The pairs connect all texts that such pairs link: members of a band are compared with its smallest key first, then
    all those with each other that these links leave in different components. Links inside a component can be left out.

    Signatures are made where a text is read. Of texts that share a band with another the shingles are made once more and
    travel as 64-bit hashes: two texts of 500 words have different shingles of the same hash once in 10^13 pairs of texts.
    """
    texts = _keyed(df, key, text)
    sets = _sets(texts, width)
    value = lambda m: F.array(*[F.xxhash64(F.lit(i), F.slice(m, i * rows + 1, rows)) for i in range(bands)])
    signed = written(sets.select("k", "h", F.size("s").alias("n"), minhash(F.col("s"), bands * rows).alias("m")).select("k", "h", "n", value(F.col("m")).alias("values"), F.slice("m", bands * rows + 1, LONGS).alias("sketch")))
    signed = signed.join(_classes(signed), ["h", "k"], "left_semi")
    banded = written(signed.select("k", "h", "n", F.explode("values").alias("value")))
    heads = banded.groupBy("value").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a != z").select("value", "a")
    near = written(banded.join(heads, "value"))
    met = written(_sets(_among(texts, written(near.select("k", "h").distinct()), ["k", "h"]), width).select("k", "s"))

    def similar(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n), n shingles in b, those similar enough."""
        pairs = written(pairs)
        keys = written(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
        own = _among(met, keys, ["k"]) if keys.count() <= FEW else met
        parts = pieces(df.sparkSession, pairs.agg(F.sum("n")).first()[0], SHINGLES)
        both = pairs.repartition(parts, "a").join(own.select(F.col("k").alias("a"), F.col("s").alias("sa")).repartition(parts, "a"), "a").where(_enough(F.size("sa"), F.col("n"), F.lit(0), least))
        both = both.repartition(parts, "b").join(own.select(F.col("k").alias("b"), F.col("s").alias("sb")).repartition(parts, "b"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        jaccard = F.round(shared / (F.size("sa") + F.size("sb") - shared), 6)
        return written(both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= least))

    stars = similar(near.where("a != k").select("a", F.col("k").alias("b"), "n").distinct())
    found = components(stars.select("a", "b"))
    members = near.select("value", "k", "n", "a").where("a != k").join(found.withColumnRenamed("id", "k"), "k", "left").select("value", "k", "n", F.coalesce("component_id", "k").alias("c"))
    several = members.groupBy("value").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("value")
    members = members.join(several, "value", "left_semi").join(signed.select("k", "sketch"), "k")
    members = written(members.select("value", "k", "n", "c", *[F.col("sketch")[i].alias(f"s{i}") for i in range(LONGS)]))
    others = members.select("value", F.col("k").alias("b"), F.col("n").alias("o"), F.col("c").alias("d"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(LONGS)])
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(LONGS)), F.lit(0))
    pairs = members.withColumnRenamed("k", "a").join(others, "value").where("a < b and c != d").where(_enough(F.col("n"), F.col("o"), differ, least))
    return stars.union(similar(pairs.select("a", "b", F.col("o").alias("n")).distinct()))


def _enough(one: Column, other: Column, differ: Column, least: float) -> Column:
    """Whether sets of these sizes that differ in so many members at least can be similar enough."""
    shared = (one + other - F.greatest(differ, F.abs(one - other))) / 2
    return F.round(shared / (one + other - shared), 6) >= least


def minhash_groups(df: DataFrame, key: str, text: str, least: float, width: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """(key, class_id, component_id) of each row: the smallest keys of equal texts, and of texts that pairs connect.

    A row of a null or blank text is its own class and component.
    """
    found = components(minhash_pairs(df, key, text, least, width, bands, rows).select("a", "b"))
    texts = _keyed(df, key, text)
    classes = _classes(texts).withColumnRenamed("k", "class").join(found.withColumnRenamed("id", "class"), "class", "left")
    said = df.select(key, F.when(F.length(F.trim(text)) > 0, F.xxhash64(text)).alias("h")).join(classes, "h", "left")
    own = F.coalesce("class", key)
    return said.select(key, own.alias("class_id"), F.coalesce("component_id", own).alias("component_id"))
