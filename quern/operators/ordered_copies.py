"""Near copies in order: a row falls to an earlier row only if that one stays itself.

In a chain a - b - c where a is close to b and b to c but not a to c, b falls to a and c stays: connected components
would lose c. The rule is sequential, but rows are taken in a few growing batches: what is close to a row that stays from
an earlier batch falls, so that a large group of copies doesn't meet itself. Of the others all links are found, and they
decide side by side: one that has no undecided earlier link stays, what it is close to falls, and the others wait for
the next round. Rounds are bounded by the longest chain of rows of a batch each of which waits for the one before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import dropped, written

#: Sets of the first batch, about; each next one ends at GROWTH times as many. Keys that the bounds of batches are taken from.
SMALL, GROWTH, SAMPLE = 20_000, 8, 20_000
#: Longs of a set's sketch.
LONGS = 8
SKETCH = [f"s{i}" for i in range(LONGS)]


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(h, k, w) of distinct sets of lower-case words: a digest of the set, the earliest key, and the set's 64-bit hashes in order.

    Rows without words or key have no set.
    """
    sets = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), tx.words(F.lower(F.col(text))).alias("w"))
    sets = sets.select("k", F.array_sort(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x)))).alias("w")).where(F.size("w") > 0)
    # The digest has 128 bits; only the earliest of equal sets goes on.
    digest = F.md5(F.concat_ws(",", F.transform("w", lambda x: x.cast("string"))))
    return sets.select("k", "w", digest.alias("h"))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(word, k, size, single, rest, sketch...): of each set (k, w) its rarest words, so many that sets of a cosine of
    `least` or more share one of them.

    A cosine of t needs an overlap of t * t of the set at least: among the words but for fewer than that, in one order
    for all sets, is the first word that two such sets have in common. single: the words that no other set has; rest:
    those behind this one. A bit of the sketch is the parity of the words of other sets that fall to it.
    """
    words = sets.select("k", F.explode("w").alias("word"))
    rarity = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    # A word of one set alone meets no other set, but takes a place among the rarest.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("cast((word >> 3) & 63 as int)"))
    sketch = [F.bit_xor(F.when(F.expr(f"word & {LONGS - 1} = {i}"), bit).otherwise(F.lit(0).cast("long"))).alias(s) for i, s in enumerate(SKETCH)]
    told = words.join(rarity, "word").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"), *sketch)
    told = told.join(sets.select("k", F.size("w").alias("size")), "k").withColumn("single", F.col("size") - F.size("r"))
    length = F.col("size") - F.ceil(F.col("size") * least * least - 1e-9) + 1 - F.col("single")
    told = told.select("k", "size", "single", F.size("r").alias("shared"), *SKETCH, F.posexplode(F.slice("r", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("at", "r"))
    return told.select("r.word", "k", "size", "single", (F.col("shared") - F.col("at") - 1).alias("rest"), *SKETCH)


def meeting(one: DataFrame, other: DataFrame, least: float, within: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of keys of postings that share a word and may have a cosine of `least` or more; within: a < b.

    Neither the words behind the first one in common nor the parities of the sketches may leave too little to share.
    """
    a = one.select("word", *[F.col(c).alias(f"{c}_a") for c in ("k", "size", "single", "rest", *SKETCH)])
    b = other.select("word", *[F.col(c).alias(f"{c}_b") for c in ("k", "size", "single", "rest", *SKETCH)])
    differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH), F.col("single_a") + F.col("single_b"))
    needed = F.lit(least * least) * F.col("size_a") * F.col("size_b") - 1e-9
    enough = lambda shared: (shared > 0) & (shared * shared >= needed)
    both = a.join(b, "word").where(enough((F.least("rest_a", "rest_b") + 1).cast("double")) & enough((F.col("size_a") + F.col("size_b") - differ) / 2))
    return (both.where("k_a < k_b") if within else both).select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()


def close(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of keys whose sets have a cosine of `least` or more."""
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("k").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb")).cast("double")
    # Squares of whole numbers: a cosine at the limit counts on every machine.
    return both.where(shared * shared >= F.lit(least * least) * F.size("wa") * F.size("wb") - 1e-9).select("a", "b")


def first_independent(links: DataFrame, buckets: DataFrame | None, compare=None) -> DataFrame | None:
    """(k, kept) of the keys that links or buckets name: kept if no earlier kept key is close. None if they name none.

    links: (a, b), a before b, close. buckets: (bucket, k) whose members are still to be compared by compare(pairs) ->
    links, pairs being (a, b). A key that is the earliest undecided one of all its buckets, and of its links, stays.
    """
    links = written(links.select("a", "b").distinct())
    waiting = links.select(F.col("a").alias("k")).union(links.select("b"))
    if buckets is not None:
        buckets = written(buckets.distinct())
        waiting = waiting.union(buckets.select("k"))
    waiting = written(waiting.distinct())
    out = None
    while not waiting.isEmpty():
        stopped, before = links.select(F.col("b").alias("k")), [waiting, links]
        if buckets is not None:
            heads = written(buckets.groupBy("bucket").agg(F.min("k").alias("a")))
            behind = buckets.join(heads, "bucket").where("k != a")
            stopped = stopped.union(behind.select("k"))
            before += [buckets, heads]
        stay = written(waiting.join(stopped.distinct(), "k", "left_anti"))
        fall = links.join(stay.select(F.col("k").alias("a")), "a", "left_semi").select(F.col("b").alias("k"))
        if buckets is not None:
            from_heads = behind.select("bucket", "a", F.col("k").alias("b")).join(stay.select(F.col("k").alias("a")), "a", "left_semi").select("a", "b").distinct()
            fall = fall.union(compare(from_heads).select(F.col("b").alias("k")))
        told = written(stay.select("k", F.lit(True).alias("kept")).union(fall.distinct().select("k", F.lit(False))))
        out = told if out is None else out.union(told)
        waiting = written(waiting.join(told, "k", "left_anti"))
        # What is decided neither waits nor stops others.
        links = written(links.join(told.select(F.col("k").alias("a")), "a", "left_anti").join(told.select(F.col("k").alias("b")), "b", "left_anti"))
        if buckets is not None:
            buckets = written(buckets.join(told, "k", "left_anti"))
        dropped(*before, stay)
    return out


def bounds(keys: DataFrame, small: int) -> list:
    """Keys (k) at which batches of about small, small * GROWTH, ... rows end, from a sample of bounded size."""
    total = keys.count()
    chosen = keys if total <= SAMPLE else keys.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / total))
    sample = sorted(r.k for r in chosen.collect())
    out, end = [], small
    while end < total and sample:
        out.append(sample[min(len(sample) - 1, end * len(sample) // total)])
        end *= GROWTH
    return out


def keep_earliest(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.9, small: int = SMALL) -> DataFrame:
    """(key, kept) of each row: false if an earlier row (smaller key) that is kept has a cosine of `least` or more with it.

    Texts are compared as sets of lower-case words. Rows without words are kept, as rows without key are. Of rows with
    one key and different texts the smaller digest counts as the earlier; each row has its own verdict.
    """
    rows = written(word_sets(df, key, text))
    classes = rows.groupBy("h").agg(F.min("k").alias("first"))
    sets = rows.join(classes.select("h", F.col("first").alias("k")), ["h", "k"], "left_semi").groupBy("h", "k").agg(F.first("w").alias("w"))
    # Sets get numbers, which pairs are made of; which of two is the earlier tells (key, digest).
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()))
    numbered = sets.select(F.col("id").alias("k"), "w")
    postings = written(prefixes(numbered, least))
    keys = sets.select("id", F.struct("k", "h").alias("order"))
    kept = fallen = None
    low, ends = None, bounds(sets.select("k"), small)
    for high in [*ends, None]:
        batch = sets.select(F.col("id").alias("k"), F.col("k").alias("key"))
        batch = batch.where((F.lit(True) if low is None else F.col("key") >= low) & (F.lit(True) if high is None else F.col("key") < high)).select("k")
        own = postings.join(batch, "k", "left_semi")
        if kept is not None:
            # What is close to an earlier set that stays falls before the others are compared with each other.
            gone = written(close(meeting(postings.join(kept, "k", "left_semi"), own, least), numbered, least).select(F.col("b").alias("k")).distinct())
            batch, own, fallen = batch.join(gone, "k", "left_anti"), own.join(gone, "k", "left_anti"), gone if fallen is None else fallen.union(gone)
        links = close(meeting(own, own, least, within=True), numbered, least)
        links = links.join(keys.select(F.col("id").alias("a"), F.col("order").alias("ka")), "a").join(keys.select(F.col("id").alias("b"), F.col("order").alias("kb")), "b")
        links = links.select(F.when(F.col("ka") < F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("ka") < F.col("kb"), F.col("b")).otherwise(F.col("a")).alias("b"))
        told = first_independent(links, None)
        if told is not None:
            gone = told.where("not kept").select("k")
            batch, fallen = batch.join(gone, "k", "left_anti"), gone if fallen is None else fallen.union(gone)
        low = high
        if high is not None:
            batch = written(batch)
            kept = batch if kept is None else kept.union(batch)
    told = sets.select(F.col("id").alias("k"), F.lit(False).alias("kept")).limit(0) if fallen is None else fallen.select("k", F.lit(False).alias("kept"))
    sets = sets.select("h", F.struct("k", "h").alias("k"), "id").join(told.withColumnRenamed("k", "id"), "id", "left")
    verdicts = sets.select("h", F.coalesce("kept", F.lit(True)).alias("set_kept"), F.col("k.k").alias("first"))
    # Of equal sets the earliest has the verdict; the others fall to it, or to what it fell to.
    said = df.select(key, F.md5(F.concat_ws(",", F.transform(F.array_sort(F.array_distinct(F.transform(tx.words(F.lower(F.col(text))), lambda x: F.xxhash64(x)))), lambda x: x.cast("string")))).alias("h"), (F.size(tx.words(F.col(text))) > 0).alias("has"))
    said = said.withColumn("h", F.when(F.col("has") & F.col(key).isNotNull(), F.col("h")))
    return said.join(verdicts, "h", "left").select(key, F.coalesce(F.col("set_kept") & (F.col(key) == F.col("first")), F.lit(True)).alias("kept"))
