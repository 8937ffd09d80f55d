"""Near-duplicates among embeddings by Euclidean p-stable hashing and exact cosine checks.

Equal vectors form one class. Normalised vectors are projected on random directions and cut into strips; strips of
several directions make a bucket, and there are several tables of buckets. Pairs that meet in a bucket are checked by
their cosine in double precision and counted in the first table where they meet. Large buckets are dealt into blocks of
bounded size, and pairs of blocks are checked in different tasks.

For cosine 0.93, a table finds a pair at the limit with probability 0.2, and the 16 tables with 0.97; closer pairs more
surely (0.95: 0.99, 0.98: over 0.999). The tests measure recall against brute force.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a
label, link with nothing and are their own component; vectors of different lengths don't link; a row without id has no
links and no component; each of several rows with the same id and vector counts as a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, cut
from .common import partitions

COSINE = 0.93
TABLES, DIRECTIONS, STRIP, SEED = 16, 10, 2.0, 30_011
#: Vectors of one bucket that a task compares at once.
BLOCK = 1024
#: Large buckets that are broadcast at most.
BROADCAST_BUCKETS = 100_000


def buckets(vectors: np.ndarray, tables: int = TABLES, directions: int = DIRECTIONS, strip: float = STRIP, seed: int = SEED) -> np.ndarray:
    """A 32-bit bucket number for each vector (row) and table (column)."""
    dims = vectors.shape[1]
    random = np.random.Generator(np.random.PCG64([seed, dims]))
    lines = random.standard_normal((dims, tables * directions))
    shifts = random.uniform(0, strip, tables * directions)
    odd = random.integers(1, 1 << 62, (tables, directions), np.int64) * 2 + 1
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    strips = np.floor((units @ lines + shifts) / strip).astype(np.int64).reshape(len(vectors), tables, directions)
    with np.errstate(over="ignore"):
        mixed = ((strips + 1_000) * odd).sum(axis=2)
    return (mixed >> 31).astype(np.int32)


def _hashed(tables: int, directions: int, strip: float, kind: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["e"].map(len)):
                for at in range(0, len(same), 2048):
                    part = same.iloc[at : at + 2048]
                    vectors = np.stack(part["e"].to_numpy()).astype(kind)
                    found = buckets(vectors.astype(np.float64), tables, directions, strip)
                    out = pd.DataFrame({"l": part["l"], "rep": part["rep"], "m": part["m"], "e": [v.tobytes() for v in vectors], "s": [s.tobytes() for s in found]})
                    for t in range(tables):
                        yield out.assign(t=t, b=found[:, t])

    return rows


def _least_of_trees(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places, the least place that links a-b reach."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(least: float, kind: str):
    """Links of sorted rows: for each vector in a group that links, its least partner and the vectors it links with."""

    def of_group(rows: list, table: int) -> pd.DataFrame | None:
        rep, m, e, s, side = (np.array(x) if i != 2 and i != 3 else x for i, x in enumerate(rows))
        vectors = np.frombuffer(b"".join(e), kind).reshape(len(e), -1).astype(np.float64)
        size = np.linalg.norm(vectors, axis=1)
        left = np.flatnonzero(side != 2)
        right = left if not (side == 2).any() else np.flatnonzero(side == 2)
        near = (vectors[left] @ vectors[right].T) / (size[left][:, None] * size[right][None, :]) >= least
        if left is right:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        if not len(i):
            return None
        marks = np.frombuffer(b"".join(s), np.int32).reshape(len(e), -1)
        links = np.zeros(len(e), np.int64)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            fresh = ~(marks[a, :table] == marks[b, :table]).any(axis=1)
            np.add.at(links, a[fresh], m[b[fresh]])
            np.add.at(links, b[fresh], m[a[fresh]])
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        partner = rep[order][_least_of_trees(len(rep), place[i], place[j])][place]
        kept = (links > 0) | (partner != rep)
        return pd.DataFrame({"a": rep[kept], "b": partner[kept], "n": links[kept]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = [[], [], [], [], []]
        last, out = None, []
        for batch in batches:
            keys = list(zip(batch["l"], batch["t"], batch["b"], batch["i"], batch["j"], batch["d"]))
            columns = [batch[c].tolist() for c in ("rep", "m", "e", "s", "side")]
            start = 0
            for at in range(1, len(keys) + 1):
                if at < len(keys) and keys[at] == keys[start]:
                    continue
                if keys[start] != last:
                    if len(held[0]) > 1 and (found := of_group(held, last[1])) is not None:
                        out.append(found)
                    held, last = [[], [], [], [], []], keys[start]
                for mine, column in zip(held, columns):
                    mine += column[start:at]
                start = at
            if out:
                yield pd.concat(out)
                out = []
        if len(held[0]) > 1 and (found := of_group(held, last[1])) is not None:
            yield found

    return rows


def links(classes: DataFrame, least: float = COSINE, tables: int = TABLES, directions: int = DIRECTIONS, strip: float = STRIP, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, n) from classes (l, rep, m, e): a links with n vectors, and is connected with b."""
    kind = "float64" if classes.schema["e"].dataType.elementType == T.DoubleType() else "float32"
    dealt = classes.mapInPandas(_hashed(tables, directions, strip, kind), "l string, rep long, m long, e binary, s binary, t int, b int")
    dealt = dealt.withColumn("d", F.length("e"))
    key = ["l", "t", "b", "d"]
    # Buckets over the bound get as many blocks as they need; each of their rows goes to every pair with its block.
    large = dealt.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = cut(large.select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    few = large.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS  # else by a shuffle
    dealt = dealt.join(F.broadcast(large) if few else large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        *key, "rep", "m", "e", "s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(0)).alias("side"),
    )
    group = [*key, "i", "j"]
    sorted_rows = dealt.repartition(partitions(classes), *group).sortWithinPartitions(*group)
    return sorted_rows.mapInPandas(_linked(least, kind), "a long, b long, n long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE, **how) -> DataFrame:
    """One row for each row of df: its id, n_links, component_id and kept (the id is that of the component).

    Labels of any type are compared as text. Vectors of floats stay floats; those of other numbers become doubles.
    """
    sound = (
        F.col("l").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False))
        & F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("e", lambda x: x != 0)
    )
    floats = df.schema[vector].dataType.elementType == T.FloatType()
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<float>" if floats else "array<double>").alias("e"))
    rows = rows.withColumn("h", F.when(F.coalesce(sound, F.lit(False)), F.struct(F.xxhash64("e").alias("x"), F.xxhash64(F.lit(7), "e").alias("y"))))
    members = rows.where("h is not null").select("id", "l", "h")
    classes = rows.where("h is not null").groupBy("l", "h").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("e").alias("e"))
    classes = cut(classes)
    found = cut(links(classes.select("l", "rep", "m", "e"), least, **how))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    reached = components(found.select("a", "b"))
    told = (
        classes.select("l", "h", "rep", "m")
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(reached, F.col("rep") == F.col("id"), "left")
        .select("l", "h", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    linked = members.join(told, ["l", "h"]).select("id", "n_links", "component_id")
    alone = rows.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.col("id") == F.col("component_id"))
    return out.withColumnRenamed("id", key)
