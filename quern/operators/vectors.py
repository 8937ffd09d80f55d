"""Centroids and what follows from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.tables import written
from .retrieval import cosine


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): the mean vector of each label. Sums are made before the shuffle, by label and place."""
    cells = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("v"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def by_centroid(df: DataFrame, centres: DataFrame, key: str, label: str = "label", vector: str = "embedding") -> DataFrame:
    """df's keys and labels with the label of the most similar centroid; centres has a row for each label."""
    few = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("all")))
    rows = df.select(key, label, vector).crossJoin(few)  # one row: all centroids as an array
    told = F.transform("all", lambda x: F.struct(F.round(cosine(x["c"], F.col(vector)), 6).alias("score"), (-x["l"]).alias("l")))
    best = F.array_max(told)
    return rows.select(key, label, (-best["l"]).alias("said"), best["score"].alias("score"))


def spherical_centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a sample of unit vectors, which has a bounded size: k-means by cosine from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, n: int, recall: float, asked: int = 400) -> int:
    """The fewest lists to probe so that `recall` of the n nearest of sampled rows are in them; all lists if fewer don't do.

    Rows asked for are spread over the sample, whose own rows are searched exactly.
    """
    rows = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
    own = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(sample[rows] @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list, among the lists of a row
    close = sample[rows] @ sample.T
    close[np.arange(len(rows)), rows] = -2
    near = np.argsort(-close, axis=1, kind="stable")[:, : min(n, len(sample) - 1)]
    if not near.size:
        return len(centres)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def ivf_search(
    df: DataFrame, queries: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, lists: int | None = None, probes: int | None = None,
    sample: int = 20_000, block: int = 4_096,
) -> DataFrame:
    """(query_id, key, score, rank): the n most similar rows of the lists that a query probes, by cosine.

    Centres are fitted on at most about `sample` rows, chosen by a hash of the key; every row is put in the list of its
    nearest centre. lists: the root of the number of rows, unless given, and at most an eighth of the sample. probes: as
    many as find `recall` of the neighbours of sampled rows, unless given; with probes=lists the search is exact. Vectors
    without clusters need most of the lists. A list is dealt into blocks of about `block` rows, so no task holds all of a
    long one; a query goes to each block of its lists, and the best n of a block leave it.

    Vectors that are null, zero or hold null or non-finite values are neither found nor asked for.
    """
    plain = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda of: of.withColumn("norm", norm).where("norm > 0").withColumn("v", F.transform("v", lambda x: x / F.col("norm"))).drop("norm")  # noqa: E731  null beside a null value
    rows = unit(df.select(F.col(key), plain(vector).alias("v")))
    total = rows.count()
    if not total:
        return rows.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    chosen = rows if total <= sample else rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    fitted = np.array([r.v for r in chosen.orderBy(key).select("v").collect()])  # the bounded sample
    lists = lists or max(1, min(int(np.sqrt(total)), len(fitted) // 8))
    centres = spherical_centres(fitted, lists)
    probes = min(probes or probes_needed(fitted, centres, n, recall), len(centres))

    def nearest_lists(k: int):
        @F.pandas_udf("array<int>")
        def told(vectors: pd.Series) -> pd.Series:
            close = np.stack(vectors.to_numpy()) @ centres.T if len(vectors) else np.zeros((0, len(centres)))
            return pd.Series(list(np.argsort(-close, axis=1, kind="stable")[:, :k].astype(np.int32)))

        return told

    placed = written(rows.select(key, "v", nearest_lists(1)("v")[0].alias("list")))
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each list
    dealt = placed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"), F.col(key).alias("k"), "v")
    asked = unit(queries.select(F.col(key).alias("q"), plain(vector).alias("v"))).select("q", "v", F.explode(nearest_lists(probes)("v")).alias("list"))
    asked = asked.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "q", "v")
    kind, other = df.schema[key].dataType.simpleString(), queries.schema[key].dataType.simpleString()

    def best(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return pa.table({"query_id": wanted.column("q").slice(0, 0), key: rows.column("k").slice(0, 0), "score": pa.array([], pa.float64())})
        v = np.stack(rows.column("v").to_pandas().to_numpy())
        order = pc.sort_indices(rows.column("k"))
        v, keys = v[order.to_numpy()], rows.column("k").take(order).combine_chunks()
        queries_, found, scores = [], [], []
        for at in range(0, wanted.num_rows, 256):
            some = wanted.slice(at, 256)
            close = np.round(np.stack(some.column("v").to_pandas().to_numpy()) @ v.T, 6)
            close[keys.to_numpy(zero_copy_only=False)[None, :] == some.column("q").to_numpy(zero_copy_only=False)[:, None]] = -2
            first = np.argsort(-close, axis=1, kind="stable")[:, :n]
            held = np.take_along_axis(close, first, axis=1)
            i, j = np.nonzero(held > -2)
            queries_.append(some.column("q").take(pa.array(i)).combine_chunks())
            found.append(keys.take(pa.array(first[i, j])))
            scores.append(held[i, j])
        return pa.table({"query_id": pa.chunked_array(queries_), key: pa.chunked_array(found), "score": pa.array(np.concatenate(scores))})

    met = dealt.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInArrow(best, f"query_id {other}, `{key}` {kind}, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return met.withColumn("rank", order).where(F.col("rank") <= n)


def diverse(candidates: DataFrame, k: int, balance: float, query: str = "query_id", key: str = "vec_id", score: str = "score", vector: str = "v") -> DataFrame:
    """(query, key, place): k of each query's candidates, the next being the one of largest
    balance * score - (1 - balance) * largest cosine with those chosen before; ties go to the better candidate.

    A query's candidates are the few that a search keeps, and are put in one row.
    """

    @F.pandas_udf("array<int>")
    def chosen(scores: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for own, rows in zip(scores, vectors):
            v = np.stack([np.asarray(x, float) for x in rows])
            v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
            near, left, order = np.zeros(len(own)), list(range(len(own))), []
            while left and len(order) < k:
                best = max(left, key=lambda i: (round(balance * own[i] - (1 - balance) * near[i], 9), -i))
                near = np.maximum(near, v @ v[best]) if order else v @ v[best]
                order.append(best)
                left.remove(best)
            out.append(np.array(order, np.int32))
        return pd.Series(out, dtype=object)

    own = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))))
    rows = candidates.groupBy(query).agg(own.alias("c"))
    rows = rows.withColumn("order", chosen(F.transform("c", lambda x: -x["s"]), F.transform("c", lambda x: x["v"])))
    return rows.select(query, F.posexplode(F.transform("order", lambda i: F.col("c")[i]["k"])).alias("place", key))
