"""Ranked search over documents and vectors as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..sources.tables import written


def postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, term, tf) and (key, length) of the search terms of all texts.

    Counting is inside each row, so nothing is shuffled.
    """
    terms = df.select(F.col(key), tx.terms(F.col(text)).alias("terms"))
    exploded = terms.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return exploded, terms.select(key, F.size("terms").alias("length"))


class Matches:
    """What texts have of the terms of stated queries; texts are read and cut into terms once, for all rankings.

    Of each text its key, length and query terms are written; numbers of documents and the corpus' size and mean length
    come from what was written.
    """

    def __init__(self, df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text"):
        self.key = key
        self.asked = queries.select("query_id", F.explode(tx.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        wanted = [r.term for r in self.asked.select("term").distinct().collect()]  # of the stated queries
        hit = (lambda t: F.filter(t, lambda x: x.isin(*wanted))) if wanted else (lambda t: F.array().cast("array<string>"))
        rows = written(df.select(F.col(key), tx.terms(F.col(text)).alias("t")).select(key, F.size("t").alias("length"), hit(F.col("t")).alias("hit")))
        self.corpus = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
        hits = rows.where(F.size("hit") > 0).select(key, "length", F.explode("hit").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
        self.hits = hits.join(F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df"))), "term")  # one row for each query term

    def rows(self) -> DataFrame:
        return self.hits.join(F.broadcast(self.asked), "term").crossJoin(F.broadcast(self.corpus))  # corpus has one row


def bm25(
    df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, explain: bool = False, matches: Matches | None = None,
) -> DataFrame:
    """(query_id, key, score) by Okapi BM25 with statistics of the whole corpus; explain: a row for each term."""
    rows = (matches or Matches(df, queries, key, text)).rows()
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    rows = rows.select("query_id", key, "term", (F.col("qtf") * idf * tf).alias("part"))
    return rows if explain else rows.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def tfidf(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", matches: Matches | None = None) -> DataFrame:
    """(query_id, key, score): sum of idf (1 + ln tf) of distinct query terms, damped by the fourth root of the length."""
    rows = (matches or Matches(df, queries, key, text)).rows()
    part = (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) * (1 + F.log("tf")) / F.sqrt(F.sqrt(F.col("length")))
    return rows.select("query_id", key, part.alias("part")).groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def ranked(scores: DataFrame, key: str, n: int) -> DataFrame:
    """The best n of each query: score first, then the smaller key."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", order).where(F.col("rank") <= n)


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(query_id, key, score) from ranked lists: sum of 1 / (k + rank)."""
    parts = [x.select("query_id", key, (1 / (k + F.col("rank"))).alias("part")) for x in lists]
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    return both.groupBy("query_id", key).agg(F.round(F.sum("part"), 8).alias("score"))


def scaled(scores: DataFrame) -> DataFrame:
    """Scores of each query brought to 0 to 1; all equal: 1."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return scores.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def weighted_fusion(lists: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """(query_id, key, score): weighted sum of scaled scores; a list that lacks a key gives it 0."""
    both = None
    for scores, weight in lists:
        part = scaled(scores).select("query_id", key, (F.col("score") * weight).alias("part"))
        both = part if both is None else both.union(part)
    return both.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


#: What a product of unit vectors may differ from the cosine, and rounding to six places moves it, at most.
SLACK = 2e-6


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled up with zeros, and their lengths; those that are null or hold nulls: zeros and -1."""
    own = vectors.combine_chunks()
    cells = own.flatten()
    sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = pc.fill_null(cells, 0).to_numpy(zero_copy_only=False)
    lacking = pc.is_null(own).to_numpy(zero_copy_only=False).copy()
    lacking[row[pc.is_null(cells).to_numpy(zero_copy_only=False)]] = True
    out[lacking] = 0
    return out, np.where(lacking, -1, sizes)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of both, added up place by place as `dot` does, so that all bits are the same."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, norms, and which rows have none that products can be trusted with (unit: zero); zero vectors have zero."""
    norm = np.sqrt(_dots(v, v))
    plain = (norm > 1e-140) & (norm < 1e140)
    return np.where(plain[:, None], v / np.where(plain, norm, 1.0)[:, None], 0.0), norm, ~plain & v.any(axis=1)


def _first(query: np.ndarray, row: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Which of the scored rows may be among the n best of their query once scores are rounded; of equal scores, n rows."""
    high = np.where(np.isnan(score), np.inf, score)  # as Spark sorts it
    order = np.lexsort((row, -high, query))
    query, high = query[order], high[order]
    at = np.arange(len(order))
    new_query = np.append(True, query[1:] != query[:-1])[: len(order)]
    new_score = new_query | np.append(True, high[1:] != high[:-1])[: len(order)]
    begun = np.maximum.accumulate(np.where(new_query, at, 0))
    same = at - np.maximum.accumulate(np.where(new_score, at, 0))
    last = np.minimum(begun + n - 1, len(order) - 1)
    bar = np.where(query[last] == query, high[last], -np.inf)
    return order[(same < n) & (high >= bar - SLACK)] if len(order) else order


def _nearest_of_block(n: int, key: str, some_rows: int = 2_048, some_asked: int = 512):
    """(rows, asked) -> (query_id, key, score): what may be among the n nearest of each query asked, its cosine not rounded.

    Products of matrices tell which rows can be; only those get the cosine added up in order.
    """

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column("k")))
        keys, ids = rows.column("k").combine_chunks(), asked.column("q").combine_chunks()
        (v, size), (w, wanted) = _matrix(rows.column("v")), _matrix(asked.column("v"))
        width = max(v.shape[1], w.shape[1])
        v, w = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, w))
        plain_keys, plain_ids = keys.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        # The query itself is none of its neighbours.
        low, high = np.searchsorted(plain_keys, plain_ids, "left"), np.searchsorted(plain_keys, plain_ids, "right")
        with np.errstate(all="ignore"):
            (unit, norm, odd), (unit_w, norm_w, odd_w) = _units(v), _units(w)
            told = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for q in range(0, len(w), some_asked):
                bar = np.full(len(w[q : q + some_asked]), -np.inf)
                for r in range(0, len(v), some_rows):
                    close = unit_w[q : q + some_asked] @ unit[r : r + some_rows].T
                    strange = odd_w[q : q + some_asked, None] | odd[r : r + some_rows]
                    close[strange] = -3
                    own, other = size[r : r + some_rows], wanted[q : q + some_asked, None]
                    close[(own != other) & (own > 0) & (other > 0)] = -3
                    place = np.arange(r, r + close.shape[1])
                    close[(place >= low[q : q + some_asked, None]) & (place < high[q : q + some_asked, None])] = -9
                    if close.shape[1] >= n:
                        bar = np.maximum(bar, np.partition(close, -n, axis=1)[:, -n])
                    i, j = np.nonzero(((close >= (bar - SLACK)[:, None]) | strange) & (close > -9))
                    i, j = i + q, j + r
                    norms = norm_w[i] * norm[j]
                    score = np.where(norms <= 0, 0.0, _dots(w[i], v[j]) / norms)
                    score[(size[j] != wanted[i]) & ~(norms <= 0)] = -np.inf  # null
                    score[(size[j] < 0) | (wanted[i] < 0)] = 0.0
                    first = _first(i, j, score, n)
                    told.append((i[first], j[first], score[first]))
            i, j, score = (np.concatenate(x) for x in zip(*told))
            first = _first(i, j, score, n)
        i, j, score = i[first], j[first], score[first]
        return pa.table({"query_id": ids.take(pa.array(i)), key: keys.take(pa.array(j)), "score": pa.array(score, mask=np.isneginf(score))})

    return best


def nearest(df: DataFrame, queries: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", block: int = 2_000, cells: int = 1 << 20) -> DataFrame:
    """(query_id, key, score, rank): the n most similar rows of each stated query, exactly.

    Every query meets every row, in blocks of up to about `block` queries and rows of `cells` numbers: a task holds one
    pair of blocks, and the best n of a query leave it. Scores are those of `cosine` to the last bit; vectors of other
    lengths than a query's come last, with null.
    """
    kind = lambda of, name: of.schema[name].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    count, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    down, across = max(1, -(-count * max(width or 1, 1) // cells)), max(1, -(-asked.count() // block))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    rows = rows.select(F.pmod(F.xxhash64("k"), F.lit(down)).cast("int").alias("i"), every(across).alias("j"), "k", "v")
    asked = asked.select(every(down).alias("i"), F.pmod(F.xxhash64("q"), F.lit(across)).cast("int").alias("j"), "q", "v")
    met = rows.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(_nearest_of_block(n, key), f"query_id {kind(queries, key)}, `{key}` {kind(df, key)}, score double")
    return ranked(met.withColumn("score", F.round("score", 6)), key, n)


def rank_metrics(found: DataFrame, wanted: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Hit rate, precision, reciprocal rank and nDCG at k of each query that wants something."""
    total = wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = found.where(F.col("rank") <= k).join(wanted.select("query_id", key), ["query_id", key])
    sums = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    rows = total.join(sums, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return rows.select(
        "query_id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("hit"), F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )
