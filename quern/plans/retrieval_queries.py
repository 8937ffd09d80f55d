"""Queries of ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval
from ..sources.tables import table
from .registry import query

#: Stated queries, of words that the corpus has.
QUERIES = ((1, "trash idiot"), (2, "ere thing anes"), (3, "que ado entre"), (4, "schen keit ung"), (5, "moron pathetic scum"), (6, "licensed public license"))
VALUES = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def _terms_sql(text: str) -> str:
    folded = "CASE WHEN regexp_matches(w, '[a-z]{2}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[a-z]{3}[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
    split = rf"string_split(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return f"list_transform(list_filter({split}, lambda w: w <> '' AND w NOT IN ({STOP})), lambda w: {folded})"


SQL = f"""WITH q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms_sql('query')}) AS term FROM (VALUES {VALUES}) t(query_id, query)) GROUP BY 1, 2),
d AS (SELECT doc_id, {_terms_sql('text')} AS terms FROM documents), c AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM d),
h AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
s AS (SELECT term, count(*) AS df FROM h GROUP BY term),
bm25 AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM h JOIN s USING (term) JOIN q USING (term), c GROUP BY 1, 2),
tfidf AS (SELECT query_id, doc_id, round(sum((ln((n + 1) / (df + 1)) + 1) * (1 + ln(tf)) / sqrt(sqrt(length))), 6) AS score FROM h JOIN s USING (term) JOIN q USING (term), c GROUP BY 1, 2),
bm25r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= 50),
tfidfr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tfidf) WHERE rank <= 50),
rrf AS (SELECT query_id, doc_id, round(sum(part), 8) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM bm25r UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM tfidfr) GROUP BY 1, 2)"""


def _queries(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


@query("bm25_search", f"{SQL} SELECT query_id::INT AS query_id, doc_id, score, rank::INT AS rank FROM bm25r WHERE rank <= 10")
def bm25_search(spark, d):
    return retrieval.ranked(retrieval.bm25(table(spark, d, "documents"), _queries(spark)), "doc_id", 10)


@query(
    "bm25_explained",
    f"""{SQL} SELECT query_id::INT AS query_id, term, count(*)::BIGINT AS n_docs, round(max(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS most
    FROM h JOIN s USING (term) JOIN q USING (term), c GROUP BY 1, 2""",
)
def bm25_explained(spark, d):
    parts = retrieval.bm25(table(spark, d, "documents"), _queries(spark), explain=True)
    return parts.groupBy("query_id", "term").agg(F.count("*").alias("n_docs"), F.round(F.max("part"), 6).alias("most"))


@query("tfidf_search", f"{SQL} SELECT query_id::INT AS query_id, doc_id, score, rank::INT AS rank FROM tfidfr WHERE rank <= 10")
def tfidf_search(spark, d):
    return retrieval.ranked(retrieval.tfidf(table(spark, d, "documents"), _queries(spark)), "doc_id", 10)


def _both(spark, d):
    documents, asked = table(spark, d, "documents"), _queries(spark)
    matches = retrieval.Matches(documents, asked)
    return [retrieval.ranked(f(documents, asked, matches=matches), "doc_id", 50) for f in (retrieval.bm25, retrieval.tfidf)]


@query("rank_fusion", f"{SQL} SELECT query_id::INT AS query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM rrf) WHERE r <= 10")
def rank_fusion(spark, d):
    return retrieval.ranked(retrieval.reciprocal_rank_fusion(_both(spark, d), "doc_id"), "doc_id", 10).select("query_id", "doc_id", "score")


@query(
    "weighted_fusion",
    f"""{SQL}, m AS (SELECT query_id, doc_id, 0.6 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS part FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm25r)
    UNION ALL SELECT query_id, doc_id, 0.4 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM tfidfr))
    SELECT query_id::INT AS query_id, doc_id, round(sum(part), 6)::DOUBLE AS score FROM m GROUP BY query_id, doc_id""",
)
def weighted_fusion(spark, d):
    first, second = _both(spark, d)
    return retrieval.weighted_fusion([(first, 0.6), (second, 0.4)], "doc_id")


@query(
    "search_metrics",
    f"""{SQL}, w AS (SELECT query_id, doc_id FROM (VALUES {VALUES}) t(query_id, query), documents WHERE source = 'src' || query_id), t AS (SELECT query_id, count(*) AS total FROM w GROUP BY query_id),
    g AS (SELECT query_id, count(*) AS n, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM bm25r JOIN w USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id)
    SELECT query_id::INT AS query_id, coalesce(n > 0, false) AS hit, round(coalesce(n, 0) / 10.0, 6)::DOUBLE AS precision, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS reciprocal_rank,
    round(coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(total, 10)), lambda i: 1 / log2(i + 1.0))), 6)::DOUBLE AS ndcg FROM t LEFT JOIN g USING (query_id)""",
)
def search_metrics(spark, d):
    documents, asked = table(spark, d, "documents"), _queries(spark)
    wanted = documents.join(F.broadcast(asked), F.col("source") == F.concat(F.lit("src"), F.col("query_id").cast("string"))).select("query_id", "doc_id")
    return retrieval.rank_metrics(retrieval.ranked(retrieval.bm25(documents, asked), "doc_id", 10), wanted, 10)


@query(
    "nearest_vectors",
    """SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) /
    sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10""",
)
def nearest_vectors(spark, d):
    vectors = table(spark, d, "embeddings")
    return retrieval.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


@query(
    "nearest_label_votes",
    """SELECT query_id, arg_max(label, (votes, -label))::INT AS label, max(votes)::BIGINT AS votes FROM (SELECT query_id, label, count(*) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) /
    sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5 GROUP BY 1, 2) GROUP BY query_id""",
)
def nearest_label_votes(spark, d):
    vectors = table(spark, d, "embeddings")
    found = retrieval.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 5).join(vectors.select("vec_id", "label"), "vec_id")
    votes = found.groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))
