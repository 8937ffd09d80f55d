"""More queries of ranked search: cosines of weighted terms, authority, recency, routes, and sets of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators import retrieval, vectors
from ..sources.tables import table, written
from .registry import query
from .retrieval_queries import QUERIES, SQL, VALUES, _queries, _terms_sql

FEW = "(SELECT query_id, doc_id, score FROM bm25r WHERE rank <= 20)"


def _best(spark, d, n=20):
    return retrieval.ranked(retrieval.bm25(table(spark, d, "documents"), _queries(spark)), "doc_id", n)


@query(
    "tfidf_cosine",
    f"""WITH q AS (SELECT query_id, term, 1 + ln(count(*)) AS qw FROM (SELECT query_id, unnest({_terms_sql('query')}) AS term FROM (VALUES {VALUES}) t(query_id, query)) GROUP BY 1, 2),
    p AS (SELECT doc_id, term, 1 + ln(count(*)) AS w FROM (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents) GROUP BY 1, 2), c AS (SELECT count(*) AS n FROM documents),
    i AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM p, c GROUP BY term, n), norms AS (SELECT doc_id, sqrt(sum(w * idf * w * idf)) AS norm FROM p JOIN i USING (term) GROUP BY doc_id),
    qn AS (SELECT query_id, sqrt(sum(qw * idf * qw * idf)) AS norm FROM q JOIN i USING (term) GROUP BY 1),
    s AS (SELECT query_id, doc_id, sum(qw * idf * w * idf) AS dot FROM q JOIN p USING (term) JOIN i USING (term) GROUP BY 1, 2),
    r AS (SELECT query_id::INT AS query_id, doc_id, round(dot / norms.norm / qn.norm, 6) AS score FROM s JOIN norms USING (doc_id) JOIN qn USING (query_id))
    SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 10""",
)
def tfidf_cosine(spark, d):
    """Cosine of the query and each text, weighted by sublinear tf and smoothed idf."""
    documents = table(spark, d, "documents")
    counts = documents.select("doc_id", F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg((1 + F.log(F.count("*"))).alias("w"))
    counts = written(counts)  # read for weights, norms and products; the texts are cut into terms once
    size = documents.agg(F.count("*").alias("n"))
    weight = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    rows = counts.join(weight, "term").select("doc_id", "term", (F.col("w") * F.col("idf")).alias("x"), "idf")
    norms = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = _queries(spark).select("query_id", F.explode(tx.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg((1 + F.log(F.count("*"))).alias("qw"))
    asked = weight.join(F.broadcast(asked), "term").select("query_id", "term", (F.col("qw") * F.col("idf")).alias("y"))  # a row for each query term
    length = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("qnorm"))
    dots = rows.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scores = dots.join(norms, "doc_id").join(F.broadcast(length), "query_id").select("query_id", "doc_id", F.round(F.col("dot") / F.col("norm") / F.col("qnorm"), 6).alias("score"))
    return retrieval.ranked(scores, "doc_id", 10).select("query_id", "doc_id", "score")


@query(
    "authority_rerank",
    f"""{SQL} SELECT query_id::INT AS query_id, doc_id, round(score + 0.2 * level * most, 6) AS score FROM (SELECT f.*, (d2.doc_id % 3) / 2.0 AS level, max(abs(score)) OVER (PARTITION BY query_id) AS most FROM {FEW} f JOIN documents d2 USING (doc_id))""",
)
def authority_rerank(spark, d):
    """Adds a share of the best score by the level of a source."""
    rows = _best(spark, d)
    most = F.max(F.abs("score")).over(Window.partitionBy("query_id"))
    return rows.select("query_id", "doc_id", F.round(F.col("score") + 0.2 * (F.col("doc_id") % 3) / 2.0 * most, 6).alias("score"))


PRINCIPALS = ((1, "en"), (2, "de"), (3, "fr"))
WHO = ", ".join(f"({i}, '{lang}')" for i, lang in PRINCIPALS)


@query(
    "authorised_search",
    f"""{SQL} SELECT p::INT AS principal, q::INT AS query_id, count(doc_id)::BIGINT AS n_found, count(doc_id) < 10 AS underfilled, coalesce(min(doc_id), -1) AS smallest FROM (VALUES {WHO}) w(p, l), (SELECT unnest([{', '.join(str(i) for i, _ in QUERIES)}]) AS q)
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS k FROM bm25 JOIN documents USING (doc_id)) r ON r.query_id = q AND r.lang = l AND k <= 10 GROUP BY 1, 2""",
)
def authorised_search(spark, d):
    """What each principal may see of each query's results, and whether less than ten are left: scores are those of all."""
    who = F.broadcast(spark.createDataFrame(PRINCIPALS, "principal int, lang string"))
    scores = retrieval.bm25(table(spark, d, "documents"), _queries(spark)).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").join(who, "lang")
    place = F.row_number().over(Window.partitionBy("query_id", "principal").orderBy(F.desc("score"), "doc_id"))
    seen = scores.withColumn("k", place).where("k <= 10").groupBy("principal", "query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("m"))
    asked = who.select("principal", F.explode(F.array(*[F.lit(i) for i, _ in QUERIES])).alias("query_id"))
    n = F.coalesce("n", F.lit(0))
    return asked.join(seen, ["principal", "query_id"], "left").select("principal", "query_id", n.cast("long").alias("n_found"), (n < 10).alias("underfilled"), F.coalesce("m", F.lit(-1)).alias("smallest"))


@query(
    "term_overlap_search",
    f"""{SQL} SELECT query_id::INT AS query_id, doc_id, n::BIGINT AS n_terms FROM (SELECT query_id, doc_id, count(DISTINCT term) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(DISTINCT term) DESC, doc_id) AS k FROM h JOIN q USING (term) GROUP BY 1, 2) WHERE k <= 10""",
)
def term_overlap_search(spark, d):
    """Texts that share most distinct terms with a query."""
    asked = _queries(spark).select("query_id", tx.terms(F.col("query")).alias("q"))
    every = F.broadcast(asked.agg(F.collect_list(F.struct("query_id", "q")).alias("all")))  # the stated queries, one row
    rows = table(spark, d, "documents").select("doc_id", F.array_distinct(tx.terms(F.col("text"))).alias("t")).crossJoin(every)
    shared = rows.select("doc_id", F.explode(F.transform("all", lambda x: F.struct(x["query_id"].alias("query_id"), F.size(F.array_intersect("t", x["q"])).alias("n")))).alias("x"))
    scores = shared.select("x.query_id", "doc_id", F.col("x.n").cast("long").alias("score")).where("score > 0")
    return retrieval.ranked(scores, "doc_id", 10).select("query_id", "doc_id", F.col("score").alias("n_terms"))


@query(
    "title_weighted_search",
    f"""WITH q AS (SELECT DISTINCT query_id, unnest({_terms_sql('query')}) AS term FROM (VALUES {VALUES}) t(query_id, query)), d AS (SELECT doc_id, {_terms_sql("string_split(text, chr(10))[1]")} AS a, {_terms_sql('text')} AS b FROM documents)
    SELECT query_id::INT AS query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM (SELECT query_id, doc_id, round(sum(CASE WHEN list_contains(a, term) THEN 1.0 ELSE 0 END + CASE WHEN list_contains(b, term) THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM d, q
    WHERE list_contains(b, term) GROUP BY 1, 2)) WHERE k <= 10""",
)
def title_weighted_search(spark, d):
    """A term of the first line weighs ten times one of the body."""
    asked = _queries(spark).select("query_id", F.array_distinct(tx.terms(F.col("query"))).alias("q"))
    every = F.broadcast(asked.agg(F.collect_list(F.struct("query_id", "q")).alias("all")))  # the stated queries, one row
    first = F.element_at(F.split("text", "\n"), 1)
    rows = table(spark, d, "documents").select("doc_id", F.array_distinct(tx.terms(first)).alias("a"), F.array_distinct(tx.terms(F.col("text"))).alias("b")).crossJoin(every)
    told = F.transform("all", lambda x: F.struct(x["query_id"].alias("query_id"), F.round(F.size(F.array_intersect("a", x["q"])) + 0.1 * F.size(F.array_intersect("b", x["q"])), 6).alias("score")))
    scores = rows.select("doc_id", F.explode(told).alias("x")).select("x.query_id", "doc_id", "x.score").where("score > 0")
    return retrieval.ranked(scores, "doc_id", 10).select("query_id", "doc_id", "score")


@query(
    "hit_chunks",
    rf"""{SQL} SELECT query_id::INT AS query_id, doc_id, rank::BIGINT AS rank, md5(array_to_string(w[1:32], ' ')) AS chunk FROM bm25r JOIN (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents) USING (doc_id) WHERE rank <= 10""",
)
def hit_chunks(spark, d):
    """Ranked texts with their first chunk: the few hits are broadcast, so no text is shuffled."""
    hits = _best(spark, d, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    chunk = F.md5(F.array_join(F.slice(tx.words(F.col("text")), 1, 32), " "))
    return table(spark, d, "documents").join(F.broadcast(hits), "doc_id").select("query_id", "doc_id", "rank", chunk.alias("chunk"))


@query(
    "graded_search_metrics",
    f"""{SQL} SELECT query_id::INT AS query_id, round(CASE WHEN any_value(total) = 0 THEN 0 ELSE count(*) FILTER (WHERE g > 0)::DOUBLE / any_value(total) END, 6) AS recall, round(sum((power(2, g) - 1) / log2(rank + 1)), 6)::DOUBLE AS dcg FROM (SELECT b.query_id, rank, CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS g, total
    FROM bm25r b LEFT JOIN labels USING (doc_id) JOIN (SELECT query_id, count(quality) AS total FROM bm25 LEFT JOIN labels USING (doc_id) GROUP BY 1) t ON t.query_id = b.query_id WHERE rank <= 10) GROUP BY query_id""",
)
def graded_search_metrics(spark, d):
    """Recall among all labelled matches, and gains by grade, of the first ten."""
    scores = retrieval.bm25(table(spark, d, "documents"), _queries(spark)).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    grade = F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    total = scores.groupBy("query_id").agg(F.count("quality").alias("total"))
    top = retrieval.ranked(scores.withColumn("g", grade), "doc_id", 10).groupBy("query_id").agg(F.count_if(F.col("g") > 0).alias("n"), F.round(F.sum((F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col("rank") + 1.0)), 6).alias("dcg"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("n") / F.col("total"))
    return top.join(total, "query_id").select("query_id", F.round(share, 6).alias("recall"), "dcg")


COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query(
    "memory_recall",
    f"""SELECT vec_id, score FROM (SELECT b.vec_id, round(0.6 * {COS} + 0.25 * power(2, -(b.vec_id % 365) / 30.0) + 0.15 * (b.vec_id % 5) / 4.0, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND {COS} >= 0.05) ORDER BY score DESC, vec_id LIMIT 20""",
)
def memory_recall(spark, d):
    """Relevance, recency by a half-life and salience, for one stated query."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = F.broadcast(rows.where("vec_id = 7").select(F.col("embedding").alias("q")))
    near = F.round(retrieval.cosine(F.col("q"), F.col("embedding")), 6)
    rows = rows.where("vec_id <> 7").crossJoin(asked).select("vec_id", near.alias("near")).where("near >= 0.05")  # one query
    score = 0.6 * F.col("near") + 0.25 * F.pow(F.lit(2.0), -(F.col("vec_id") % 365) / 30.0) + 0.15 * (F.col("vec_id") % 5) / 4.0
    return rows.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


CENTRES = """c AS (SELECT label, list(v ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(v::DOUBLE), 9) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "intent_routes",
    f"""WITH {CENTRES}, s AS (SELECT vec_id, e.label, c.label AS route, round(list_cosine_similarity(c.centroid, embedding::DOUBLE[]), 6) AS score FROM embeddings e, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, route) AS k, score - lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, route) AS gap FROM s)
    SELECT vec_id, CASE WHEN score >= 0.3 AND gap >= 0.05 THEN route ELSE -1 END AS route FROM r WHERE k = 1""",
)
def intent_routes(spark, d):
    """The route of the most similar centroid, or none (-1) if it is too far or not clearly ahead of the next."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    few = F.broadcast(vectors.centroids(rows).agg(F.collect_list(F.struct("label", "centroid")).alias("all")))  # a row with all routes
    told = F.transform("all", lambda x: F.struct((-F.round(retrieval.cosine(x["centroid"], F.col("embedding")), 6)).alias("s"), x["label"].alias("l")))
    ranked = rows.crossJoin(few).select("vec_id", F.array_sort(told).alias("r"))
    first, second = F.element_at("r", 1), F.element_at("r", 2)
    sure = (first["s"] <= -0.3) & (second["s"] - first["s"] >= 0.05)
    return ranked.select("vec_id", F.when(sure, first["l"]).otherwise(-1).alias("route"))


@query(
    "late_interaction",
    f"""SELECT label, round(sum(best), 6) AS score, count(*)::BIGINT AS n_query FROM (SELECT a.vec_id, b.label, max({COS}) AS best FROM embeddings a, embeddings b WHERE a.vec_id < 4 GROUP BY 1, 2) GROUP BY label""",
)
def late_interaction(spark, d):
    """Four stated query vectors against sets of vectors: of each the best cosine in a set, added up."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    asked = F.broadcast(rows.where("vec_id < 4").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q")))  # one row
    told = F.transform("q", lambda x: F.struct(x["vec_id"].alias("query"), F.round(retrieval.cosine(x["embedding"], F.col("embedding")), 6).alias("s")))
    best = rows.crossJoin(asked).select("label", F.explode(told).alias("x")).groupBy("label", "x.query").agg(F.max("x.s").alias("s"))
    return best.groupBy("label").agg(F.round(F.sum("s"), 6).alias("score"), F.count("*").alias("n_query"))
