"""Queries of graphs, centroids, resampling, page outlines and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators import graphs, metrics, vectors
from ..operators.retrieval import cosine
from ..sources.tables import table
from ..streaming import events as streams
from .metric_queries import SCORE, _scored
from .registry import query

COSINE = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b}))"
CENTRES = """SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 9) AS v FROM (SELECT label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""


@query(
    "centroid_classifier",
    f"""SELECT truth, said::INT AS said, count(*)::BIGINT AS n FROM (SELECT vec_id, any_value(truth) AS truth, arg_max(label, (score, -label)) AS said FROM (SELECT e.vec_id, e.label AS truth, k.label,
    round({COSINE.format(a='c', b='embedding::DOUBLE[]')}, 6) AS score FROM embeddings e, ({CENTRES}) k) GROUP BY vec_id) GROUP BY 1, 2""",
)
def centroid_classifier(spark, d):
    rows = table(spark, d, "embeddings")
    return metrics.confusion(vectors.by_centroid(rows, vectors.centroids(rows), "vec_id"), "label", "said")


@query(
    "vector_outliers",
    f"""SELECT label, count(*)::BIGINT AS n, round(quantile_disc(dist, 0.95), 6) AS threshold FROM (SELECT e.label, 1 - round({COSINE.format(a='c', b='embedding::DOUBLE[]')}, 6) AS dist
    FROM embeddings e JOIN ({CENTRES}) k USING (label)) GROUP BY label""",
)
def vector_outliers(spark, d):
    rows = table(spark, d, "embeddings")
    near = rows.join(F.broadcast(vectors.centroids(rows)), "label").select("label", (1 - F.round(cosine(F.col("centroid"), F.col("embedding")), 6)).alias("dist"))
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(metrics.nearest_rank("dist", 0.95), 6).alias("threshold"))


_BOOT = "(('0x' || substr(sha256('{}:' || r || ':' || lang || ':' || quality), 1, 12))::UBIGINT / 281474976710656.0)"
RESAMPLES = 2_000


@query(
    "bootstrap_interval",
    f"""SELECT lang, quantile_disc(mean, 0.025) AS low, quantile_disc(mean, 0.975) AS high, count(*)::BIGINT AS n FROM (SELECT lang, r, round(sum(w * quality)::DOUBLE / sum(w), 6) AS mean FROM
    (SELECT lang, r, quality, greatest(round(n + sqrt(n) * sqrt(-2 * ln(1 - {_BOOT.format('radius')})) * cos(2 * pi() * {_BOOT.format('angle')})), 0.0) AS w
    FROM (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), (SELECT unnest(generate_series(0, {RESAMPLES - 1})) AS r)) GROUP BY lang, r HAVING sum(w) > 0) GROUP BY lang""",
)
def bootstrap_interval(spark, d):
    """2,000 resamples of the mean of each language, from counts of the values."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return metrics.resampled_means(rows.groupBy("lang", "quality").agg(F.count("*").alias("n")), "lang", "quality", "n", RESAMPLES)


@query(
    "paired_bootstrap",
    f"""SELECT lang, quantile_disc(mean, 0.025) AS low, quantile_disc(mean, 0.975) AS high, count(*)::BIGINT AS n FROM (SELECT lang, r, round(sum(w * quality)::DOUBLE / sum(w), 6) AS mean FROM
    (SELECT lang, r, quality, greatest(round(n + sqrt(n) * sqrt(-2 * ln(1 - {_BOOT.format('radius')})) * cos(2 * pi() * {_BOOT.format('angle')})), 0.0) AS w
    FROM (SELECT lang, (CASE WHEN (b >= 0.5) = (quality = 1) THEN 1 ELSE 0 END - CASE WHEN (a >= 0.5) = (quality = 1) THEN 1 ELSE 0 END) AS quality, count(*) AS n FROM
    (SELECT lang, quality, {SCORE} AS a, {SCORE.replace("score:", "other:")} AS b FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2),
    (SELECT unnest(generate_series(0, {RESAMPLES - 1})) AS r)) GROUP BY lang, r HAVING sum(w) > 0) GROUP BY lang""",
)
def paired_bootstrap(spark, d):
    """The same of the differences between two runs over the same cases."""
    rows = _scored(spark, d).withColumn("other", tx.bucket(F.col("doc_id"), "other"))
    ok = lambda c: ((F.col(c) >= 0.5) == (F.col("quality") == 1)).cast("int")
    deltas = rows.groupBy("lang", (ok("other") - ok("score")).alias("quality")).agg(F.count("*").alias("n"))
    return metrics.resampled_means(deltas, "lang", "quality", "n", RESAMPLES)


@query(
    "entity_split",
    """SELECT source, n, CASE WHEN before < 0.7 * total THEN 'train' WHEN before < 0.9 * total THEN 'validation' ELSE 'test' END AS part FROM (SELECT source, n, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY b, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT source, count(*)::BIGINT AS n, (('0x' || substr(sha256('entity:' || source), 1, 12))::UBIGINT / 281474976710656.0) AS b FROM documents GROUP BY source))""",
)
def entity_split(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("b", tx.bucket(F.col("source"), "entity"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("b", "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over one row for each source
    total = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    part = F.when(before < 0.7 * total, "train").when(before < 0.9 * total, "validation").otherwise("test")
    return counts.select("source", "n", part.alias("part"))


@query(
    "page_outline",
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links,
    len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs FROM pages""",
)
def page_outline(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"),
    )


@query("two_hops", "SELECT DISTINCT b.l_suppkey AS reached FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey = 1")
def two_hops(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return graphs.hops(edges.where("a = 1").select(F.col("a").alias("id")).distinct(), edges).select(F.col("id").alias("reached"))


@query(
    "cascade_closure",
    "WITH RECURSIVE gone(id) AS (SELECT 7::BIGINT UNION SELECT p_partkey FROM part, gone WHERE p_partkey // 3 = id AND p_partkey <> id) SELECT id FROM gone",
)
def cascade_closure(spark, d):
    """All parts that derive from part 7, where a part derives from the one of a third of its key."""
    edges = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 3).alias("parent"), F.col("p_partkey").alias("child"))
    return graphs.reachable(spark.createDataFrame([(7,)], "id long"), edges)


@query("streamed_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_hours(spark, d):
    return streams.run_to_end(streams.tumbling(streams.read_events(spark, d), "1 hour", late="60 days"))
