"""Queries of evaluation measures: labels of documents against a score that follows from the id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics
from ..sources.tables import table
from .registry import query

SCORE = "(('0x' || substr(sha256('score:' || doc_id), 1, 12))::UBIGINT / 281474976710656.0)"
SCORED = f"(SELECT doc_id, lang, source, n_chars, quality, toxic, {SCORE} AS score, CASE WHEN {SCORE} >= 0.5 THEN 1 ELSE 0 END AS said FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    rows = rows.withColumn("score", tx.bucket(F.col("doc_id"), "score"))
    return rows.withColumn("said", (F.col("score") >= 0.5).cast("int"))


@query("confusion_matrix", f"SELECT quality AS truth, said, count(*)::BIGINT AS n FROM {SCORED} GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(_scored(spark, d), "quality", "said")


@query(
    "label_report",
    f"""SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (SELECT label, support::BIGINT AS support,
    CASE WHEN n = 0 THEN 0 ELSE tp::DOUBLE / n END AS p, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS r FROM (SELECT label, (SELECT count(*) FROM {SCORED} WHERE quality = label) AS support,
    (SELECT count(*) FROM {SCORED} WHERE said = label) AS n, (SELECT count(*) FROM {SCORED} WHERE said = label AND quality = label) AS tp FROM (SELECT unnest([0, 1]) AS label)))""",
)
def label_report(spark, d):
    return metrics.label_report(_scored(spark, d), "quality", "said")


@query(
    "threshold_sweep",
    f"""SELECT step::INT AS step, sum(quality) FILTER (WHERE score >= step / 10.0)::BIGINT AS tp, sum(1 - quality) FILTER (WHERE score >= step / 10.0)::BIGINT AS fp,
    sum(quality) FILTER (WHERE score < step / 10.0)::BIGINT AS fn, sum(1 - quality) FILTER (WHERE score < step / 10.0)::BIGINT AS tn FROM {SCORED}, (SELECT unnest(generate_series(0, 9)) AS step) GROUP BY step""".replace(
        "sum(quality) FILTER (WHERE score < step / 10.0)::BIGINT AS fn", "coalesce(sum(quality) FILTER (WHERE score < step / 10.0), 0)::BIGINT AS fn").replace(
        "sum(1 - quality) FILTER (WHERE score < step / 10.0)::BIGINT AS tn", "coalesce(sum(1 - quality) FILTER (WHERE score < step / 10.0), 0)::BIGINT AS tn"),
)
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(_scored(spark, d), "score", "quality", 10).where("step < 10")


@query(
    "calibration_bins",
    f"SELECT least(floor(score * 10), 9)::INT AS bin, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS accuracy FROM {SCORED} GROUP BY 1",
)
def calibration_bins(spark, d):
    found = metrics.calibration(_scored(spark, d), "score", "quality")
    return found.withColumns({"mean_score": F.round("mean_score", 6), "accuracy": F.round("accuracy", 6)})


@query(
    "calibration_error",
    f"""SELECT (SELECT round(avg((score - quality) * (score - quality)), 6) FROM {SCORED}) AS brier, round(sum(n * abs(mean_score - accuracy)) / sum(n), 6) AS ece FROM
    (SELECT count(*) AS n, avg(score) AS mean_score, avg(quality) AS accuracy FROM {SCORED} GROUP BY least(floor(score * 10), 9))""",
)
def calibration_error(spark, d):
    rows = _scored(spark, d)
    brier = rows.agg(F.round(F.avg((F.col("score") - F.col("quality")) ** 2), 6).alias("brier"))
    gap = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("accuracy"))) / F.sum("n")
    return brier.crossJoin(metrics.calibration(rows, "score", "quality").agg(F.round(gap, 6).alias("ece")))  # one row each


@query(
    "slice_breakdown",
    f"""SELECT coalesce(lang, '__all__') AS slice, count(*)::BIGINT AS n, round(avg(CASE WHEN said = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {SCORED} GROUP BY GROUPING SETS ((lang), ())""",
)
def slice_breakdown(spark, d):
    rows = _scored(spark, d).rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("quality")).cast("double")), 6).alias("accuracy"))
    return rows.select(F.coalesce("lang", F.lit("__all__")).alias("slice"), "n", "accuracy")


@query(
    "wilson_intervals",
    """SELECT lang, n, round((p + 3.8416 / (2 * n) - w) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + w) / (1 + 3.8416 / n), 6) AS high FROM
    (SELECT lang, n, p, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) AS w FROM (SELECT lang, count(*)::BIGINT AS n, avg(toxic)::DOUBLE AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang))""",
)
def wilson_intervals(spark, d):
    counts = _scored(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return counts.select("lang", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "two_proportions",
    """SELECT round((a / na - b / nb) / sqrt((a + b) / (na + nb) * (1 - (a + b) / (na + nb)) * (1 / na + 1 / nb)), 6) AS z, round(a / na - b / nb, 6) AS difference FROM
    (SELECT sum(quality) FILTER (WHERE lang = 'en')::DOUBLE AS a, count(*) FILTER (WHERE lang = 'en')::DOUBLE AS na, sum(quality) FILTER (WHERE lang <> 'en')::DOUBLE AS b, count(*) FILTER (WHERE lang <> 'en')::DOUBLE AS nb
    FROM documents JOIN labels USING (doc_id))""",
)
def two_proportions(spark, d):
    english = F.col("lang") == "en"
    sums = _scored(spark, d).agg(
        F.sum(F.when(english, F.col("quality"))).cast("double").alias("a"), F.count_if(english).cast("double").alias("na"),
        F.sum(F.when(~english, F.col("quality"))).cast("double").alias("b"), F.count_if(~english).cast("double").alias("nb"),
    )
    a, na, b, nb = map(F.col, ("a", "na", "b", "nb"))
    p = (a + b) / (na + nb)
    return sums.select(F.round((a / na - b / nb) / F.sqrt(p * (1 - p) * (1 / na + 1 / nb)), 6).alias("z"), F.round(a / na - b / nb, 6).alias("difference"))


@query(
    "cohens_kappa",
    f"""SELECT round(po, 6) AS observed, round(pe, 6) AS chance, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT avg(CASE WHEN quality = said THEN 1.0 ELSE 0.0 END) AS po,
    avg(quality) * avg(said) + (1 - avg(quality)) * (1 - avg(said)) AS pe FROM {SCORED})""",
)
def cohens_kappa(spark, d):
    return metrics.kappa(_scored(spark, d), "quality", "said")


@query(
    "paired_disagreements",
    f"SELECT count(*) FILTER (WHERE said = quality AND toxic <> quality)::BIGINT AS a_only, count(*) FILTER (WHERE said <> quality AND toxic = quality)::BIGINT AS b_only, count(*)::BIGINT AS n FROM {SCORED}",
)
def paired_disagreements(spark, d):
    a, b = F.col("said") == F.col("quality"), F.col("toxic") == F.col("quality")
    return _scored(spark, d).agg(F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"), F.count("*").alias("n"))


@query(
    "length_distribution",
    """SELECT lang, count(*)::BIGINT AS n, quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95, max(n_chars)::BIGINT AS longest, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang""",
)
def length_distribution(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), metrics.nearest_rank("n_chars", 0.5).cast("long").alias("p50"), metrics.nearest_rank("n_chars", 0.95).cast("long").alias("p95"),
        F.max("n_chars").alias("longest"), F.sum("n_chars").alias("total"),
    )


@query(
    "release_gate",
    f"""SELECT 'accuracy' AS name, round(avg(CASE WHEN said = quality THEN 1.0 ELSE 0.0 END), 6) AS value, avg(CASE WHEN said = quality THEN 1.0 ELSE 0.0 END) >= 0.45 AS passed FROM {SCORED}
    UNION ALL SELECT 'recall', round(avg(said), 6), avg(said) >= 0.6 FROM {SCORED} WHERE quality = 1 UNION ALL
    SELECT 'toxic_rate', round(avg(toxic), 6), avg(toxic) <= 0.2 FROM {SCORED}""",
)
def release_gate(spark, d):
    sums = _scored(spark, d).agg(
        F.avg((F.col("said") == F.col("quality")).cast("double")).alias("accuracy"), F.avg(F.when(F.col("quality") == 1, F.col("said"))).alias("recall"), F.avg("toxic").alias("toxic_rate")
    )
    checks = [("accuracy", ">=", 0.45), ("recall", ">=", 0.6), ("toxic_rate", "<=", 0.2)]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(n), 6).alias("value"), F.coalesce(F.expr(f"{n} {sign} {bound}"), F.lit(False)).alias("passed")) for n, sign, bound in checks])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


@query(
    "embedding_centroids",
    """SELECT label, (i - 1)::INT AS dim, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM (SELECT label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY label, i""",
)
def embedding_centroids(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query(
    "embedding_norms",
    "SELECT label, count(*)::BIGINT AS n, round(avg(norm), 5) AS mean_norm, round(min(norm), 5) AS least FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) GROUP BY label",
)
def embedding_norms(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table(spark, d, "embeddings").select("label", norm.alias("norm"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 5).alias("mean_norm"), F.round(F.min("norm"), 5).alias("least"))
