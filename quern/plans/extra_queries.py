"""Further queries of measures, ledgers, rankings and text parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators import metrics, retrieval, vectors, windows
from ..sources.tables import table
from .metric_queries import SCORED, _scored
from .more_queries import CENTRES, COSINE
from .registry import query
from .retrieval_queries import SQL, _both, _queries


@query(
    "recent_quantiles",
    """SELECT event_type, len(v)::BIGINT AS n, v[round(0.5 * (len(v) - 1))::INT + 1] AS p50, v[round(0.95 * (len(v) - 1))::INT + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM
    (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2000 GROUP BY event_type)""",
)
def recent_quantiles(spark, d):
    """Quantiles of the last 2,000 observations, at the rounded place: the lists are of bounded size."""
    last = windows.top_per_group(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 2000)
    lists = last.groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = lambda q: F.element_at("v", (F.round(q * (F.size("v") - 1)) + 1).cast("int"))
    return lists.select("event_type", F.size("v").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("flaky_users", "SELECT user_id, count(*)::BIGINT AS n, count(DISTINCT value > 50)::BIGINT AS n_verdicts, bool_and(value > 50) AS all_pass FROM events GROUP BY user_id HAVING count(DISTINCT value > 50) > 1")
def flaky_users(spark, d):
    rows = table(spark, d, "events").withColumn("ok", F.col("value") > 50).groupBy("user_id")
    found = rows.agg(F.count("*").alias("n"), (F.max("ok").cast("long") - F.min("ok").cast("long") + 1).alias("n_verdicts"), F.bool_and("ok").alias("all_pass"))
    return found.where("n_verdicts > 1")


@query(
    "pass_at_k",
    "SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS any_of_3, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS all_of_3 FROM (SELECT user_id, bool_or(value > 50) AS a, bool_and(value > 50) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id)",
)
def pass_at_k(spark, d):
    tries = windows.top_per_group(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 3)
    users = tries.groupBy("user_id").agg(F.bool_or(F.col("value") > 50).alias("a"), F.bool_and(F.col("value") > 50).alias("b"))
    return users.agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(x).cast("double")), 6).alias(f"{y}_of_3") for x, y in (("a", "any"), ("b", "all"))])


@query("case_means", "SELECT round(avg(m), 6) AS mean_of_means, count(*)::BIGINT AS n_cases FROM (SELECT user_id, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY user_id)")
def case_means(spark, d):
    cases = table(spark, d, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.avg("value").alias("m"))
    return cases.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count("*").alias("n_cases"))


@query("abstention_cells", f"SELECT abs(score - 0.5) < 0.1 AS abstained, said = quality AS correct, count(*)::BIGINT AS n FROM {SCORED} GROUP BY 1, 2")
def abstention_cells(spark, d):
    rows = _scored(spark, d).select((F.abs(F.col("score") - 0.5) < 0.1).alias("abstained"), (F.col("said") == F.col("quality")).alias("correct"))
    return rows.groupBy("abstained", "correct").agg(F.count("*").alias("n"))


@query(
    "cascade_costs",
    f"""SELECT step::INT AS step, round(sum(CASE WHEN score < step / 10.0 THEN 6 ELSE 1 END)::DOUBLE / count(*), 6) AS mean_cost, round(avg(CASE WHEN score < step / 10.0 OR said = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM {SCORED}, (SELECT unnest(generate_series(0, 9)) AS step) GROUP BY step""",
)
def cascade_costs(spark, d):
    """What it costs, and how often it is right, to hand rows below a threshold to a model that is always right."""
    reached = _scored(spark, d).select(F.floor(F.col("score") * 10).cast("int").alias("b"), (F.col("said") == F.col("quality")).cast("int").alias("ok"))
    counts = reached.groupBy("b").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda s: F.struct(s.cast("int").alias("step"), (F.col("b") < s).alias("up"))))
    rows = counts.select("n", "ok", steps.alias("x")).groupBy("x.step")  # ten rows of counts, ten thresholds
    cost, right = F.sum(F.when(F.col("x.up"), 6 * F.col("n")).otherwise(F.col("n"))), F.sum(F.when(F.col("x.up"), F.col("n")).otherwise(F.col("ok")))
    return rows.agg(F.round(cost / F.sum("n"), 6).alias("mean_cost"), F.round(right / F.sum("n"), 6).alias("accuracy"))


@query(
    "late_and_orphan_events",
    """SELECT CASE WHEN c_custkey IS NULL THEN 'orphan' WHEN ts >= first_ts + INTERVAL '14 days' THEN 'late' ELSE 'in_time' END AS kind, count(*)::BIGINT AS n FROM events LEFT JOIN customer ON user_id = c_custkey
    JOIN (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id) USING (user_id) GROUP BY 1""",
)
def late_and_orphan_events(spark, d):
    events = table(spark, d, "events").select("user_id", "ts")
    first = events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    kind = F.when(F.col("known").isNull(), "orphan").when(F.col("ts") >= F.col("first_ts") + F.expr("INTERVAL '14' DAY"), "late").otherwise("in_time")
    return events.join(first, "user_id").join(known, "user_id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("daily_ledger", "SELECT user_id, ts::DATE AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS spend FROM events GROUP BY 1, 2")
def daily_ledger(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spend"))


@query(
    "softmax_entropy",
    """SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy, round(max(p), 6) AS top FROM (SELECT user_id, exp(n / 5.0) / sum(exp(n / 5.0)) OVER (PARTITION BY user_id) AS p FROM
    (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY user_id""",
)
def softmax_entropy(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    weight = F.exp(F.col("n") / 5.0)
    rows = rows.withColumn("p", weight / F.sum(weight).over(Window.partitionBy("user_id")))
    return rows.groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"), F.round(F.max("p"), 6).alias("top"))


@query(
    "edge_order",
    """SELECT l_orderkey, l_linenumber, (CASE WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n - r // 2 + 1 END)::BIGINT AS position FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)""",
)
def edge_order(spark, d):
    """The best first, the second best last, the weakest in the middle."""
    own = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(own.orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("r"), F.count("*").over(own).alias("n"))
    place = F.when(F.col("r") % 2 == 1, F.floor((F.col("r") + 1) / 2)).otherwise(F.col("n") - F.floor(F.col("r") / 2) + 1)
    return rows.select("l_orderkey", "l_linenumber", place.cast("long").alias("position"))


@query("newest_version", "SELECT o_custkey, o_orderkey FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m")
def newest_version(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(newest, ["o_custkey", "o_orderdate"]).select("o_custkey", "o_orderkey")


@query(
    "canary_decision",
    """SELECT variant, n, round(rate, 6) AS rate, CASE WHEN n < 50 THEN 'hold' WHEN rate > 1.2 * max(CASE WHEN variant = 'old' THEN rate END) OVER () THEN 'roll_back' ELSE 'promote' END AS decision FROM (SELECT CASE WHEN user_id % 10 = 0 THEN 'new' ELSE 'old' END AS variant,
    count(*)::BIGINT AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1)""",
)
def canary_decision(spark, d):
    variant = F.when(F.col("user_id") % 10 == 0, "new").otherwise("old")
    rates = table(spark, d, "events").groupBy(variant.alias("variant")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    old = F.max(F.when(F.col("variant") == "old", F.col("rate"))).over(Window.partitionBy(F.lit(1)))  # over two rows
    return rates.select("variant", "n", F.round("rate", 6).alias("rate"), F.when(F.col("n") < 50, "hold").when(F.col("rate") > 1.2 * old, "roll_back").otherwise("promote").alias("decision"))


@query(
    "metric_anomalies",
    """WITH days AS (SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE) AS r FROM events GROUP BY 1, 2), base AS (SELECT event_type, quantile_cont(n, 0.5) AS b FROM days WHERE r <= 6 GROUP BY 1)
    SELECT event_type, min(day) FILTER (WHERE r > 6 AND n >= 1.3 * b) AS onset, count(*) FILTER (WHERE r > 6 AND n >= 1.3 * b)::BIGINT AS n_days FROM days JOIN base USING (event_type) GROUP BY event_type""",
)
def metric_anomalies(spark, d):
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = days.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("day")))
    base = days.where("r <= 6").groupBy("event_type").agg(F.expr("percentile(n, 0.5)").alias("b"))
    odd = (F.col("r") > 6) & (F.col("n") >= 1.3 * F.col("b"))
    return days.join(base, "event_type").groupBy("event_type").agg(F.min(F.when(odd, F.col("day"))).alias("onset"), F.count_if(odd).alias("n_days"))


@query("sentence_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[.!?]+([ \n]|$)'))::BIGINT AS n FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[.!?]+([ \n]|\z)")).cast("long").alias("n"))


@query("identifier_counts", r"SELECT source, sum(len(regexp_extract_all(text, '\b[A-Za-z]+[0-9][A-Za-z0-9]*\b')))::BIGINT AS n FROM documents GROUP BY source")
def identifier_counts(spark, d):
    n = F.regexp_count("text", F.lit(r"\b[A-Za-z]+[0-9][A-Za-z0-9]*\b"))
    return table(spark, d, "documents").groupBy("source").agg(F.sum(n).alias("n"))


@query(
    "running_edges",
    """SELECT source, md5(line) AS line_md5, count(*)::BIGINT AS n FROM (SELECT source, unnest(list_distinct([regexp_replace(l[1], '[0-9]', '#', 'g'), regexp_replace(l[len(l)], '[0-9]', '#', 'g')])) AS line FROM
    (SELECT source, string_split(text, chr(10)) AS l FROM documents)) GROUP BY source, line HAVING count(*) >= 2""",
)
def running_edges(spark, d):
    """First and last lines, digits masked, that several documents of a source have."""
    lines = F.split("text", "\n")
    edges = F.array_distinct(F.transform(F.array(F.element_at(lines, 1), F.element_at(lines, -1)), lambda x: F.regexp_replace(x, "[0-9]", "#")))
    rows = table(spark, d, "documents").select("source", F.explode(edges).alias("line"))
    return rows.groupBy("source", F.md5("line").alias("line_md5")).agg(F.count("*").alias("n")).where("n >= 2")


@query(
    "overlap_at_10",
    f"{SQL} SELECT query_id::INT AS query_id, count(*)::BIGINT AS n_shared FROM bm25r JOIN tfidfr USING (query_id, doc_id) WHERE bm25r.rank <= 10 AND tfidfr.rank <= 10 GROUP BY query_id",
)
def overlap_at_10(spark, d):
    first, second = (x.where("rank <= 10").select("query_id", "doc_id") for x in _both(spark, d))
    return first.join(second, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("n_shared"))


@query(
    "coverage_rerank",
    f"""{SQL}, v AS (SELECT query_id, doc_id, count(DISTINCT term)::DOUBLE / any_value(total) AS coverage FROM h JOIN q USING (term) JOIN (SELECT query_id, count(*) AS total FROM q GROUP BY query_id) USING (query_id) GROUP BY 1, 2)
    SELECT query_id::INT AS query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT query_id, doc_id, round(coverage + 0.001 / rank, 6) AS score FROM bm25r JOIN v USING (query_id, doc_id))) WHERE r <= 5""",
)
def coverage_rerank(spark, d):
    """The best fifty by BM25 in the order of how many of the query's terms they hold, with a little for their rank."""
    documents, asked = table(spark, d, "documents"), _queries(spark)
    parts = retrieval.bm25(documents, asked, explain=True)
    held = parts.groupBy("query_id", "doc_id").agg(F.count_distinct("term").alias("k"), F.round(F.sum("part"), 6).alias("score"))
    total = asked.select("query_id", F.size(F.array_distinct(tx.terms(F.col("query")))).alias("total"))
    best = retrieval.ranked(held, "doc_id", 50).join(F.broadcast(total), "query_id")
    score = F.round(F.col("k") / F.col("total") + 0.001 / F.col("rank"), 6)
    return retrieval.ranked(best.select("query_id", "doc_id", score.alias("score")), "doc_id", 5).select("query_id", "doc_id", "score")


@query(
    "similarity_profile",
    f"""SELECT label, quantile_disc(s, 0.05) AS p05, quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.95) AS p95 FROM (SELECT e.label, round({COSINE.format(a='c', b='embedding::DOUBLE[]')}, 6) AS s FROM embeddings e JOIN ({CENTRES}) k USING (label)) GROUP BY label""",
)
def similarity_profile(spark, d):
    rows = table(spark, d, "embeddings")
    near = rows.join(F.broadcast(vectors.centroids(rows)), "label").select("label", F.round(retrieval.cosine(F.col("centroid"), F.col("embedding")), 6).alias("s"))
    return near.groupBy("label").agg(*[metrics.nearest_rank("s", q).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)])


@query("ordered_lookup", "SELECT o_orderkey, o_custkey, (CASE o_orderkey WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::INT AS place FROM orders WHERE o_orderkey IN (5, 3, 1, 999999999) AND o_orderstatus <> 'P'")
def ordered_lookup(spark, d):
    """Rows by key in the order asked for; unknown and hidden keys are both left out."""
    asked = spark.createDataFrame([(5, 0), (3, 1), (1, 2), (999_999_999, 3)], "o_orderkey long, place int")
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'").join(F.broadcast(asked), "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "place")


@query("tombstones_hidden", "SELECT o_custkey, o_orderkey, r::INT AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)) WHERE r <= 2")
def tombstones_hidden(spark, d):
    hidden = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = table(spark, d, "orders").join(hidden, "o_orderkey", "left_anti")
    return windows.top_per_group(kept, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")
