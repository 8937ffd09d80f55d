"""Queries that score predictions, compare runs and decide, and that put ranked rows together."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..sources.tables import table
from .metric_queries import SCORE, SCORED, _scored
from .registry import query

OTHER = SCORE.replace("score:", "other:")
PAIRED = f"(SELECT doc_id, source, lang, quality, {SCORE} AS a, {OTHER} AS b FROM documents JOIN labels USING (doc_id))"


def _paired(spark, d):
    """Two runs over the same cases: scores a and b."""
    return _scored(spark, d).withColumnRenamed("score", "a").withColumn("b", tx.bucket(F.col("doc_id"), "other"))


@query(
    "set_scores",
    """SELECT l_orderkey, count(*) FILTER (WHERE p AND e)::BIGINT AS hits, CASE WHEN count(*) FILTER (WHERE p) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE p AND e)::DOUBLE / count(*) FILTER (WHERE p), 6) END AS precision,
    CASE WHEN count(*) FILTER (WHERE e) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE p AND e)::DOUBLE / count(*) FILTER (WHERE e), 6) END AS recall
    FROM (SELECT l_orderkey, l_quantity > 25 AS p, l_returnflag = 'R' AS e FROM lineitem) GROUP BY l_orderkey""",
)
def set_scores(spark, d):
    """Precision and recall of a predicted set of lines for each order; an empty set scores 0."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 25).alias("p"), (F.col("l_returnflag") == "R").alias("e")).groupBy("l_orderkey")
    counts = rows.agg(F.count_if(F.col("p") & F.col("e")).alias("hits"), F.count_if("p").alias("np"), F.count_if("e").alias("ne"))
    share = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.round(F.col("hits") / F.col(n), 6))
    return counts.select("l_orderkey", "hits", share("np").alias("precision"), share("ne").alias("recall"))


FIELDS = " UNION ALL ".join(
    f"SELECT '{name}' AS field, {col}::VARCHAR AS e, CASE WHEN o_orderkey % {skip} = 0 THEN NULL WHEN o_orderkey % {wrong} = 0 THEN 'wrong' ELSE {col}::VARCHAR END AS p FROM orders"
    for name, col, skip, wrong in (("status", "o_orderstatus", 7, 5), ("priority", "o_orderpriority", 11, 3), ("customer", "o_custkey", 13, 17))
)


@query(
    "field_scores",
    f"""SELECT field, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM (SELECT field, count(*) FILTER (WHERE p = e)::BIGINT AS tp, count(*) FILTER (WHERE p <> e)::BIGINT AS fp,
    count(*) FILTER (WHERE p IS NULL OR p <> e)::BIGINT AS fn FROM ({FIELDS}) GROUP BY field)""",
)
def field_scores(spark, d):
    """Extracted fields against the true ones: a wrong value is a false positive and a missed one; one pass over the rows."""
    key, fields = F.col("o_orderkey"), []
    for name, col, skip, wrong in (("status", "o_orderstatus", 7, 5), ("priority", "o_orderpriority", 11, 3), ("customer", "o_custkey", 13, 17)):
        true = F.col(col).cast("string")
        said = F.when(key % skip == 0, F.lit(None).cast("string")).when(key % wrong == 0, "wrong").otherwise(true)
        fields.append(F.struct(F.lit(name).alias("field"), true.alias("e"), said.alias("p")))
    rows = table(spark, d, "orders").select(F.inline(F.array(*fields)))
    counts = rows.groupBy("field").agg(F.count_if(F.col("p") == F.col("e")).alias("tp"), F.count_if(F.col("p") != F.col("e")).alias("fp"), F.count_if(F.col("p").isNull() | (F.col("p") != F.col("e"))).alias("fn"))
    return counts.withColumn("f1", F.round(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@query(
    "matched_lines",
    """WITH gold AS (SELECT l_orderkey AS k, round(l_extendedprice * 100)::BIGINT AS c, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey, round(l_extendedprice * 100)::BIGINT, l_quantity ORDER BY l_linenumber) AS r FROM lineitem),
    said AS (SELECT k, c, q, row_number() OVER (PARTITION BY k, c, q ORDER BY n) AS r FROM (SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice * 100)::BIGINT + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS c, l_quantity::BIGINT AS q FROM lineitem WHERE l_partkey % 9 <> 0))
    SELECT k AS l_orderkey, count(*) FILTER (WHERE s AND g)::BIGINT AS tp, count(*) FILTER (WHERE s AND NOT g)::BIGINT AS fp, count(*) FILTER (WHERE g AND NOT s)::BIGINT AS fn FROM
    (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS s, b.k IS NOT NULL AS g FROM said a FULL JOIN gold b ON a.k = b.k AND a.c = b.c AND a.q = b.q AND a.r = b.r) GROUP BY k""",
)
def matched_lines(spark, d):
    """One-to-one matches of lines of equal amount and quantity: the first with the first, the second with the second."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"), F.col("l_quantity").cast("long").alias("q"))

    def numbered(rows, name):
        place = F.row_number().over(Window.partitionBy("k", "c", "q").orderBy("l_linenumber"))
        return rows.select("k", "c", "q", place.alias("r"), F.lit(True).alias(name))

    said = lines.where("l_partkey % 9 <> 0").withColumn("c", F.col("c") + F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0))
    both = numbered(said, "s").join(numbered(lines, "g"), ["k", "c", "q", "r"], "full")
    s, g = F.col("s").isNotNull(), F.col("g").isNotNull()
    return both.groupBy(F.col("k").alias("l_orderkey")).agg(F.count_if(s & g).alias("tp"), F.count_if(s & ~g).alias("fp"), F.count_if(g & ~s).alias("fn"))


@query("paired_deltas", f"SELECT doc_id, round(b - a, 6) AS delta, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(b - a, 6), doc_id) AS rank FROM {PAIRED}) WHERE rank <= 50")
def paired_deltas(spark, d):
    """The cases that lose most: each partition keeps its 50 first."""
    rows = _paired(spark, d).select("doc_id", F.round(F.col("b") - F.col("a"), 6).alias("delta")).orderBy("delta", "doc_id").limit(50)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("delta", "doc_id")).cast("long"))  # over 50 rows


@query(
    "run_comparison",
    f"""SELECT source, count(*) FILTER (WHERE ok_a AND NOT ok_b)::BIGINT AS regressions, count(*) FILTER (WHERE ok_b AND NOT ok_a)::BIGINT AS fixes, count(*) FILTER (WHERE ok_a AND NOT ok_b AND lang = 'en')::BIGINT AS critical
    FROM (SELECT *, (a >= 0.5) = (quality = 1) AS ok_a, (b >= 0.5) = (quality = 1) AS ok_b FROM {PAIRED}) GROUP BY source""",
)
def run_comparison(spark, d):
    rows = _paired(spark, d)
    for run in "ab":
        rows = rows.withColumn(f"ok_{run}", (F.col(run) >= 0.5) == (F.col("quality") == 1))
    lost = F.col("ok_a") & ~F.col("ok_b")
    return rows.groupBy("source").agg(F.count_if(lost).alias("regressions"), F.count_if(F.col("ok_b") & ~F.col("ok_a")).alias("fixes"), F.count_if(lost & (F.col("lang") == "en")).alias("critical"))


@query("shadow_agreement", f"SELECT source, count(*)::BIGINT AS n, round(avg(CASE WHEN (a >= 0.5) = (b >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM {PAIRED} GROUP BY source")
def shadow_agreement(spark, d):
    same = ((F.col("a") >= 0.5) == (F.col("b") >= 0.5)).cast("double")
    return _paired(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("agreement"))


@query(
    "judge_calibration",
    f"""SELECT source, n, round((tp + tn)::DOUBLE / n, 6) AS agreement, fp::BIGINT AS false_pass, fn::BIGINT AS false_fail, CASE WHEN pe >= 1 THEN 1.0 ELSE round(((tp + tn)::DOUBLE / n - pe) / (1 - pe), 6) END AS kappa FROM
    (SELECT *, ((tp + fp)::DOUBLE / n) * ((tp + fn)::DOUBLE / n) + ((tn + fn)::DOUBLE / n) * ((tn + fp)::DOUBLE / n) AS pe FROM (SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE said = 1 AND quality = 1) AS tp,
    count(*) FILTER (WHERE said = 1 AND quality = 0) AS fp, count(*) FILTER (WHERE said = 0 AND quality = 1) AS fn, count(*) FILTER (WHERE said = 0 AND quality = 0) AS tn FROM {SCORED} GROUP BY source))""",
)
def judge_calibration(spark, d):
    cell = lambda s, q: F.count_if((F.col("said") == s) & (F.col("quality") == q))
    rows = _scored(spark, d).groupBy("source").agg(F.count("*").alias("n"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    chance = (tp + fp) / n * ((tp + fn) / n) + (tn + fn) / n * ((tn + fp) / n)
    kappa = F.when(chance >= 1, 1.0).otherwise(F.round(((tp + tn) / n - chance) / (1 - chance), 6))
    return rows.select("source", "n", F.round((tp + tn) / n, 6).alias("agreement"), fp.alias("false_pass"), fn.alias("false_fail"), kappa.alias("kappa"))


@query(
    "weighted_kappa",
    f"""SELECT round(1 - sum(n * w) / sum(e * w), 6) AS kappa, sum(n)::BIGINT AS n FROM (SELECT x.g AS g, y.g AS h, power(x.g - y.g, 2) AS w, x.n * y.n::DOUBLE / t AS e, coalesce(c.n, 0) AS n FROM
    (SELECT floor(a * 5)::INT AS g, count(*) AS n FROM {PAIRED} GROUP BY 1) x, (SELECT floor(b * 5)::INT AS g, count(*) AS n FROM {PAIRED} GROUP BY 1) y, (SELECT count(*) AS t FROM {PAIRED})
    LEFT JOIN (SELECT floor(a * 5)::INT AS g, floor(b * 5)::INT AS h, count(*) AS n FROM {PAIRED} GROUP BY 1, 2) c ON c.g = x.g AND c.h = y.g)""",
)
def weighted_kappa(spark, d):
    """Quadratic weights over five grades: all follows from the 25 counts of grade pairs."""
    grade = lambda c: F.floor(F.col(c) * 5).cast("int")
    cells = _paired(spark, d).groupBy(grade("a").alias("g"), grade("b").alias("h")).agg(F.count("*").alias("n"))
    one = cells.agg(F.collect_list(F.struct("g", "h", "n")).alias("c"), F.sum("n").alias("t"))  # 25 rows
    total = lambda side, at: F.aggregate(F.filter("c", lambda x: x[side] == at), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    observed = F.aggregate("c", F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["g"] - x["h"], F.lit(2)))
    grades = [(i, j) for i in range(5) for j in range(5)]
    expected = sum((total("g", F.lit(i)) * total("h", F.lit(j)) * float((i - j) ** 2) / F.col("t") for i, j in grades), F.lit(0.0))
    return one.select(F.round(1 - observed / expected, 6).alias("kappa"), F.col("t").alias("n"))


@query(
    "precision_threshold",
    f"""SELECT target, min(CASE WHEN p >= target THEN bin END) / 100.0 AS threshold, coalesce(max(CASE WHEN p >= target THEN n END), 0)::BIGINT AS n_accepted FROM (SELECT bin, sum(good) OVER w / sum(c) OVER w AS p, sum(c) OVER w AS n FROM
    (SELECT floor(score * 100)::INT AS bin, sum(quality) AS good, count(*) AS c FROM {SCORED} GROUP BY 1) WINDOW w AS (ORDER BY bin DESC)), (SELECT unnest([0.4::DOUBLE, 0.5, 0.6]) AS target) GROUP BY target""",
)
def precision_threshold(spark, d):
    """The lowest threshold whose accepted rows are right often enough: running sums over 100 bins of scores."""
    bins = _scored(spark, d).groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin")).agg(F.sum("quality").alias("good"), F.count("*").alias("c"))
    down = Window.orderBy(F.desc("bin"))  # over 100 rows
    rows = bins.select("bin", (F.sum("good").over(down) / F.sum("c").over(down)).alias("p"), F.sum("c").over(down).alias("n"))
    rows = rows.withColumn("target", F.explode(F.array(F.lit(0.4), F.lit(0.5), F.lit(0.6))))
    ok = F.col("p") >= F.col("target")
    return rows.groupBy("target").agg((F.min(F.when(ok, F.col("bin"))) / 100.0).alias("threshold"), F.coalesce(F.max(F.when(ok, F.col("n"))), F.lit(0)).alias("n_accepted"))


@query(
    "bias_report",
    r"""SELECT toxic, count(*)::BIGINT AS n, round(avg(len(w)), 4) AS words, round(avg(len(list_distinct(w))::DOUBLE / greatest(len(w), 1)), 6) AS distinct_share FROM
    (SELECT toxic, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents JOIN labels USING (doc_id)) GROUP BY toxic""",
)
def bias_report(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w")).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    distinct = F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))
    return rows.groupBy("toxic").agg(F.count("*").alias("n"), F.round(F.avg(F.size("w")), 4).alias("words"), F.round(F.avg(distinct), 6).alias("distinct_share"))


WILSON = "((p + 1.9208 / n) - 1.96 * sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)"


def _wilson_low(p, n):
    return ((p + 1.9208 / n) - 1.96 * F.sqrt((p * (1 - p) + 0.9604 / n) / n)) / (1 + 3.8416 / n)


@query(
    "model_choice",
    f"""SELECT source AS model, n, round(p, 6) AS quality, round({WILSON}, 6) AS low, round(cost, 6) AS cost, coalesce(cost = min(CASE WHEN {WILSON} >= 0.35 THEN cost END) OVER (), false) AND {WILSON} >= 0.35 AS chosen FROM
    (SELECT source, count(*)::BIGINT AS n, avg(CASE WHEN said = quality THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(n_chars) AS cost FROM {SCORED} GROUP BY source)""",
)
def model_choice(spark, d):
    """The cheapest of the models whose quality is good enough even at the lower end of its interval."""
    rows = _scored(spark, d).groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("quality")).cast("double")).alias("p"), F.avg("n_chars").alias("c"))
    low = _wilson_low(F.col("p"), F.col("n"))
    best = F.min(F.when(low >= 0.35, F.col("c"))).over(Window.partitionBy(F.lit(1)))  # over the models
    return rows.select("model", "n", F.round("p", 6).alias("quality"), F.round(low, 6).alias("low"), F.round("c", 6).alias("cost"), (F.coalesce(F.col("c") == best, F.lit(False)) & (low >= 0.35)).alias("chosen"))


@query(
    "check_rates",
    f"""SELECT toxic, n, n_flagged, round({WILSON}, 6) AS low FROM (SELECT toxic, count(*)::BIGINT AS n, count(*) FILTER (WHERE f)::BIGINT AS n_flagged, count(*) FILTER (WHERE f)::DOUBLE / count(*) AS p FROM
    (SELECT toxic, regexp_matches(lower(text), '(idiot|stupid|password|ignore)') AS f FROM documents JOIN labels USING (doc_id)) GROUP BY toxic)""",
)
def check_rates(spark, d):
    """How often a check flags rows that it should and rows that it should not, with the lower end of the interval."""
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").rlike("(idiot|stupid|password|ignore)").alias("f")).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    counts = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("f").alias("n_flagged"))
    return counts.select("toxic", "n", "n_flagged", F.round(_wilson_low(F.col("n_flagged") / F.col("n"), F.col("n")), 6).alias("low"))


@query(
    "bucketed_percentiles",
    """SELECT event_type, min(CASE WHEN run >= 0.5 * t THEN b END)::BIGINT AS p50, min(CASE WHEN run >= 0.95 * t THEN b END)::BIGINT AS p95, any_value(t)::BIGINT AS n FROM (SELECT event_type, b, sum(c) OVER (PARTITION BY event_type ORDER BY b) AS run, sum(c) OVER (PARTITION BY event_type) AS t
    FROM (SELECT event_type, floor(value)::BIGINT AS b, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1, 2)) GROUP BY event_type""",
)
def bucketed_percentiles(spark, d):
    """Percentiles to a whole number: counts add up before the shuffle, and a type's window holds its buckets only."""
    buckets = table(spark, d, "events").where("value IS NOT NULL").groupBy("event_type", F.floor("value").alias("b")).agg(F.count("*").alias("c"))
    own = Window.partitionBy("event_type")
    rows = buckets.select("event_type", "b", F.sum("c").over(own.orderBy("b")).alias("run"), F.sum("c").over(own).alias("t"))
    at = lambda q: F.min(F.when(F.col("run") >= q * F.col("t"), F.col("b")))
    return rows.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.first("t").alias("n"))


@query(
    "version_summary",
    """SELECT user_id % 2 = 1 AS new_version, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users, round(avg(value), 6) AS mean, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1""",
)
def version_summary(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 2 == 1).alias("new_version"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


@query(
    "unrecovered_errors",
    """SELECT user_id, count(*)::BIGINT AS n_errors, count(*) FILTER (WHERE nxt IS NULL OR nxt > ts + INTERVAL 1 DAY)::BIGINT AS n_left FROM (SELECT user_id, ts, event_type, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER
    (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events) WHERE event_type = 'error' GROUP BY user_id""",
)
def unrecovered_errors(spark, d):
    """Errors that no purchase of the same user follows within a day."""
    after = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    rows = table(spark, d, "events").select("user_id", "ts", "event_type", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(after).alias("nxt"))
    left = F.col("nxt").isNull() | (F.col("nxt") > F.col("ts") + F.expr("INTERVAL '1' DAY"))
    return rows.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n_errors"), F.count_if(left).alias("n_left"))


METRICS = {
    "error_rate": ("count(*) FILTER (WHERE event_type = 'error')", "count(*)"),
    "purchase_rate": ("count(*) FILTER (WHERE event_type = 'purchase')", "count(*) FILTER (WHERE event_type <> 'error')"),
    "value_per_user": ("sum(value)", "count(DISTINCT user_id)"),
    "slow_share": ("count(*) FILTER (WHERE value > 60)", "count(value)"),
}


@query("metric_catalogue", " UNION ALL ".join(f"SELECT '{k}' AS metric, round(({n})::DOUBLE / ({m}), 6) AS value, ({m})::BIGINT AS base FROM events" for k, (n, m) in METRICS.items()))
def metric_catalogue(spark, d):
    """All named metrics, each with its own base, in one pass over the events."""
    kind, value = F.col("event_type"), F.col("value")
    parts = {
        "error_rate": (F.count_if(kind == "error"), F.count("*")), "purchase_rate": (F.count_if(kind == "purchase"), F.count_if(kind != "error")),
        "value_per_user": (F.sum(value), F.count_distinct("user_id")), "slow_share": (F.count_if(value > 60), F.count(value)),
    }
    one = table(spark, d, "events").agg(*[x.alias(f"{k}_{i}") for k, pair in parts.items() for i, x in enumerate(pair)])
    rows = [F.struct(F.lit(k).alias("metric"), F.round(F.col(f"{k}_0") / F.col(f"{k}_1"), 6).alias("value"), F.col(f"{k}_1").alias("base")) for k in parts]
    return one.select(F.inline(F.array(*rows)))


@query(
    "hourly_load",
    """SELECT date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE event_type <> 'error' AND value <= 60) / 3600.0, 6)::DOUBLE AS goodput, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY 1""",
)
def hourly_load(spark, d):
    good = F.count_if((F.col("event_type") != "error") & (F.col("value") <= 60))
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(good / 3600.0, 6).alias("goodput"), F.count_distinct("user_id").alias("n_users"))


@query(
    "first_seen_order",
    "SELECT user_id, string_agg(event_type, '>' ORDER BY t, e) AS path FROM (SELECT user_id, event_type, min(ts) AS t, min(event_id) AS e FROM events GROUP BY 1, 2) GROUP BY user_id",
)
def first_seen_order(spark, d):
    """A user's event types in the order of their first occurrence, repeats dropped."""
    kinds = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"), F.min("event_id").alias("e"))
    path = F.array_sort(F.collect_list(F.struct("t", "e", "event_type")))  # as many as there are types
    return kinds.groupBy("user_id").agg(F.array_join(F.transform(path, lambda x: x["event_type"]), ">").alias("path"))


@query(
    "first_failing_stage",
    """SELECT user_id, coalesce(min(CASE WHEN m > 52 THEN CASE event_type WHEN 'view' THEN '1 view' WHEN 'click' THEN '2 click' WHEN 'purchase' THEN '3 purchase' ELSE '4 ' || event_type END END), 'none') AS stage FROM
    (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY user_id""",
)
def first_failing_stage(spark, d):
    """The first stage, in a fixed order, whose mean is over the tolerance."""
    means = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    kind = F.col("event_type")
    stage = F.when(kind == "view", "1 view").when(kind == "click", "2 click").when(kind == "purchase", "3 purchase").otherwise(F.concat(F.lit("4 "), kind))
    return means.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("m") > 52, stage)), F.lit("none")).alias("stage"))


@query(
    "latest_versions",
    """SELECT o_custkey, max_by(v, o) AS version FROM (SELECT o_custkey, (o_orderkey % 3) || '.' || (o_orderkey % 12) || '.' || (o_orderkey % 101) AS v, (o_orderkey % 3) * 1000000 + (o_orderkey % 12) * 1000 + o_orderkey % 101 AS o FROM orders) GROUP BY o_custkey""",
)
def latest_versions(spark, d):
    """The latest version by its numbers: 1.10.0 is later than 1.9.5."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_custkey", F.concat_ws(".", *[(key % k).cast("string") for k in (3, 12, 101)]).alias("v"))
    return orders.groupBy("o_custkey").agg(F.max_by("v", F.transform(F.split("v", "[.]"), lambda x: x.cast("long"))).alias("version"))


@query(
    "merged_provenance",
    """SELECT key, n_rows::BIGINT AS n_rows, string_agg(source, ',' ORDER BY first_id) AS sources FROM (SELECT md5(text) AS key, source, min(doc_id) AS first_id, sum(count(*)) OVER (PARTITION BY md5(text)) AS n_rows FROM documents GROUP BY 1, 2) GROUP BY 1, 2""",
)
def merged_provenance(spark, d):
    """The sources of equal texts, each once, in the order in which they came."""
    first = table(spark, d, "documents").groupBy(F.md5("text").alias("key"), "source").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("c"))
    rows = first.groupBy("key").agg(F.sum("c").alias("n_rows"), F.sort_array(F.collect_list(F.struct("first_id", "source"))).alias("s"))
    return rows.select("key", "n_rows", F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"))


@query(
    "review_queue",
    """SELECT lang, count(*)::BIGINT AS n_pending, min(doc_id) AS next_id, round(min(abs(score - 0.5)), 6) AS least_sure FROM """ + SCORED + """ WHERE abs(score - 0.5) < 0.15 GROUP BY lang""",
)
def review_queue(spark, d):
    rows = _scored(spark, d).withColumn("gap", F.abs(F.col("score") - 0.5)).where("gap < 0.15").groupBy("lang")
    return rows.agg(F.count("*").alias("n_pending"), F.min("doc_id").alias("next_id"), F.round(F.min("gap"), 6).alias("least_sure"))


@query(
    "prefix_repeats",
    "SELECT source, count(*)::BIGINT AS n, sum(CASE WHEN doc_id > f THEN 1 ELSE 0 END)::BIGINT AS n_seen FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY md5(substr(text, 1, 64))) AS f FROM documents) GROUP BY source",
)
def prefix_repeats(spark, d):
    """How many texts of a source begin as one with a smaller id does; a digest's smallest id is found by an aggregate."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.md5(F.substring("text", 1, 64)).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("f"))
    return rows.join(first, "h").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") > F.col("f")).alias("n_seen"))


@query(
    "renamed_attributes",
    """SELECT event_type, count(*) FILTER (WHERE k < 50)::BIGINT AS n_low, sum(k)::BIGINT AS level, round(sum(CASE WHEN event_type = 'view' THEN 0 ELSE coalesce(value, 0) END), 4)::DOUBLE AS cost, round(sum(CASE WHEN event_type = 'view' THEN coalesce(value, 0) ELSE 0 END), 4)::DOUBLE AS avoided
    FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
)
def renamed_attributes(spark, d):
    """An old key of the properties under its new name; the cost of what a cache answered counts as avoided."""
    level, value = F.get_json_object("props", "$.k").cast("long"), F.coalesce("value", F.lit(0.0))
    rows = table(spark, d, "events").select("event_type", level.alias("k"), F.when(F.col("event_type") == "view", 0.0).otherwise(value).alias("c"), F.when(F.col("event_type") == "view", value).otherwise(0.0).alias("a"))
    return rows.groupBy("event_type").agg(F.count_if(F.col("k") < 50).alias("n_low"), F.sum("k").alias("level"), F.round(F.sum("c"), 4).alias("cost"), F.round(F.sum("a"), 4).alias("avoided"))


@query(
    "abstain_decisions",
    f"""SELECT decision, count(*)::BIGINT AS n, coalesce(sum(quality), 0)::BIGINT AS n_good FROM (SELECT quality, CASE WHEN n_chars < 100 THEN 'abstain_short' WHEN toxic = 1 THEN 'escalate' WHEN score < 0.2 THEN 'abstain_score' WHEN source = 'src0' AND score < 0.5 THEN 'notice' ELSE 'answer' END AS decision FROM {SCORED}) GROUP BY 1""",
)
def abstain_decisions(spark, d):
    """Rules in a fixed order: the first that holds decides."""
    score = F.col("score")
    decision = F.when(F.col("n_chars") < 100, "abstain_short").when(F.col("toxic") == 1, "escalate").when(score < 0.2, "abstain_score").when((F.col("source") == "src0") & (score < 0.5), "notice").otherwise("answer")
    return _scored(spark, d).groupBy(decision.alias("decision")).agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_good"))


@query(
    "lenient_labels",
    """SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, count(*)::BIGINT AS n FROM labels WHERE doc_id % 4 <> 3 GROUP BY 1 UNION ALL SELECT 'unknown', count(*)::BIGINT FROM labels WHERE doc_id % 4 = 3""",
)
def lenient_labels(spark, d):
    """Labels as a model may write them - in prose, in other cases, in a JSON object - made one of the known ones."""
    key, word = F.col("doc_id") % 4, F.when(F.col("quality") == 1, "good").otherwise("bad")
    said = F.when(key == 0, F.concat(F.lit("Label:  "), F.upper(word), F.lit("!"))).when(key == 1, F.concat(F.lit('Sure. {"label": "'), F.initcap(word), F.lit('", "why": "x"} Done.'))).when(key == 2, F.concat(word, F.lit(".\n"))).otherwise("no idea")
    rows = table(spark, d, "labels").select(said.alias("said"))
    inner = F.coalesce(F.get_json_object(F.regexp_extract("said", r"(?s)(\{.*\})", 1), "$.label"), F.regexp_replace("said", "(?i)^label:", ""))
    plain = F.lower(F.regexp_replace(inner, "[^A-Za-z]+", ""))
    return rows.groupBy(F.when(plain.isin("good", "bad"), plain).otherwise("unknown").alias("label")).agg(F.count("*").alias("n"))


@query(
    "context_duplicates",
    r"""SELECT doc_id, kept FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY key ORDER BY (source = 'src0') DESC, n_chars DESC, doc_id) AS kept FROM (SELECT *, md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) AS key FROM documents)) WHERE doc_id <> kept""",
)
def context_duplicates(spark, d):
    """Of equal normalised texts the pinned one stays, then the longest, then the first: an aggregate, no window."""
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), "[ \t\n\r]+", " ")))
    rows = table(spark, d, "documents").select("doc_id", key.alias("key"), F.struct((F.col("source") != "src0").alias("p"), (-F.col("n_chars")).alias("c"), "doc_id").alias("o"))
    best = rows.groupBy("key").agg(F.min("o").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", F.col("b.doc_id").alias("kept"))
    return rows.join(best, "key").where("doc_id <> kept").select("doc_id", "kept")


@query(
    "parents_of_children",
    """SELECT doc_id, min(rank)::BIGINT AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY length(t) DESC, doc_id, i) AS rank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)) WHERE rank <= 100 GROUP BY doc_id""",
)
def parents_of_children(spark, d):
    """The best 100 children, and of each parent its best rank: each partition keeps its first 100."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).select("doc_id", "i", F.length("t").alias("c"))
    best = lines.orderBy(F.desc("c"), "doc_id", "i").limit(100)
    ranked = best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("c"), "doc_id", "i")).alias("rank"))  # over 100 rows
    return ranked.groupBy("doc_id").agg(F.min("rank").cast("long").alias("rank"))


@query(
    "signal_export",
    """SELECT d.doc_id, d.source, l.quality, coalesce(n, 0)::BIGINT AS n_turns, l.doc_id IS NULL AS no_label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = d.doc_id""",
)
def signal_export(spark, d):
    """Each document with its label and how many turns of feedback it has: small sides are added up first."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("known"))
    rows = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").join(turns, "doc_id", "left")
    return rows.select("doc_id", "source", "quality", F.coalesce("n", F.lit(0)).cast("long").alias("n_turns"), F.col("known").isNull().alias("no_label"))


@query(
    "prefix_dependents",
    """SELECT prefix, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS prefix FROM (SELECT string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/') AS p FROM pages)) GROUP BY prefix""",
)
def prefix_dependents(spark, d):
    """How many pages stand below each prefix of a path: a path goes to all its prefixes, and these are counted."""
    path = F.split(F.trim(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")), "/")
    rows = table(spark, d, "pages").select(path.alias("p"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))
    return rows.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
