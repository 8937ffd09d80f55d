"""Queries over events: time windows, funnels, spend, alerts, as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as tx
from ..operators import metrics, windows
from ..sources.tables import table
from .registry import query


def _events(spark, d):
    return table(spark, d, "events")


@query("tumbling_hours", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_hours(spark, d):
    rows = _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query(
    "sliding_hours",
    """SELECT start, count(*)::BIGINT AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY start""",
)
def sliding_hours(spark, d):
    rows = _events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "n")


@query(
    "user_sessions",
    """SELECT user_id, island::BIGINT AS island, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS s FROM events)) GROUP BY 1, 2""",
)
def user_sessions(spark, d):
    rows = windows.islands(_events(spark, d), ["user_id"], "ts", 6 * 3600)
    return rows.groupBy("user_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("funnel", """SELECT count(*)::BIGINT AS signed_up, count(*) FILTER (WHERE v)::BIGINT AS viewed, count(*) FILTER (WHERE v AND c)::BIGINT AS clicked, count(*) FILTER (WHERE v AND c AND p)::BIGINT AS purchased FROM
    (SELECT user_id, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM events GROUP BY user_id) WHERE s""")
def funnel(spark, d):
    has = {k: F.bool_or(F.col("event_type") == k).alias(k) for k in ("signup", "view", "click", "purchase")}
    users = _events(spark, d).groupBy("user_id").agg(*has.values()).where("signup")
    v, c, p = (F.col(x) for x in ("view", "click", "purchase"))
    return users.agg(F.count("*").alias("signed_up"), F.count_if(v).alias("viewed"), F.count_if(v & c).alias("clicked"), F.count_if(v & c & p).alias("purchased"))


@query("chargeback", """SELECT user_id, event_type, round(sum(value), 4) AS spend, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 6) AS share FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2""")
def chargeback(spark, d):
    rows = _events(spark, d).where(F.col("event_type").isin("purchase", "click")).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    own = F.sum("v").over(Window.partitionBy("user_id"))
    return rows.select("user_id", "event_type", F.round("v", 4).alias("spend"), F.round(F.col("v") / own, 6).alias("share"))


@query("cost_per_success", """SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS cost, round(CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN NULL ELSE sum(value) / count(*) FILTER (WHERE event_type = 'purchase') END, 4) AS per_success
    FROM events GROUP BY user_id""")
def cost_per_success(spark, d):
    good = F.count_if(F.col("event_type") == "purchase")
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.round(metrics.ratio(F.sum("value"), good), 4).alias("per_success"))


@query("latency_percentiles", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(quantile_cont(value, 0.95), 6) AS p95_between, count(*) FILTER (WHERE value > 90)::BIGINT AS n_over
    FROM events GROUP BY event_type""")
def latency_percentiles(spark, d):
    return _events(spark, d).groupBy("event_type").agg(
        *[metrics.nearest_rank("value", q / 100).alias(f"p{q}") for q in (50, 95, 99)], F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95_between"), F.count_if(F.col("value") > 90).alias("n_over")
    )


@query("burn_rate", """SELECT day, n, errors, round(errors::DOUBLE / n / 0.05, 6) AS burn, round(sum(errors) OVER w::DOUBLE / sum(n) OVER w / 0.05, 6) AS burn_3d FROM (SELECT date_trunc('day', ts)::DATE AS day, count(*)::BIGINT AS n,
    count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1) WINDOW w AS (ORDER BY day ROWS 2 PRECEDING)""".replace("sum(errors) OVER w::DOUBLE", "(sum(errors) OVER w)::DOUBLE"))
def burn_rate(spark, d):
    days = _events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    last = Window.orderBy("day").rowsBetween(-2, 0)  # over one row for each day
    return days.select("day", "n", "errors", F.round(F.col("errors") / F.col("n") / 0.05, 6).alias("burn"), F.round(F.sum("errors").over(last) / F.sum("n").over(last) / 0.05, 6).alias("burn_3d"))


@query("alert_windows", """SELECT event_type, day, n, base, n > 1.2 * base AS fires FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS base FROM (SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2))
    WHERE base >= 20""")
def alert_windows(spark, d):
    days = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = days.withColumn("base", F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))).where("base >= 20")
    return days.select("event_type", "day", "n", "base", (F.col("n") > 1.2 * F.col("base")).alias("fires"))


@query("spend_thresholds", """SELECT user_id, day, limit_at, min(ts) AS crossed FROM (SELECT user_id, ts, ts::DATE AS day, sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events),
    (SELECT unnest([50, 100, 200]) AS limit_at) WHERE used >= limit_at GROUP BY 1, 2, 3""")
def spend_thresholds(spark, d):
    """When a user's spend of a day first reached each threshold."""
    day = F.to_date("ts")
    own = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _events(spark, d).select("user_id", "ts", "event_id", "value", day.alias("day")).withColumn("used", F.sum("value").over(own))
    reached = F.filter(F.array(*map(F.lit, (50, 100, 200))), lambda x: x <= F.col("used"))
    return rows.select("user_id", "day", "ts", F.explode(reached).alias("limit_at")).groupBy("user_id", "day", "limit_at").agg(F.min("ts").alias("crossed"))


@query("as_of_views", """SELECT p.event_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_views(spark, d):
    events = _events(spark, d)
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    asked = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return windows.as_of(asked, views, ["user_id"], "ts", "value", "view_value").select("event_id", "view_value")


@query("recent_errors", """SELECT e.event_id, (SELECT count(*) FROM events p WHERE p.event_type = 'error' AND p.user_id = e.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL '48 hours')::BIGINT AS n FROM events e WHERE e.event_type = 'purchase'""")
def recent_errors(spark, d):
    """Errors of the same user in the two days before each purchase: a range frame, so no pairs are made."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, d).where(F.col("event_type").isin("error", "purchase")).withColumn("us", micros)
    before = Window.partitionBy("user_id").orderBy("us").rangeBetween(-48 * 3_600_000_000, -1)
    rows = rows.withColumn("n", F.sum((F.col("event_type") == "error").cast("long")).over(before))
    return rows.where("event_type = 'purchase'").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("feedback_join", """SELECT f.event_id, max(s.ts) AS signed FROM (SELECT * FROM events WHERE event_type = 'error') f LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON f.user_id = s.user_id AND f.ts >= s.ts AND f.ts < s.ts + INTERVAL '14 days' GROUP BY f.event_id""")
def feedback_join(spark, d):
    """The last signup of at most 14 days before each error; null marks an orphan or a late one."""
    events = _events(spark, d)
    signups = events.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("at"))
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    found = windows.as_of(asked, signups, ["user_id"], "ts", "at", "signed")
    return found.select("event_id", F.when(F.col("ts") < F.col("signed") + F.expr("INTERVAL '14' DAY"), F.col("signed")).alias("signed"))


@query("last_event_wins", "SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_event_wins(spark, d):
    rows = _events(spark, d).groupBy("user_id", "event_type")
    return rows.agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("lag_distances", "SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS step FROM events")
def lag_distances(spark, d):
    """Windows hold a type's events of one day; the first of a day gets the last value of the last day before it."""
    rows = _events(spark, d).select("event_id", "event_type", "ts", "value", F.to_date("ts").alias("day"))
    last = rows.groupBy("event_type", "day").agg(F.max_by(F.struct("value"), F.struct("ts", "event_id")).alias("own"))
    carried = last.select("event_type", "day", F.lag("own").over(Window.partitionBy("event_type").orderBy("day")).alias("before"))  # a row a day
    own = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    rows = rows.withColumns({"place": F.row_number().over(own), "previous": F.lag("value").over(own)}).join(carried, ["event_type", "day"])
    before = F.when(F.col("place") == 1, F.col("before.value")).otherwise(F.col("previous"))
    return rows.select("event_id", F.round(F.abs(F.col("value") - before), 6).alias("step"))


@query("trace_completeness", "SELECT event_type, round(avg(CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_k, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_value FROM events GROUP BY 1")
def trace_completeness(spark, d):
    missing = lambda c: F.round(F.avg(c.isNull().cast("double")), 6)
    return _events(spark, d).groupBy("event_type").agg(missing(F.get_json_object("props", "$.k")).alias("missing_k"), missing(F.col("value")).alias("missing_value"))


@query("trace_sampling", "SELECT event_id FROM events WHERE event_type = 'error' OR (('0x' || substr(sha256('trace:' || user_id), 1, 12))::UBIGINT / 281474976710656.0) < 0.1")
def trace_sampling(spark, d):
    return _events(spark, d).where((F.col("event_type") == "error") | (tx.bucket(F.col("user_id"), "trace") < 0.1)).select("event_id")


@query("orphan_lines", "SELECT u.event_id FROM events u WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = u.user_id)")
def orphan_lines(spark, d):
    return _events(spark, d).join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left_anti").select("event_id")


@query("state_predicate", "SELECT user_id, bool_or(event_type = 'purchase' AND value > 50) AS holds FROM events GROUP BY user_id")
def state_predicate(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("holds"))


@query("distinct_users", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS n_users, count(DISTINCT ts::DATE)::BIGINT AS n_days FROM events GROUP BY 1")
def distinct_users(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.to_date("ts")).alias("n_days"))
