"""Queries of assertions over the order of events and turns, and of differences whose rows come in clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.resampling import ONE_BY_ONE, cluster_test, poisson_bounds
from ..operators.trajectories import AtLeast, AtMost, Before, Followed, NoCycle, Only, checked
from ..sources.tables import table
from .registry import query

DAY = 86_400_000_000
EVENT_RULES = {
    "bought": AtLeast("purchase"),
    "errors_at_most_twelve": AtMost("error", 12),
    "known_events": Only(("signup", "view", "click", "purchase", "error")),
    "signup_before_purchase": Before("signup", "purchase"),
    "error_then_view_in_a_week": Followed("error", "view", 7 * DAY),
    "no_pair_twice": NoCycle(2, 2),
    "no_triple_twice": NoCycle(3, 2),
}
TURN_RULES = {
    "one_system_turn_at_most": AtMost("system", 1),
    "user_before_assistant": Before("user", "assistant"),
    "user_answered_at_once": Followed("user", "assistant", 1),
    "no_role_twice": NoCycle(1, 2),
    "known_roles": Only(("system", "user", "assistant")),
    "has_answer": AtLeast("assistant"),
}


def _sql(rows: str, key: str, rules: dict) -> str:
    """SQL over rows (k, t, i, e): the first failure by each rule; lag and lead look at rows around."""
    order = "OVER (PARTITION BY k ORDER BY t, i, e"
    parts = []
    for name, r in rules.items():
        if isinstance(r, AtLeast):
            parts.append(f"SELECT k, '{name}' AS a, count(*) FILTER (WHERE e = '{r.event}') < {r.n} AS bad, NULL::BIGINT AS t FROM r GROUP BY k")
            continue
        if isinstance(r, AtMost):
            fails, need = f"e = '{r.event}' AND n > {r.n}", f"count(*) FILTER (WHERE e = '{r.event}') {order}) AS n"
        elif isinstance(r, Only):
            fails, need = f"e NOT IN ({', '.join(repr(e) for e in r.events)})", "0 AS n"
        elif isinstance(r, Before):
            fails, need = f"e = '{r.event}' AND n = 0", f"count(*) FILTER (WHERE e = '{r.first}') {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n"
        elif isinstance(r, Followed):
            fails, need = f"e = '{r.event}' AND (n IS NULL OR n - t > {r.within})", f"min(t) FILTER (WHERE e = '{r.by}') {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n"
        else:
            size = r.length * r.times
            fails = f"len(n) = {size} AND " + " AND ".join(f"n[{j}] = n[{j - r.length}]" for j in range(r.length + 1, size + 1)) + f" AND len(list_distinct(n[1:{r.length}])) = {r.length}"
            need = f"list(e) {order} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS n"
        parts.append(f"SELECT k, '{name}' AS a, count(*) FILTER (WHERE {fails}) > 0 AS bad, min(t) FILTER (WHERE {fails}) AS t FROM (SELECT *, {need} FROM r) GROUP BY k")
    return f"WITH r AS MATERIALIZED (SELECT * FROM ({rows}) WHERE k IS NOT NULL AND t IS NOT NULL AND e IS NOT NULL) SELECT k AS {key}, a AS assertion, NOT bad AS passed, t AS failed_at FROM ({' UNION ALL '.join(parts)})"


@query("event_trajectories", _sql("SELECT user_id AS k, epoch_us(ts) AS t, event_id AS i, event_type AS e FROM events", "user_id", EVENT_RULES))
def event_trajectories(spark, d):
    """Seven assertions about each user's events, all in one pass; failed_at in microseconds since 1970."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return checked(table(spark, d, "events").withColumn("at", micros), "user_id", "at", "event_id", "event_type", EVENT_RULES)


@query("turn_trajectories", _sql("SELECT conv_id AS k, turn AS t, 0 AS i, role AS e FROM conversations", "conv_id", TURN_RULES))
def turn_trajectories(spark, d):
    """Six assertions about the roles of each conversation's turns; failed_at is a turn."""
    rows = table(spark, d, "conversations").withColumn("tie", F.lit(0))
    return checked(rows, "conv_id", "turn", "tie", "role", TURN_RULES)


def _cluster_sql(rows: str, unit: str, times: int) -> str:
    """SQL of cluster_test over rows (c, v), with the same draws."""
    u = {p: f"(('0x' || substr(sha256('{p}:' || r || ':' || s || ':' || m || ':' || j), 1, 12))::UBIGINT / 281474976710656.0)" for p in ("weight", "sign", "radius", "angle", "radius2", "angle2")}
    z = lambda a, b: f"sqrt(-2 * ln(1 - {u[a]})) * cos(2 * pi() * {u[b]})"
    alone = f"len(list_filter({poisson_bounds()}, lambda b: {u['weight']} >= b))"
    return f"""SELECT '{unit}' AS unit, n_rows::BIGINT AS n_rows, n_clusters::BIGINT AS n_clusters, round(total / n_rows, 6) AS delta, low, high, round((far + 1) / {times + 1}, 6) AS p_value FROM
    (SELECT any_value(n_rows) AS n_rows, any_value(n_clusters) AS n_clusters, any_value(total) AS total, quantile_disc(round(ws / nullif(wm, 0), 6), 0.025) AS low,
    quantile_disc(round(ws / nullif(wm, 0), 6), 0.975) AS high, count(*) FILTER (WHERE abs(fs) >= abs(total) - 1e-9) AS far FROM
    (SELECT r, sum(w * (s / 1e9)) AS ws, sum(w * m) AS wm, sum(f * (s / 1e9)) AS fs FROM (SELECT *, CASE WHEN n <= {ONE_BY_ONE} THEN {alone} ELSE greatest(round(n + sqrt(n) * {z('radius', 'angle')}), 0.0) END AS w,
    CASE WHEN n > {ONE_BY_ONE} THEN 2 * least(greatest(round(n / 2.0 + sqrt(n) / 2 * {z('radius2', 'angle2')}), 0.0), n) - n WHEN {u['sign']} < 0.5 THEN 1.0 ELSE -1.0 END AS f FROM
    (SELECT *, unnest(generate_series(1, CASE WHEN n <= {ONE_BY_ONE} THEN n ELSE 1 END)) AS j FROM (SELECT s, m, count(*) AS n FROM (SELECT round(sum(v) * 1e9)::BIGINT AS s, count(*) AS m FROM ({rows}) GROUP BY c) GROUP BY s, m),
    (SELECT unnest(generate_series(0, {times - 1})) AS r))) GROUP BY r), (SELECT count(*) AS n_rows, count(DISTINCT c) AS n_clusters, sum(v)::DOUBLE AS total FROM ({rows})))"""


_DELTAS = "(CASE WHEN length(text) >= 400 THEN 1 ELSE 0 END - CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END) AS v FROM conversations WHERE role = 'assistant' AND text IS NOT NULL AND conv_id IS NOT NULL"


@query(
    "cluster_significance",
    _cluster_sql(f"SELECT conv_id || '/' || turn AS c, {_DELTAS}", "turn", 2_000) + " UNION ALL " + _cluster_sql(f"SELECT conv_id AS c, {_DELTAS}", "conversation", 2_000),
)
def cluster_significance(spark, d):
    """Two ways to score assistant turns, compared by turns and by whole conversations: what turns prove, conversations may not."""
    long, lines = F.length("text") >= 400, F.contains("text", F.lit("\n"))
    turns = table(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL AND conv_id IS NOT NULL")
    turns = turns.select("conv_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn"), (long.cast("int") - lines.cast("int")).alias("v"))
    of = lambda c, unit: cluster_test(turns, c, "v").select(F.lit(unit).alias("unit"), "*")
    return of("turn", "turn").unionByName(of("conv_id", "conversation"))
