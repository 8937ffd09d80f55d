"""Queries over the star of orders: joins, rankings, sets, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import windows
from ..sources.tables import table
from .registry import query


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    "revenue_by_nation",
    """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def revenue_by_nation(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per_customer = rows.groupBy("o_custkey").agg(F.sum("v").alias("v"))  # before the join, so one row for each customer is joined
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = per_customer.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return named.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 100000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "two_key_fallback",
    """SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS name, a.c_custkey IS NOT NULL AS by_first FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_nationkey < 12
    LEFT JOIN customer b ON o_orderkey = b.c_custkey""",
)
def two_key_fallback(spark, d):
    names = table(spark, d, "customer")
    first = names.where("c_nationkey < 12").select(F.col("c_custkey").alias("a"), F.col("c_name").alias("a_name"))
    second = names.select(F.col("c_custkey").alias("b"), F.col("c_name").alias("b_name"))
    rows = table(spark, d, "orders").join(first, F.col("o_custkey") == F.col("a"), "left").join(second, F.col("o_orderkey") == F.col("b"), "left")
    return rows.select("o_orderkey", F.coalesce("a_name", "b_name").alias("name"), F.col("a").isNotNull().alias("by_first"))


@query(
    "first_line_of_order",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def first_line_of_order(spark, d):
    best = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "l_partkey"), F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("x"))
    return best.select("l_orderkey", "x.l_linenumber", "x.l_partkey")


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders_per_customer(spark, d):
    return windows.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "pareto_front",
    """SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))""",
)
def pareto_front(spark, d):
    """Parts that no other is at least as cheap and as large as, and better in one: by the least price of each size."""
    parts = table(spark, d, "part")
    sizes = parts.groupBy("p_size").agg(F.min("p_retailprice").alias("low"))  # one row for each size
    larger = Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("rest", F.min("low").over(larger))
    rows = parts.join(sizes, "p_size").where("p_retailprice = low AND (rest IS NULL OR p_retailprice < rest)")
    return rows.select("p_partkey")


@query(
    "grouping_cube",
    """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def grouping_cube(spark, d):
    rows = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query(
    "grouping_rollup",
    """SELECT coalesce(o_orderpriority, '*') AS priority, coalesce(o_orderstatus, '*') AS status, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
)
def grouping_rollup(spark, d):
    rows = table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), F.coalesce("o_orderstatus", F.lit("*")).alias("status"), "n")


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def pivot_status(spark, d):
    is_ = lambda x: F.count_if(F.col("o_orderstatus") == x)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(is_("F").alias("f"), is_("O").alias("o"), is_("P").alias("p"))


@query("union_all_ids", "SELECT kind, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS n_ids FROM (SELECT 'c' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'o', o_custkey FROM orders) GROUP BY kind")
def union_all_ids(spark, d):
    both = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id")).union(table(spark, d, "orders").select(F.lit("o"), "o_custkey"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query("intersect_ids", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_ids(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")).intersect(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("except_ids", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).subtract(table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("chunk_diff", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F') a
    FULL OUTER JOIN (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 50000) b ON a.id = b.id""")
def chunk_diff(spark, d):
    orders = table(spark, d, "orders")
    old = orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("old"))
    new = orders.where("o_totalprice > 50000").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("unchanged")
    return old.join(new, "id", "full").select("id", change.alias("change"))


@query(
    "within_budget",
    """SELECT l_orderkey, l_linenumber, round(used, 2) AS used FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) WHERE used <= 60""",
)
def within_budget(spark, d):
    kept = windows.within_budget(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], "l_quantity", 60)
    return kept.select("l_orderkey", "l_linenumber", F.round("used", 2).alias("used"))


@query("upserted_orders", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey""")
def upserted_orders(spark, d):
    return windows.last_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("price_percentiles", "SELECT p_brand, quantile_disc(p_retailprice, 0.95) AS p95, round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM part GROUP BY p_brand")
def price_percentiles(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY p_retailprice)").alias("p95"), F.round(F.expr("percentile(p_retailprice, 0.5)"), 4).alias("median")
    )


@query("rank_positions", """SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS position, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS share FROM supplier""")
def rank_positions(spark, d):
    nation = Window.partitionBy("s_nationkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.row_number().over(nation.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("position"), F.round(F.percent_rank().over(nation.orderBy("s_acctbal")), 6).alias("share")
    )
