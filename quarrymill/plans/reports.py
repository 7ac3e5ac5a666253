"""Queries over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions.hashing import split_name, split_unit
from quarrymill.operators import stats, views
from quarrymill.plans.registering import registers
from quarrymill.session import table
from quarrymill.streaming.funnel import windowed_counts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

query = registers(QUERIES, ORACLE_SQL)


@query("""SELECT o_orderkey, (l.l_orderkey IS NOT NULL)::INT + (c.c_custkey IS NOT NULL)::INT AS tiers, l.lines AS lines, c.c_mktsegment AS segment
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) l ON l_orderkey = o_orderkey
    LEFT JOIN customer c ON c_custkey = o_custkey AND c_acctbal > 0""")
def funnel_tier_joins(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    owners = orders.join(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_orderkey", "c_mktsegment")
    out = views.tier_join(orders, {"tier0": lines, "tier1": owners}, "o_orderkey")
    return out.select("o_orderkey", "tiers", F.col("tier0.lines").alias("lines"), F.col("tier1.c_mktsegment").alias("segment"))


@query("""WITH m AS (SELECT o_custkey, o_orderpriority AS d, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1, 2)
    SELECT c_custkey, coalesce(string_agg(d || '=' || s, ',' ORDER BY d), '') AS member_of FROM customer LEFT JOIN m ON o_custkey = c_custkey GROUP BY 1""")
def dataset_membership(spark, sf):
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    out = views.memberships(table(spark, sf, "customer"), members, "c_custkey", "o_orderpriority", "o_orderstatus")
    entries = F.transform(F.array_sort(F.map_entries("datasets")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    return out.select("c_custkey", F.coalesce(F.array_join(entries, ","), F.lit("")).alias("member_of"))


@query("""SELECT 'quantity' AS measure, 'all' AS key, round_even(sum(l_quantity), 2) AS value FROM lineitem UNION ALL SELECT 'tax', 'all', round_even(sum(l_tax), 2) FROM lineitem
    UNION ALL SELECT 'count_by_l_returnflag', l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY 2 UNION ALL SELECT 'count_by_l_linestatus', l_linestatus, count(*)::DOUBLE FROM lineitem GROUP BY 2""")
def overview_totals(spark, sf):
    return views.totals(table(spark, sf, "lineitem"), {"quantity": F.col("l_quantity"), "tax": F.col("l_tax")}, ["l_returnflag", "l_linestatus"])


@query("""WITH m AS (SELECT l_linenumber AS rung, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1), s AS (SELECT rung, v - lag(v) OVER (ORDER BY rung) AS step FROM m)
    SELECT rung, round_even(step, 4) AS step, step > lag(step) OVER (ORDER BY rung) AS accelerating FROM s QUALIFY step IS NOT NULL""")
def per_halving_steps(spark, sf):
    means = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("rung")).agg(F.avg("l_extendedprice").alias("v"))
    return views.ladder_steps(means, "rung", "v").withColumn("step", F.bround("step", 4))


@query("""SELECT l_returnflag, count(l_discount * 100) AS n, max(l_discount * 100) AS largest, round_even(avg((l_discount * 100 > 2)::INT::DOUBLE), 6) AS above_2,
    round_even(avg((l_discount * 100 > 5)::INT::DOUBLE), 6) AS above_5, round_even(avg((l_discount * 100 > 9)::INT::DOUBLE), 6) AS above_9 FROM lineitem GROUP BY 1""")
def threshold_exceedance(spark, sf):
    return views.exceedance(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_discount") * 100, [2, 5, 9])


@query("""WITH p AS (SELECT user_id, max(value - 50) FILTER (event_type = 'click') AS a, max(value - 50) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
    SELECT count(*) AS n, round_even(avg(abs(a - b)), 6) AS mean_gap, round_even(avg(CASE WHEN a <> 0 AND b <> 0 THEN (sign(a) = sign(b))::INT::DOUBLE END), 6) AS sign_agreement
    FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def teacher_disagreement(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", (F.col("value") - 50).alias("v"))
    return views.disagreement(rows, "user_id", "event_type", "v", "click", "view")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS tier FROM orders""")
def backlog_tiering(spark, sf):
    return views.tiered_backlog(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": 0, "P": 1}, 2).select("o_orderkey", "tier")


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, arg_max(l_linestatus, abs(d / nullif(q, 0))) AS l_linestatus, round_even(max(abs(d / nullif(q, 0))), 6) AS relative FROM m GROUP BY 1""")
def relative_effect(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return views.largest_effect(means, ["l_returnflag"], "l_linestatus", F.col("d"), F.col("q"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS a, CASE WHEN w < 0.8 THEN 'train' WHEN w < 0.9 THEN 'val' ELSE 'test' END AS b FROM
    (SELECT *, ('0x' || substr(sha256('1:' || o_custkey), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(sha256('2:' || o_custkey), 1, 8))::BIGINT / 4294967296.0 AS w FROM orders))
    SELECT a AS old_split, b AS new_split, count(*) AS n FROM s WHERE a <> b GROUP BY 1, 2""")
def migration_split_changes(spark, sf):
    rows = table(spark, sf, "orders").select(*(split_name(split_unit(seed, F.col("o_custkey"))).alias(name) for seed, name in ((1, "old_split"), (2, "new_split"))))
    return rows.where("old_split <> new_split").groupBy("old_split", "new_split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_event_counts(spark, sf):
    events = table(spark, sf, "events").select("event_type", "ts")
    return windowed_counts(events, "ts", "event_type").select("event_type", F.col("window.start").alias("hour"), "n")


@query("""WITH s AS (SELECT flag, l_quantity, row_number() OVER (PARTITION BY flag ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY flag) AS n
    FROM (SELECT l_returnflag AS flag, l_quantity FROM lineitem)) SELECT flag AS l_returnflag, max(l_quantity) FILTER (rn = floor(n * 0.99)::BIGINT + 1) AS p99 FROM s GROUP BY 1""")
def index_quantile(spark, sf):
    return stats.order_statistic(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", F.floor(F.col("n") * F.lit(0.99)), "p99")
