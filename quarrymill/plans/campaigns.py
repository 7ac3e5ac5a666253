"""Queries over study rules and over what the labelling funnel computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import sql
from quarrymill.functions.scalars import date_in, dig
from quarrymill.operators import campaigns, catalog, funnel, labels, records, stats, triage
from quarrymill.plans.registering import registers
from quarrymill.plans.studies import D_SQL, RUNS_SQL, _contrast, _runs
from quarrymill.plans.writing import HASH
from quarrymill.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

query = registers(QUERIES, ORACLE_SQL)

#: Lines as runs: a cell is a flag and a line number, some runs are invalid, and some are retries.
CELLS_SQL = """runs AS (SELECT l_returnflag AS arm, l_linenumber AS seed, CASE WHEN l_quantity < 3 THEN 'INVALID' WHEN l_quantity > 49 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
    l_linestatus = 'F' AS retry FROM lineitem)"""


def _cells(spark, sf):
    q = F.col("l_quantity")
    status = F.when(q < 3, "INVALID").when(q > 49, "RUNNING").otherwise("COMPLETED")
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed"), status.alias("status"), (F.col("l_linestatus") == "F").alias("retry"))


@query(f"""WITH {CELLS_SQL}, p AS (SELECT arm, seed, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'INVALID') AS invalid,
    count(*) FILTER (status = 'COMPLETED' AND retry) AS again FROM runs GROUP BY 1, 2), e AS (SELECT unnest(['A', 'R', 'X']) AS arm, unnest([1, 2, 3]) AS seed)
    SELECT coalesce(e.arm, p.arm) AS arm, coalesce(e.seed, p.seed) AS seed, coalesce(completed, 0) AS completed, coalesce(invalid, 0) AS invalid,
    CASE WHEN coalesce(completed, 0) > 0 THEN least(invalid, again) ELSE 0 END AS replaced,
    CASE WHEN e.arm IS NULL THEN 'extra' WHEN coalesce(completed, 0) = 0 THEN 'missing' WHEN completed > 1 THEN 'duplicate' ELSE 'complete' END AS state
    FROM e FULL JOIN p ON e.arm = p.arm AND e.seed = p.seed""")
def membership_report(spark, sf):
    lattice = spark.createDataFrame([("A", 1), ("R", 2), ("X", 3)], "arm string, seed int")
    return campaigns.full_membership(lattice, _cells(spark, sf), ["arm", "seed"], "status", "retry")


@query(f"""WITH {CELLS_SQL} SELECT arm, seed, count(*) FILTER (status = 'RUNNING') AS orphans, bool_and(status IN ('RUNNING', 'INVALID')) AND count(*) = 1 AS retry FROM runs GROUP BY 1, 2""")
def orphan_recovery(spark, sf):
    return campaigns.recovered(_cells(spark, sf), ["arm", "seed"], "status")


@query(D_SQL + """ SELECT subset, width, count(*) AS n, round_even(avg(d), 3) AS mean FROM (SELECT 'all' AS subset, width, d FROM d WHERE d IS NOT NULL
    UNION ALL SELECT 'fresh', width, d FROM d WHERE d IS NOT NULL AND seed >= 10) GROUP BY 1, 2""")
def confirmatory_subsets(spark, sf):
    out = campaigns.subset_contrasts(_runs(spark, sf), "width", "seed", "arm", "1-URGENT", "2-HIGH", "loss", {"all": F.lit(True), "fresh": F.col("seed") >= 10})
    return out.select("subset", "width", "n", F.bround("mean", 3).alias("mean"))


@query("""WITH m AS (SELECT l_shipmode_ AS regime, w, avg(v) AS m FROM (SELECT l_returnflag AS l_shipmode_, l_linenumber AS w, l_extendedprice AS v FROM lineitem) GROUP BY 1, 2)
    SELECT w AS width, round_even(max(m) FILTER (regime = 'A') - max(m) FILTER (regime = 'R'), 3) AS difference FROM m GROUP BY 1 HAVING difference IS NOT NULL""")
def between_regime(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("regime"), F.col("l_linenumber").alias("width")).agg(F.avg("l_extendedprice").alias("m"))
    return campaigns.between_regimes(m, "regime", "A", "R", "width", "m").withColumn("difference", F.bround("difference", 3))


@query("""SELECT l_linenumber AS seed, round_even((avg(l_extendedprice) FILTER (f AND s) - avg(l_extendedprice) FILTER (f AND NOT s)) - (avg(l_extendedprice) FILTER (NOT f AND s) - avg(l_extendedprice) FILTER (NOT f AND NOT s)), 3) AS d
    FROM (SELECT *, l_returnflag = 'A' AS f, l_linestatus = 'F' AS s FROM (SELECT l_linenumber, l_extendedprice, l_returnflag, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS l_linestatus FROM lineitem)) GROUP BY 1""")
def exam_teacher_interaction(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("seed"), "l_extendedprice", (F.col("l_returnflag") == "A").alias("exam"), (F.col("l_quantity") > 25).alias("teacher"))
    return stats.difference_in_differences(rows, "seed", "exam", "teacher", "l_extendedprice").withColumn("d", F.bround("d", 3))


VERDICTS_SQL = """v AS (SELECT l_returnflag AS exam, l_linenumber AS width, CASE WHEN avg(l_quantity) > 25.5 THEN 'worse' ELSE 'better' END AS verdict FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {VERDICTS_SQL}, p AS (SELECT width, coalesce(bool_or(verdict = 'worse') FILTER (exam = 'A'), false) AND coalesce(bool_or(verdict = 'better') FILTER (exam = 'R'), false) AS hit FROM v GROUP BY 1)
    SELECT count(*) AS widths, count(*) FILTER (hit) AS agreeing, bool_and(hit) AS pattern FROM p""")
def multi_exam_pattern(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("exam"), F.col("l_linenumber").alias("width")).agg(F.when(F.avg("l_quantity") > 25.5, "worse").otherwise("better").alias("verdict"))
    return stats.pattern(v, "exam", "width", {"A": "worse", "R": "better"})


@query(D_SQL + """ SELECT count(*) AS n, count(*) FILTER (high < 0) AS below, count(*) FILTER (low > 0) AS above,
    CASE WHEN bool_and(high < 0) THEN 'COMPLEMENTS' WHEN bool_and(low > 0) THEN 'SUBSTITUTES' WHEN count(*) FILTER (high < 0) > 0 AND count(*) FILTER (low > 0) > 0 THEN 'HETEROGENEOUS' ELSE 'UNRESOLVED' END AS label FROM c""")
def interaction_pattern(spark, sf):
    return stats.interaction_label(stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d")))


@query(D_SQL + """ SELECT list_sort(list(width) FILTER (high < 60000)) AS inside, coalesce(list_sort(list(width) FILTER (NOT high < 60000)), []) AS outside FROM c""")
def margin_lists(spark, sf):
    lists = stats.within_margin(stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d")), 60000.0, "width")
    return lists


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 100 = 7 THEN 1e-6 ELSE 0 END AS w FROM orders)
    SELECT count(*) FILTER (v IS NOT NULL AND w IS NOT NULL) AS common, count(*) FILTER (v IS NULL OR w IS NULL) AS alone, count(*) FILTER (abs(v - w) > 1e-12) AS differ, false AS reproduced
    FROM a FULL JOIN b USING (o_orderkey)""")
def cross_reproduction(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    again = orders.withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 100 == 7, 1e-6).otherwise(0))
    return campaigns.reproduced(orders.where("o_orderkey % 10 <> 3"), again, ["o_orderkey"], "v")


@query("""SELECT count(*) AS sample, round_even(avg(l_quantity), 6) AS mean, ceil(50000 / avg(l_quantity))::BIGINT AS rows, (SELECT count(*) FROM lineitem) >= 1.15 * ceil(50000 / avg(l_quantity)) AS enough
    FROM lineitem WHERE l_orderkey % 97 = 1""")
def prefix_calibration(spark, sf):
    lines = table(spark, sf, "lineitem")
    return campaigns.prefix_calibration(lines.where("l_orderkey % 97 = 1"), "l_quantity", 50000.0, lines.count()).withColumn("mean", F.bround("mean", 6))


@query("""WITH c AS (SELECT l_linenumber AS k, sum(l_quantity) AS c FROM lineitem GROUP BY 1), s AS (SELECT k, c, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS total FROM c)
    SELECT count(*) AS chunks, sum(c) AS cost FROM s WHERE before < 0.5 * total""")
def purchase_loop(spark, sf):
    """Chunks of lines, by line number, bought until half of all quantity is reached."""
    bought = campaigns.affordable(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity", 0.5 * F.col("total"))
    return bought.agg(F.count(F.lit(1)).alias("chunks"), F.sum("cost").alias("cost"))


@query("""WITH s AS (SELECT l_returnflag AS arm, count(*) AS rows, sum(l_quantity) AS cost FROM lineitem GROUP BY 1), r AS (SELECT rows AS r, cost AS c FROM s WHERE arm = 'N')
    SELECT arm, rows, cost, round_even(cost / c, 6) AS cost_ratio, round_even(rows / r, 6) AS row_ratio FROM s, r""")
def cost_ratios(spark, sf):
    return campaigns.ratios(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), "l_quantity"), "arm", "l_quantity", "N")


@query("""WITH s AS (SELECT o_orderpriority AS arm, sum(512 * (1 + o_custkey % 3))::DOUBLE AS nominal FROM orders GROUP BY 1), r AS (SELECT nominal AS n FROM s WHERE arm = '5-LOW')
    SELECT arm, nominal, round_even(nominal / n, 6) AS ratio FROM s, r""")
def nominal_economics(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"), (F.lit(512) * (1 + F.col("o_custkey") % 3)).alias("budget"))
    return campaigns.nominal_costs(rows, "arm", "budget", "5-LOW")


@query("""SELECT l_returnflag AS arm, round_even(avg(l_discount) FILTER (l_linestatus = 'F') - avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS gap FROM lineitem GROUP BY 1""")
def train_exam_gap(spark, sf):
    return campaigns.generalisation_gap(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), "l_linestatus", "l_discount"), "arm", "l_linestatus", "l_discount", "F", "O")


@query("""WITH p AS (SELECT p_partkey AS name, 768 AS i, p_size % 5 AS h, p_partkey % 3 AS k FROM part), c AS (SELECT *, CASE WHEN h > 0 THEN i * h + 2 * h + 1 ELSE i + 1 END AS inference, k * (h + 1) AS extra FROM p)
    SELECT name, inference + extra AS total, inference, extra AS training_only FROM c""")
def parameter_accounting(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.lit(768).alias("i"), (F.col("p_size") % 5).alias("h"), (F.col("p_partkey") % 3).alias("k"))
    return campaigns.parameter_accounting(models, "name", "i", "h", "k")


@query("""SELECT l_suppkey AS name, round_even(avg(l_discount), 6) AS loss, round_even(avg(l_discount) / (l_suppkey * 768 + 1), 9) AS per_parameter FROM lineitem GROUP BY l_suppkey""")
def loss_per_parameter(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("name"), "l_discount", (F.col("l_suppkey") * 768 + 1).alias("p"))
    return campaigns.loss_per_parameter(runs, "name", "l_discount", "p")


@query("""SELECT l_returnflag AS family, count(*) AS n, round_even(avg((l_quantity - l_linenumber * 7) ^ 2), 6) AS mse, round_even(avg(abs(l_quantity - l_linenumber * 7)), 6) AS mae,
    round_even(avg((round_even(l_quantity, 0) = l_linenumber * 7)::INT::DOUBLE), 6) AS accuracy FROM lineitem GROUP BY 1""")
def auxiliary_quality(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("family"), (F.col("l_linenumber") * 7).cast("double").alias("target"), F.col("l_quantity").cast("double").alias("predicted"))
    return campaigns.auxiliary_quality(rows, "family", "target", "predicted")


@query("""WITH p AS (SELECT l_orderkey, avg(l_tax) FILTER (l_returnflag = 'A') AS a, avg(l_tax) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
    SELECT count(*) AS n, round_even(avg(a), 6) AS a, round_even(avg(b), 6) AS b, round_even(avg(b - a), 6) AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def arm_effects(spark, sf):
    e = campaigns.arm_effect(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "A", "R", "l_tax")
    return e.agg(F.count(F.lit(1)).alias("n"), *(F.bround(F.avg(c), 6).alias(c) for c in ("a", "b", "d")))


@query(D_SQL + """ SELECT width, CASE WHEN low IS NULL THEN 'INVALID' WHEN high < 0 AND abs(mean) >= 1000 THEN 'SUPPORTED' WHEN low > 0 THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS finding FROM c""")
def finding_rule(spark, sf):
    c = stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d"))
    return c.select("width", campaigns.finding(F.col("low"), F.col("high"), F.col("mean"), 1000.0).alias("finding"))


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS arm, 'tax' || l_linenumber AS name, CASE WHEN l_linenumber < 4 THEN 1 ELSE l_quantity END AS v FROM lineitem), a AS (SELECT count(DISTINCT arm) AS n FROM s)
    SELECT name, count(DISTINCT v) + (count(DISTINCT arm) < max(n))::INT AS values FROM s, a WHERE name <> 'tax7' GROUP BY 1 HAVING count(DISTINCT v) > 1 OR count(DISTINCT arm) < max(n)""")
def campaign_symmetry(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.concat(F.lit("tax"), F.col("l_linenumber")).alias("name"), F.when(F.col("l_linenumber") < 4, 1).otherwise(F.col("l_quantity")).alias("v"))
    return campaigns.arm_symmetry(s, "arm", "name", "v", ["tax7"])


@query("""WITH b AS (SELECT n_nationkey AS name, n_regionkey AS base FROM nation), s AS (SELECT c_custkey AS run, c_nationkey AS name, c_custkey % 5 AS value FROM customer)
    SELECT run, name, base, value FROM s LEFT JOIN b USING (name) WHERE value IS DISTINCT FROM base""")
def ablation_preview(spark, sf):
    base = table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), F.col("n_regionkey").cast("long").alias("value"))
    switches = table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("name"), (F.col("c_custkey") % 5).alias("value"))
    return campaigns.switch_changes(switches, base, "run", "name", "value")


@query("""SELECT o_orderpriority AS size, l_returnflag AS name, count(DISTINCT o_orderkey) AS runs, round_even(avg(l_tax), 6) AS mean, min(l_tax) AS least, max(l_tax) AS largest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def scaling_view(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("size"))
    return campaigns.scaling(runs, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("name"), "l_tax"), "run", "size", "name", "l_tax")


@query("""SELECT event_type AS stage, count(*) AS rows, round_even(sum(value) / 1000, 6) AS seconds, sum(user_id)::BIGINT AS nodes FROM events GROUP BY 1""")
def stage_costs(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value", "user_id")
    return funnel.stage_costs(rows, "stage", "value", "user_id")


@query("""WITH r AS (SELECT l_returnflag AS arm, avg((l_discount > 0.05)::INT::DOUBLE) AS rate FROM lineitem GROUP BY 1) SELECT round_even(max(rate) FILTER (arm = 'R') / max(rate) FILTER (arm = 'N'), 6) AS ratio FROM r""")
def yield_ratio(spark, sf):
    rates = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg((F.col("l_discount") > 0.05).cast("double")).alias("rate"))
    return funnel.yield_ratio(rates, "arm", "rate", "R", "N")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS theirs FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def coverage_compare(spark, sf):
    count = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf, "orders")
    return funnel.count_differences(count(orders), count(orders.where("o_orderkey % 4 <> 0")), "k", "n")


@query("""SELECT field, count(*) AS n, min(k) AS example FROM (SELECT o_orderkey AS k, unnest(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'price' END, CASE WHEN o_orderkey % 10 = 0 THEN 'status' END], lambda x: x IS NOT NULL)) AS field FROM orders) GROUP BY 1""")
def parity_tolerances(spark, sf):
    key = F.col("o_orderkey")
    ours = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    theirs = ours.select("o_orderkey", (F.col("price") + F.when(key % 9 == 0, 0.5).otherwise(0.001)).alias("price"), F.when(key % 10 == 0, F.lit("?")).otherwise(F.col("status")).alias("status"), (F.col("owner") + 1).alias("owner"))
    return funnel.parity_differences(ours, theirs, "o_orderkey", {"price": 0.1, "status": None, "owner": float("inf")})


@query("""SELECT l_orderkey, count(*)::INT AS n, (count(*) FILTER (l_linestatus = 'F'))::INT AS white, (count(*) FILTER (l_linestatus = 'O'))::INT AS black, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS kinds,
    count(*) FILTER (l_linestatus = 'F') > 0 AND count(*) FILTER (l_linestatus = 'O') > 0 AS both FROM lineitem GROUP BY 1""")
def tier0_summary(spark, sf):
    item = F.struct(F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "F", "w").otherwise("b").alias("side"))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    s = per.select("l_orderkey", funnel.item_summary(F.col("items")).alias("s"))
    return s.select("l_orderkey", "s.n", "s.white", "s.black", F.array_join("s.kinds", "").alias("kinds"), "s.both")


@query("""SELECT l_orderkey, max(l_quantity) AS last FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def selection_to_label(spark, sf):
    searches = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("budgets"))
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return funnel.selected_labels(wanted, searches, "l_orderkey", "budgets")


@query("""SELECT count(*) FILTER (l_discount > 0.05 OR l_tax = 0) AS tagged, count(*) FILTER (abs(l_extendedprice) < 50000) AS no_mates FROM lineitem""")
def tag_and_mate_filters(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "deep"), F.when(F.col("l_tax") == 0, "audit"))).alias("tags"))
    a = funnel.tagged(rows, "tags").agg(F.count(F.lit(1)).alias("tagged"))
    return a.crossJoin(F.broadcast(funnel.without_mates(rows, "l_extendedprice", 50_000).agg(F.count(F.lit(1)).alias("no_mates"))))


@query("""WITH e AS (SELECT o_custkey AS c, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1) SELECT c_custkey, coalesce(s, '') AS switches FROM customer LEFT JOIN e ON c = c_custkey""")
def evidence_switches(spark, sf):
    evidence = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    out = funnel.linked_switches(table(spark, sf, "customer").select("c_custkey"), evidence, "c_custkey", "o_orderpriority")
    return out.select("c_custkey", F.array_join("switches", ",").alias("switches"))


@query("""WITH m AS (SELECT s_suppkey % 40 AS d, s_nationkey AS n, s_suppkey AS k FROM supplier), w AS (SELECT c_custkey, c_custkey % 60 AS d, c_nationkey AS n FROM customer)
    SELECT c_custkey, coalesce((SELECT min(k) FROM m WHERE m.d = w.d), (SELECT min(k) FROM m WHERE m.n = w.n)) AS model FROM w""")
def model_lookup(spark, sf):
    models = table(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("d"), F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("model"))
    wanted = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("d"), F.col("c_nationkey").alias("n"))
    return funnel.found_models(wanted, models, "d", "n", "model").select("c_custkey", "model")


@query("""SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'P' WHEN 2 THEN 'O' ELSE 'F' END AS o_orderstatus FROM orders GROUP BY 1""")
def worst_state(spark, sf):
    return funnel.worst_state(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", ["P", "O", "F"])


@query("""SELECT c_name AS id, c_custkey AS number FROM customer WHERE c_custkey % 2 = 0""")
def object_registry(spark, sf):
    rows = table(spark, sf, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "C").otherwise("D"), F.col("c_custkey")).alias("object"), F.col("c_name").alias("id"))
    return funnel.registry(rows, "object", "C").select("id", "number")


@query("""SELECT event_id, user_id || ':' || event_id AS source_ref, CASE WHEN user_id % 3 > 0 THEN user_id::VARCHAR END AS game, user_id % 3 = 0 AS game_unknown, event_type = 'click' AS tier0, value > 50 AS tier1 FROM events""")
def funnel_import(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    tiers = {"tier0": events.where("event_type = 'click'"), "tier1": events.where("value > 50")}
    return funnel.imported_positions(events, "event_id", "user_id", "event_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")), tiers)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey % 3 > 0 THEN 'f' || o_orderkey END AS funnel_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 3 > 0 AND l_linenumber = 1""")
def funnel_id_lookup(spark, sf):
    sources = table(spark, sf, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.concat(F.lit("f"), "o_orderkey").alias("funnel_id"))
    return funnel.funnel_ids(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), sources, "l_orderkey", "l_linenumber", "funnel_id")


COMPONENTS_SQL = """c AS (SELECT o_orderpriority AS p, count(*) AS c FROM orders GROUP BY 1), t AS (SELECT count(*) AS total, greatest(50.0, 0.15 * count(*)) AS target FROM orders),
    x AS (SELECT o_orderkey, (o_totalprice / 100)::INT AS s, o_custkey % 7 AS moves, o_orderkey % 5 AS skips, c, target, o_orderkey % 11 AS k, CASE o_orderstatus WHEN 'O' THEN 'stable-at-budget' WHEN 'P' THEN 'omission-risk' ELSE 'odd' END AS status
      FROM orders JOIN c ON p = o_orderpriority, t),
    y AS (SELECT o_orderkey, least(1.0, s / 400.0) AS a, (k > 5)::INT::DOUBLE AS b, (CASE status WHEN 'stable-at-budget' THEN 0.0 WHEN 'omission-risk' THEN 0.75 ELSE 0.5 END)::DOUBLE AS c, (CASE WHEN k > 2 THEN 0.5 ELSE 0.0 END)::DOUBLE AS d, least(1.0, k / 4.0) AS e,
      greatest(least(1.0, target / greatest(1, c)), 0.5 * least(1.0, target / greatest(1, c))) AS f,
      least(1.0, greatest(0.0, CASE k % 3 WHEN 0 THEN -1 WHEN 1 THEN 0.5 ELSE 1 END * least(2000, s) - 50) / 300) AS g, (CASE WHEN k = 4 THEN 1.0 ELSE least(1.0, skips / 3.0) END)::DOUBLE AS h, (k = 1 OR moves <= 2)::INT::DOUBLE AS i FROM x)"""


@query(f"""WITH {COMPONENTS_SQL} SELECT o_orderkey, round_even(a, 6) AS a, b, c, d, e, round_even(f, 6) AS f, round_even(g, 6) AS g, round_even(h, 6) AS h, i FROM y""")
def nine_components(spark, sf):
    return _nine(spark, sf)


def _nine(spark, sf):
    orders = table(spark, sf, "orders")
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    rows = orders.join(F.broadcast(counts), "o_orderpriority").crossJoin(F.broadcast(orders.agg(F.count(F.lit(1)).alias("total"))))
    k, score = F.col("o_orderkey") % 11, F.bround(F.col("o_totalprice") / 100, 0).cast("int")
    status = F.when(F.col("o_orderstatus") == "O", "stable-at-budget").when(F.col("o_orderstatus") == "P", "omission-risk").otherwise("odd")
    result = F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.5).otherwise(0.0)
    pv = F.array(F.lit("e4"), F.lit("e5"))
    found = funnel.priority_components(
        score, k > 5, status, pv, F.when(k > 2, F.array(F.lit("e4"), F.lit("c5"), F.lit("d4"))).otherwise(pv), k, F.array("c"), F.col("c"), F.col("total"), score, result, k == 1, F.col("o_custkey") % 7,
        F.col("o_orderkey") % 5, F.when(k == 4, F.array(F.lit("partial-iteration-move-shift"))), {"scoreDeltaCp": 400, "tacticalItems": 4, "outcomeMarginCp": 50, "outcomeScaleCp": 300, "seePruneSkips": 3, "forcedLegalMoves": 2}, 0.15, 50.0,
    )
    return rows.select("o_orderkey", *(F.bround(c.cast("double"), 6).alias(n) for n, c in zip("abcdefghi", found.values())))


@query(f"""WITH {COMPONENTS_SQL} SELECT o_orderkey, round_even(round_even(a * 2 / 10, 6) + round_even(b / 10, 6) + round_even(c / 10, 6) + round_even(d / 10, 6) + round_even(e / 10, 6) + round_even(f / 10, 6) + round_even(g / 10, 6)
    + round_even(h / 10, 6) + round_even(i / 10, 6), 4) AS priority FROM y""")
def nine_component_priority(spark, sf):
    """Rounded to four places, as sums of rounded tenths may differ in the last bit."""
    rows = _nine(spark, sf)
    score, _ = triage.priority({c: (F.col(c), 2.0 if c == "a" else 1.0) for c in "abcdefghi"})
    return rows.select("o_orderkey", F.bround(score, 4).alias("priority"))


@query(f"""SELECT l_returnflag AS arm, count(*) AS rows, count(DISTINCT l_orderkey) AS ids, {HASH.format("l_orderkey::VARCHAR")} AS ids_hash, sum(l_quantity) AS cost FROM lineitem GROUP BY 1""")
def prefix_proofs(spark, sf):
    return campaigns.prefix_proof(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "arm"), "l_orderkey", "l_quantity", ["arm"])


@query("""WITH f AS (SELECT 'nation' AS facet, c_nationkey::VARCHAR AS key, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2)
    SELECT facet, key, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key)::INT AS rank FROM f QUALIFY rank <= 8""")
def top_8_facets(spark, sf):
    pairs = F.array(F.struct(F.lit("nation").alias("facet"), F.col("c_nationkey").cast("string").alias("key")), F.struct(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("key")))
    facets = table(spark, sf, "customer").select(F.inline(pairs)).groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))
    return catalog.top_facets(facets, "facet", "key", "n")


@query("""SELECT event_type, count(json_extract_string(props, '$.k')) AS with_path, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (event_type = 'click' AND json_extract_string(props, '$.k') IS NOT NULL) AS matched FROM events GROUP BY 1""")
def target_value_paths(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.col("props").alias("value"))
    found = dig(F.col("value"), "k")
    return rows.groupBy("event_type").agg(F.count(found).alias("with_path"), F.sum(found.cast("long")).alias("total"), F.count_if(labels.matching(rows, value_path="k", event_type="click")).alias("matched"))


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') GROUP BY 1, 2""")
def policy_store(spark, sf):
    """How many orders a customer has of each priority that a store of identities, which holds the urgent ones, lacks."""
    rows = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("identity", campaigns.identity_hash(F.col("o_custkey"), F.col("o_orderpriority")))
    return records.unseen(rows.where("o_orderpriority = '1-URGENT'"), rows, "identity").drop("identity")


@query("""SELECT c_custkey, round_even(1 / (1 + pow(10.0, -c_acctbal / 400.0)), 6) AS rating, round_even(('0x' || substr(sha256('4:' || c_custkey), 1, 8))::BIGINT / 4294967296.0, 9) AS unit,
    'rec_' || substr(sha256(lower(c_name)), 1, 20) AS id FROM customer""")
def sql_functions(spark, sf):
    sql.register(spark)
    table(spark, sf, "customer").createOrReplaceTempView("quarrymill_customer")
    return spark.sql("SELECT c_custkey, bround(rating_score(c_acctbal), 6) AS rating, bround(split_unit(4, cast(c_custkey AS STRING)), 9) AS unit, content_id(canonical_text(c_name)) AS id FROM quarrymill_customer")


@query("""SELECT o_orderpriority, count(d) AS dated, min(d) AS first FROM (SELECT o_orderpriority, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')::DATE AS d FROM orders) GROUP BY 1""")
def dates_in_names(spark, sf):
    d = date_in(F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".json")))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(d).alias("dated"), F.min(d).alias("first"))


@query("""WITH f AS (SELECT source, lang AS family, count(*) AS n FROM documents GROUP BY 1, 2), a AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'search' ELSE 'oracle' END AS authority, count(*) AS n FROM documents GROUP BY 1, 2)
    SELECT source, sum(n)::BIGINT AS rows, string_agg(family || '=' || n, ',' ORDER BY family) AS families, (SELECT string_agg(authority || '=' || a.n, ',' ORDER BY authority) FROM a WHERE a.source = f.source) AS authorities,
    'policy-' || source AS policy_hash, (SELECT max(doc_id) % 5 FROM documents d WHERE d.source = f.source) AS registry_version FROM f WHERE source IS NOT NULL GROUP BY source""")
def label_set_references(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null")
    rows = docs.select("source", "doc_id", F.col("lang").alias("family"), F.when(F.col("doc_id") % 3 == 0, "search").otherwise("oracle").alias("authority"), F.lit("p").alias("producer"),
        (F.col("doc_id") % 5).alias("registry_version"), F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("policy-"), "source")).alias("policy_hash"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    refs = labels.set_references(rows, "source", "doc_id")
    return refs.select("source", "rows", text("families").alias("families"), text("authorities").alias("authorities"), "policy_hash", "registry_version")


@query("""SELECT l_returnflag AS arm, l_linenumber AS seed, round_even(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) - avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS d
    FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2 HAVING count(DISTINCT l_linestatus) = 2""")
def paired_complete(spark, sf):
    """Contrasts over a design whose cells must all be there: flags that have both states, with their line numbers."""
    from quarrymill.operators import stats

    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("seed"), "l_linestatus", "l_quantity").where("arm = 'N'")
    design = rows.groupBy("arm", "seed").agg(F.count_distinct("l_linestatus").alias("n")).where("n = 2").drop("n")
    rows = rows.join(design, ["arm", "seed"], "left_semi")
    return stats.paired(rows, ["arm", "seed"], "l_linestatus", "F", "O", "l_quantity", complete=design).withColumn("d", F.bround("d", 6))
