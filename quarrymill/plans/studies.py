"""Queries over triage, statistics, run lattices and the provenance map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import experiments, models, stacks, stats, triage
from quarrymill.plans.registering import registers
from quarrymill.session import Scratch, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

query = registers(QUERIES, ORACLE_SQL)


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS key FROM documents)
    SELECT key, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT '__positions__', count(*) FROM documents""")
def coverage_counts_explode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("text")
    return triage.coverage_counts(rows, F.split(F.lower("text"), r"\s+"))


@query(r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS key FROM documents)
    SELECT key, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT '__positions__', count(*) FROM documents""")
def coverage_counts_whole(spark, sf):
    """coverage_counts_explode under its former name."""
    return triage.coverage_counts(table(spark, sf, "documents").select("text"), F.split(F.lower("text"), r"\s+"))


@query("""WITH c AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT count(*) AS total FROM orders)
    SELECT key, n, round_even(least(1.0, greatest(50.0, 0.15 * total) / greatest(1.0, n)), 6) AS rarity FROM c, t""")
def rarity_weights(spark, sf):
    orders = table(spark, sf, "orders")
    counts = orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("key", "n", F.bround(triage.rarity(F.col("n"), F.col("total"), 0.15, 50.0), 6).alias("rarity"))


def _scored(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.max("l_discount").alias("top_discount"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    score, parts = triage.priority({
        "size": (F.least(F.lit(1.0), F.col("lines") / 7.0), 2.0),
        "discount": (F.least(F.lit(1.0), F.col("top_discount") / 0.1), 1.0),
        "returns": (F.col("returned") / F.col("lines"), 3.0),
        "urgency": ((F.col("o_orderpriority") == "1-URGENT").cast("double"), 1.0),
    })
    return rows.select("o_orderkey", score.alias("priority"), parts.alias("parts"))


SCORED_SQL = """WITH l AS (SELECT l_orderkey, count(*) AS lines, max(l_discount) AS top_discount, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey, round_even(least(1.0, lines / 7.0) * 2 / 7.0, 6) AS size, round_even(least(1.0, top_discount / 0.1) / 7.0, 6) AS discount,
      round_even(returned::DOUBLE / lines * 3 / 7.0, 6) AS "returns", round_even((o_orderpriority = '1-URGENT')::INT::DOUBLE / 7.0, 6) AS urgency
      FROM orders JOIN l ON o_orderkey = l_orderkey),
    p AS (SELECT *, round_even(size + discount + "returns" + urgency, 6) AS priority FROM c),
    r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, sha256('2:tie:' || o_orderkey::VARCHAR), o_orderkey) AS rank FROM p)"""


@query(SCORED_SQL + " SELECT o_orderkey, priority, rank FROM r")
def priority_score_rank(spark, sf):
    return triage.ranked(_scored(spark, sf).drop("parts"), "priority", "o_orderkey", 2).select("o_orderkey", "priority", F.col("rank").cast("long").alias("rank"))


@query(SCORED_SQL + """, x AS (SELECT o_orderkey, unnest([{'n': 'size', 'v': size}, {'n': 'discount', 'v': discount}, {'n': 'returns', 'v': "returns"}, {'n': 'urgency', 'v': urgency}]) AS e FROM p),
    y AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY e.v DESC, e.n) AS rn FROM x WHERE e.v > 0)
    SELECT e.n AS reason, rn::INT AS place, count(*) AS n FROM y WHERE rn <= 2 GROUP BY 1, 2""")
def top_reasons(spark, sf):
    reasons = _scored(spark, sf).select(F.posexplode(triage.top_reasons(F.col("parts"), 2)).alias("place", "reason"))
    return reasons.groupBy("reason", (F.col("place") + 1).alias("place")).agg(F.count(F.lit(1)).alias("n"))


def _held(spark, sf):
    ranked = Scratch(spark).table(triage.ranked(_scored(spark, sf).drop("parts"), "priority", "o_orderkey", 2), "ranked")
    return stacks.holdout(ranked, "o_orderkey", 0.1, 2)


def _arms(spark, sf):
    return stacks.selected_arms(_held(spark, sf), "o_orderkey", 0.1, 0.05, 2)


ARMS_SQL = SCORED_SQL + """, h AS (SELECT o_orderkey, priority, rank, ('0x' || substr(sha256('2:holdout:' || o_orderkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1 AS holdout FROM r),
    k AS (SELECT round_even(0.1 * count(*), 0) AS k, round_even(0.05 * count(*), 0) AS a FROM h),
    d AS (SELECT *, NOT holdout AND row_number() OVER (PARTITION BY holdout ORDER BY rank) <= (SELECT k FROM k) AS deep,
      NOT holdout AND row_number() OVER (PARTITION BY holdout ORDER BY sha256('2:uniform:' || o_orderkey), o_orderkey) <= (SELECT k FROM k) AS uniform FROM h),
    s AS (SELECT *, NOT holdout AND NOT deep AND row_number() OVER (PARTITION BY holdout OR deep ORDER BY sha256('2:audit:' || o_orderkey), o_orderkey) <= (SELECT a FROM k) AS audit FROM d)"""


@query(ARMS_SQL + " SELECT o_orderkey, holdout, deep, uniform, audit FROM s")
def arms_topk_uniform_audit(spark, sf):
    return _arms(spark, sf).select("o_orderkey", "holdout", "deep", "uniform", "audit")


@query(ARMS_SQL + """, u AS (SELECT 'deep' AS arm, * FROM s WHERE deep UNION ALL SELECT 'uniform', * FROM s WHERE uniform UNION ALL SELECT 'audit', * FROM s WHERE audit)
    SELECT arm, count(*) AS n, count(*) FILTER (o_totalprice > 150000)::DOUBLE / count(*) AS large_rate, round_even(avg(o_totalprice), 3) AS mean_price FROM u JOIN orders USING (o_orderkey) GROUP BY 1""")
def arm_report(spark, sf):
    # Most rows are in no arm, so the arms' rows are put together and not looked up in the whole pool.
    arms = stacks.arm_ids(_held(spark, sf), "o_orderkey", 0.1, 0.05, 2)
    members = reduce(lambda a, b: a.unionByName(b), (ids.select("o_orderkey", *(F.lit(x == name).alias(x) for x in arms)) for name, ids in arms.items()))
    rows = members.join(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return triage.arm_report(rows, list(arms), {"large_rate": F.avg((F.col("o_totalprice") > 150000).cast("double")), "mean_price": F.bround(F.avg("o_totalprice"), 3)})


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity) AS t FROM lineitem GROUP BY 1)
    SELECT max(t) AS largest, min(t) AS smallest, round_even((max(t) - min(t)) / max(t), 6) AS gap, (max(t) - min(t)) / max(t) <= 0.05 AS within FROM s""")
def compute_parity(spark, sf):
    return triage.parity(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity", 0.05)


@query("SELECT least(19, greatest(0, floor(l_discount * 10 * 20)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_20(spark, sf):
    return table(spark, sf, "lineitem").groupBy(scalars.unit_bin(F.col("l_discount") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, round_even(1 / (1 + exp(-greatest(-60.0, least(60.0, c_acctbal / 256.0)))), 6) AS natural_score, round_even(1 / (1 + pow(10.0, -c_acctbal / 4000.0)), 6) AS rating_score FROM customer""")
def expected_score(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.bround(scalars.logistic_score(F.col("c_acctbal")), 6).alias("natural_score"), F.bround(scalars.rating_score(F.col("c_acctbal"), 4000.0), 6).alias("rating_score"))


# Orders play the part of runs: the bucket of a customer is the seed, the priority the arm, the year the width.
RUNS_SQL = """WITH runs AS (SELECT o_custkey % 20 AS seed, o_orderpriority AS arm, year(o_orderdate)::INT AS width, o_totalprice AS loss FROM orders)"""


def _runs(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("seed"), F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("width"), F.col("o_totalprice").alias("loss"))


T_TABLE = "[" + ", ".join(repr(stats.t_critical(k)) for k in range(1, 31)) + "]"
D_SQL = RUNS_SQL + """, d AS (SELECT width, seed, avg(loss) FILTER (arm = '2-HIGH') - avg(loss) FILTER (arm = '1-URGENT') AS d FROM runs GROUP BY 1, 2),
    i AS (SELECT width, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS s FROM d WHERE d IS NOT NULL GROUP BY 1),
    c AS (SELECT width, n, mean, mean - h AS low, mean + h AS high FROM (SELECT *, """ + T_TABLE + """[n - 1] * s / sqrt(n) AS h FROM i))"""


def _contrast(spark, sf):
    return stats.paired(_runs(spark, sf), ["width", "seed"], "arm", "1-URGENT", "2-HIGH", "loss")


@query(D_SQL + " SELECT width, n, round_even(mean, 3) AS mean, round_even(low, 3) AS low, round_even(high, 3) AS high FROM c")
def paired_t_ci(spark, sf):
    out = stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d"))
    return out.select("width", "n", *(F.bround(c, 3).alias(c) for c in ("mean", "low", "high")))


@query(D_SQL + """, x AS (SELECT width, seed, lag(width) OVER w AS previous, d - lag(d) OVER w AS interaction FROM d WHERE d IS NOT NULL WINDOW w AS (PARTITION BY seed ORDER BY width))
    SELECT width, previous, count(*) AS n, round_even(avg(interaction), 3) AS mean FROM x WHERE previous IS NOT NULL GROUP BY 1, 2""")
def interaction_adjacent(spark, sf):
    steps = stats.adjacent_interaction(_contrast(spark, sf), "seed", "width")
    return steps.groupBy("width", "previous").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("interaction"), 3).alias("mean"))


@query(RUNS_SQL + """, d AS (SELECT seed, (avg(loss) FILTER (arm = '2-HIGH' AND width = 1996) - avg(loss) FILTER (arm = '1-URGENT' AND width = 1996))
      - (avg(loss) FILTER (arm = '2-HIGH' AND width = 1994) - avg(loss) FILTER (arm = '1-URGENT' AND width = 1994)) AS d FROM runs GROUP BY 1)
    SELECT count(d) AS n, round_even(avg(d), 3) AS did FROM d""")
def did_2x2(spark, sf):
    rows = _runs(spark, sf).where("width in (1994, 1996) and arm in ('1-URGENT', '2-HIGH')")
    d = stats.difference_in_differences(rows.withColumns({"__w": F.col("width") == 1996, "__a": F.col("arm") == "2-HIGH"}), "seed", "__w", "__a", "loss")
    return d.agg(F.count("d").alias("n"), F.bround(F.avg("d"), 3).alias("did"))


@query(D_SQL + """ SELECT count(*) AS n, CASE WHEN bool_and(high < 0) THEN 'SUPPORTED' WHEN bool_and(low > 0) THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS decision FROM c""")
def decision_rule(spark, sf):
    return stats.decision(stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d")))


@query(D_SQL + """ SELECT CASE WHEN bool_and(high < 60000) THEN 'NONINFERIOR' WHEN bool_and(low > 60000) THEN 'FLOOR_CROSSED' ELSE 'INCONCLUSIVE' END AS verdict,
    bool_and(low > -60000 AND high < 60000) AS equivalent, round_even(max(high), 3) AS largest_upper FROM c""")
def noninferiority_rule(spark, sf):
    return stats.noninferiority(stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d")), 60000.0).withColumn("largest_upper", F.bround("largest_upper", 3))


@query(D_SQL + " SELECT width, CASE WHEN high < 0 THEN 'better' WHEN low > 0 THEN 'worse' ELSE 'unresolved' END AS verdict FROM c")
def contrast_verdict(spark, sf):
    return stats.mean_interval(_contrast(spark, sf), ["width"], F.col("d")).select("width", stats.verdict(F.col("low"), F.col("high")).alias("verdict"))


@query("""WITH x AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x)
    SELECT count(*) AS n, round_even(corr(x, y), 6) AS pearson, round_even(corr(rx, ry), 6) AS spearman FROM r""")
def spearman_pearson(spark, sf):
    out = stats.correlations(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.bround("pearson", 6).alias("pearson"), F.bround("spearman", 6).alias("spearman"))


@query("""WITH s AS (SELECT o_orderpriority, list(o_totalprice ORDER BY o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_orderpriority, v[n // 2 + 1] AS upper_median, v[(0.9 * (n - 1))::DOUBLE::INT + CASE WHEN (0.9 * (n - 1)) < (0.9 * (n - 1))::DOUBLE::INT THEN 0 ELSE 1 END] AS p90 FROM s""")
def upper_median_p90(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    half = stats.order_statistic(rows, ["o_orderpriority"], "o_totalprice", F.floor(F.col("n") / 2), "upper_median")
    return half.join(stats.order_statistic(rows, ["o_orderpriority"], "o_totalprice", F.floor(F.col("n") * 0.9 - 0.9), "p90"), "o_orderpriority")


@query("""WITH l AS (SELECT n_nationkey AS nation, s.segment FROM nation, (SELECT DISTINCT c_mktsegment AS segment FROM customer) s),
    p AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) FILTER (c_acctbal >= 5000) AS completed, count(*) FILTER (NOT c_acctbal >= 5000) AS other FROM customer WHERE c_nationkey <> 3 GROUP BY 1, 2)
    SELECT nation::BIGINT AS nation, segment, coalesce(completed, 0) AS completed, coalesce(other, 0) AS other, CASE WHEN coalesce(completed, 0) = 0 THEN 'missing' WHEN completed > 1 THEN 'duplicate' ELSE 'complete' END AS state
    FROM l LEFT JOIN p USING (nation, segment)""")
def lattice_membership(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 5000, "COMPLETED").otherwise("FAILED").alias("status"))
    lattice = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("nation")).crossJoin(customers.select("segment").distinct())
    return experiments.membership(lattice, customers.where("nation <> 3"), ["nation", "segment"], "status")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS identities FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def comparability(spark, sf):
    return experiments.incomparable(table(spark, sf, "orders"), ["o_custkey"], ["o_orderstatus"])


@query("""SELECT 'in_region' AS kind, n_nationkey::VARCHAR AS src, n_regionkey::VARCHAR AS dst FROM nation UNION SELECT 'supplier_of', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier
    UNION SELECT 'customer_of', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer UNION SELECT 'ordered_by', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders""")
def map_edges(spark, sf):
    t = lambda n: table(spark, sf, n)
    return experiments.edges({
        "in_region": (t("nation"), F.col("n_nationkey"), F.col("n_regionkey")), "supplier_of": (t("supplier"), F.col("s_suppkey"), F.col("s_nationkey")),
        "customer_of": (t("customer"), F.col("c_custkey"), F.col("c_nationkey")), "ordered_by": (t("orders"), F.col("o_orderkey"), F.col("o_custkey")),
    })


@query("""SELECT l_returnflag, round_even(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS mean_F, count(*) FILTER (l_linestatus = 'F') AS runs_F,
    round_even(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS mean_O, count(*) FILTER (l_linestatus = 'O') AS runs_O FROM lineitem GROUP BY 1""")
def matrix_pivot(spark, sf):
    return experiments.matrix(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity")


@query("""SELECT 'segment' AS slice, c_mktsegment AS key, count(*) AS n, round_even(avg(o_totalprice), 6) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2
    UNION ALL SELECT 'priority', o_orderpriority, count(*), round_even(avg(o_totalprice), 6) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2""")
def slices_mean(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    return experiments.slices(both.withColumn("priority", F.col("o_orderpriority")), ["segment", "priority"], "o_totalprice")


@query("""WITH x AS (SELECT label, list_sum([v::DOUBLE for v in embedding]) AS whole, list_sum([v::DOUBLE for v in embedding[9:]]) AS part FROM embeddings)
    SELECT label, count(*) AS n, round_even(avg(whole - part), 5) AS mean_effect FROM x GROUP BY 1""")
def mask_lesion(spark, sf):
    ones = [1.0] * 64
    rows = table(spark, sf, "embeddings")
    full, cut = experiments.linear(F.transform("embedding", lambda x: x.cast("double")), ones), experiments.linear(experiments.masked(F.col("embedding"), range(8)), ones)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(full - cut), 5).alias("mean_effect"))


@query("""SELECT l_returnflag, min(l_linenumber) FILTER (l_discount >= 0.05 AND l_quantity > 40) AS l_linenumber FROM lineitem GROUP BY 1""")
def cheapest_rung(spark, sf):
    return experiments.first_reaching(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", (F.col("l_discount") >= 0.05) & (F.col("l_quantity") > 40))


@query("""WITH m AS (SELECT l_returnflag, l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, arg_min(l_linenumber, m) AS l_linenumber FROM m GROUP BY 1""")
def best_depth(spark, sf):
    return experiments.best_rung(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", "l_discount")


@query()
def bootstrap_ci(spark, sf):
    return stats.bootstrap_interval(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal")


@query()
def train_eval(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("seed"), "embedding", F.col("label").cast("double").alias("target"))
    models_ = models.train_linear(rows.where("vec_id % 5 <> 0"), ["seed"], "embedding", "target", "vec_id")
    scored = rows.where("vec_id % 5 = 0").join(models_.select("seed", "weights"), "seed").withColumn("predicted", models.predict_linear(F.col("embedding"), F.col("weights")))
    return models.evaluate(scored, ["seed"], "predicted", "target", 1.0)


@query()
def train_networks(spark, sf):
    """Networks with and without an auxiliary head, evaluated on rows that they haven't seen."""
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 2).alias("seed"), "embedding", F.col("label").cast("double").alias("target"), F.array(F.element_at("embedding", 1).cast("double")).alias("aux"))
    seen, exam = rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")
    arms = [models.train_networks(seen, [], "seed", "embedding", "target", "vec_id", 8, aux, 0.1, updates=200).withColumn("arm", F.lit(name)) for name, aux in (("raw", None), ("aux", "aux"))]
    nets = arms[0].unionByName(arms[1])
    scored = exam.join(nets, "seed").withColumn("predicted", models.predict_network(F.col("embedding"), F.col("into"), F.col("shift"), F.col("out"), F.col("bias")))
    return models.evaluate(scored, ["arm", "seed"], "predicted", "target", 1.0)


@query("""SELECT l_returnflag, round_even(avg(l_quantity / nullif(l_linenumber, 0)), 6) AS weight FROM lineitem GROUP BY 1""")
def auxiliary_weights(spark, sf):
    return models.auxiliary_weight(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query("""SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL""")
def encode_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return models.encoded(rows, "quality").agg(F.count(F.lit(1)).alias("n"))
