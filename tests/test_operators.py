import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import positions, scalars
from quarrymill.functions.hashing import split_unit, unit_hash
from quarrymill.operators import canonical, catalog, diffs, experiments, labels, sequences, stacks, stats, triage
from quarrymill.operators.components import connected_components

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def test_hash_units_equal_python(spark):
    row = spark.createDataFrame([("g1",)], "g string").select(split_unit(7, F.col("g")), unit_hash(7, "holdout", F.col("g"))).first()
    assert row[0] == int(hashlib.sha256(b"7:g1").hexdigest()[:8], 16) / 2**32
    assert row[1] == int(hashlib.sha256(b"7:holdout:g1").hexdigest()[:16], 16) / 2**64


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_groups_never_straddle_splits(spark):
    rows = canonical.assign_split(spark.range(500).select("id", (F.col("id") % 40).alias("g")), F.col("g"))
    assert {r["key"]: r["straddling"] for r in canonical.straddling_groups(rows, ["g", "id"]).collect()} == {"g": 0, "id": 0}


def test_leak_free_train_set(spark):
    train = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("d", 4)], "g string, k int")
    exam = spark.createDataFrame([("x", 2)], "g string, k int")
    assert {r["g"] for r in canonical.without_leaks(train, exam, "g", "k").collect()} == {"c", "d"}


def test_labels(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    obs = spark.createDataFrame([(1, "eval", 2, 5.0), (1, "eval", 1, 4.0), (2, "fact", 1, 1.0), (9, "eval", 1, 0.0)], "id long, family string, seq int, value double")
    assert [r["id"] for r in labels.unknown_records(obs, records, "id").collect()] == [9]
    joined = {r["id"]: [x["value"] for x in r["labels"]] for r in labels.join_labels(records, obs, "id", ["seq"], ["value"]).collect()}
    assert joined == {1: [4.0, 5.0], 2: [1.0], 3: []}
    assert {(r["id"], r["n"]) for r in labels.not_exactly_one(records, obs, "id", F.col("family") == "eval").collect()} == {(1, 2), (2, 0), (3, 0)}
    assert labels.latest(obs, ["id", "family"], ["seq"], ["value"]).where("id = 1").first()["value"] == 5.0


def test_budget_subset(spark):
    obs = spark.createDataFrame([({"nodes": 16.0, "depth": 3.0},), ({"nodeBudget": 16.0},)], "budget map<string,double>")
    assert obs.where(labels.matching(obs, {"nodes": 16})).count() == 1


@pytest.mark.parametrize("expression,ids", [("k", [1, 2, 3]), ("k:7", [1]), ("k!=7", [2, 3]), ("k>=8", [2]), ("k<8", [1]), ("missing:1", [])])
def test_tag_expressions(spark, expression, ids):
    rows = spark.createDataFrame([(1, {"k": "7"}), (2, {"k": "8.5"}), (3, {"k": "x"}), (4, {})], "id int, tags map<string,string>")
    rows = rows.where(F.col("id") != 3) if expression in ("k>=8", "k<8") else rows
    assert sorted(r["id"] for r in rows.where(catalog.tag_filter(expression, F.col("tags"))).collect()) == ids


def test_facet_counts_equal_filter_counts(spark):
    rows = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["y"]), (None, [])], "f string, l array<string>")
    got = {(r["facet"], r["key"]): r["n"] for r in catalog.facets(rows, {"f": F.col("f")}, {"l": F.col("l")}).collect()}
    assert got == {("f", "a"): 2, ("f", None): 1, ("l", "x"): 1, ("l", "y"): 2}


def test_first_arm_wins(spark):
    got = stacks.stack([("one", spark.range(5)), ("two", spark.range(3, 8))], "id").collect()
    assert {r["id"]: (r["arm"], r["in_arms"]) for r in got} == {0: ("one", 1), 1: ("one", 1), 2: ("one", 1), 3: ("one", 2), 4: ("one", 2), 5: ("two", 1), 6: ("two", 1), 7: ("two", 1)}


def test_samples_nest_and_repeat(spark):
    rows = spark.range(300)
    small, large = ({r["id"] for r in stacks.fixed_rows(rows.repartition(p), "id", n, 3).collect()} for n, p in ((20, 2), (60, 7)))
    assert small < large and len(large) == 60


def test_holdout_is_pool_independent(spark):
    few = {r["id"] for r in stacks.holdout(spark.range(50), "id", 0.3).where("holdout").collect()}
    many = {r["id"] for r in stacks.holdout(spark.range(500), "id", 0.3).where("holdout").collect()}
    assert few == {i for i in many if i < 50}


def test_prefix_stops_at_a_gap(spark):
    rows = spark.createDataFrame([(i, None if i == 4 else 10.0) for i in range(10)], "id int, c double")
    assert tuple(stacks.nearest_prefix(rows, [F.col("id")], "c", 1000.0).first()) == (4, 40.0)
    assert tuple(stacks.nearest_prefix(rows, [F.col("id")], "c", 25.0).first()) == (2, 20.0)


def test_diff_and_same_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {r["k"]: r["change"] for r in diffs.diff(old, new, ["k"], ["v"]).collect()} == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    assert tuple(diffs.same_rows(old, old.repartition(3)).first()) == (0, 0)
    assert tuple(diffs.same_rows(old, new).first()) == (2, 2)


def test_sessions(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "named", 9), (4, None, 2), (5, None, 2), (6, None, 3)], "row int, game string, ply int").withColumn("s", F.lit("f"))
    got = [r["session"] for r in sequences.sessions_by_counter(rows, "s", ["row"], "ply", "game").orderBy("row").collect()]
    assert got == ["g000001", "g000001", "named", "g000001", "g000002", "g000002"]


def test_ranks_are_dense_and_stable(spark):
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("p"))
    one, two = ({r["id"]: r["rank"] for r in triage.ranked(rows.repartition(n), "p", "id").collect()} for n in (1, 5))
    assert one == two and sorted(one.values()) == list(range(1, 201))


def test_t_quantiles():
    for df, one_sided, value in ((1, False, 12.7062), (9, False, 2.2622), (19, True, 1.7291), (30, False, 2.0423)):
        assert abs(stats.t_critical(df, 0.95, one_sided) - value) < 1e-4


def test_paired_interval_and_decision(spark):
    rows = spark.createDataFrame([(s, a, 1.0 * s + (0.0 if a == "x" else -2.0 - 0.1 * s)) for s in range(6) for a in "xy"], "seed int, arm string, loss double").withColumn("w", F.lit(1))
    out = stats.mean_interval(stats.paired(rows, ["w", "seed"], "arm", "x", "y", "loss"), ["w"], F.col("d"))
    row = out.first()
    assert row["n"] == 6 and abs(row["mean"] + 2.25) < 1e-9 and row["low"] < row["mean"] < row["high"] < 0
    assert stats.decision(out).first()["decision"] == "SUPPORTED"


def test_order_statistics_and_correlation(spark):
    rows = spark.createDataFrame([("g", float(x), float(x * x)) for x in (1, 2, 2, 5, 9, 9)], "g string, x double, y double")
    assert stats.order_statistic(rows, ["g"], "x", F.floor(F.col("n") / 2), "m").first()["m"] == 5.0
    row = stats.correlations(rows, "x", "y").first()
    assert abs(row["spearman"] - 1) < 1e-12 and row["pearson"] < 1
    assert stats.correlations(rows.limit(2), "x", "y").first()["pearson"] is None


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(400).select("id", F.lit("a").alias("g"), (F.col("id") % 10).cast("double").alias("v"))
    a, b = (stats.bootstrap_interval(rows.repartition(n), ["g"], "id", "v", 100).first() for n in (1, 6))
    assert a["n"] == 400 and a["mean"] == 4.5 and math.isclose(a["low"], b["low"], rel_tol=1e-12) and a["low"] < 4.5 < a["high"]


def test_membership_states(spark):
    lattice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "arm string, seed int")
    runs = spark.createDataFrame([("a", 1, "COMPLETED"), ("a", 1, "COMPLETED"), ("b", 1, "COMPLETED"), ("c", 1, "COMPLETED"), ("a", 2, "INVALID")], "arm string, seed int, status string")
    assert {(r["arm"], r["seed"]): r["state"] for r in experiments.membership(lattice, runs, ["arm", "seed"], "status").collect()} == {("a", 1): "duplicate", ("a", 2): "missing", ("b", 1): "complete", ("c", 1): "extra"}


def test_scalars(spark):
    rows = spark.createDataFrame([(None,), (0.4,), (-99.0,), (299.0,), (5000.0,)], "v double")
    assert [r[0] for r in rows.select(scalars.magnitude_bucket(F.col("v"))).collect()] == ["unlabelled", "0", "1-99", "100-299", "900+"]
    one = spark.range(1)
    assert one.select(scalars.common_prefix(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(4)))).first()[0] == 2
    assert one.select(scalars.common_prefix(F.array(F.lit(1)), F.array(F.lit(1)))).first()[0] == 1
    assert [r[0] for r in spark.createDataFrame([(3,), (-2,)], "m int").select(scalars.mate_sentinel(F.col("m"))).collect()] == [999_997, -999_998]


def test_positions(spark):
    fens = [START, "8/8/8/8/8/8/8/8 w - - 0 1", "k7/3n4/8/8/2P5/8/6R1/q4NK1 b - - 3 12", "garbage"]
    rows = spark.createDataFrame([(f,) for f in fens], "fen string")
    assert [r[0] for r in rows.select(positions.is_well_formed(F.col("fen"))).collect()] == [True, False, True, False]
    row = rows.limit(1).select(positions.material_balance(F.col("fen")), positions.phase(F.col("fen")), positions.signature(F.col("fen")), F.size(positions.active_inputs(F.col("fen"))), positions.ply(F.col("fen"))).first()
    assert tuple(row) == (0, "opening", "Q1R2B2N2P8/q1r2b2n2p8", 32, 0)
    # White to move: the pawns stand on a2 to h2, which are squares 8 to 15 of plane 0.
    inputs = rows.limit(1).select(positions.active_inputs(F.col("fen"))).first()[0]
    assert inputs[:8] == list(range(8, 16))
    black = rows.where("fen like 'k7%'").select(positions.active_inputs(F.col("fen")), positions.ply(F.col("fen"))).first()
    # Seen from black, its king on a8 is plane 5 on a1, and its queen on a1 is plane 4 on a8.
    assert 5 * 64 + 0 in black[0] and 4 * 64 + 56 in black[0] and black[1] == 23
