"""Rules that refuse: complete pairs, one policy a label set, pinned identities, whole studies; and tags in any letter case."""


import pytest
from pyspark.sql import functions as F

from quarrymill.operators import campaigns, catalog, labels, stats
from quarrymill.streaming import funnel


@pytest.mark.parametrize("expression,ids", [("K", [1, 2, 3]), ("k:7", [1]), ("k:7.0", []), ("K:x", [3]), ("k:TRUE", []), ("t:true", [2]), ("k!=7", [2, 3]), ("k>=8", [2, 3]), ("k<7.5", [1]), ("k>X", []), ("k>W", [3]), ("missing!=1", []), ("e:", [4])])
def test_tags_in_any_letter_case(spark, expression, ids):
    rows = spark.createDataFrame([(1, {"K": "7"}), (2, {"k": "8.5", "T": "True"}), (3, {"k": "X"}), (4, {"E": "", "z": None})], "id int, tags map<string,string>")
    assert sorted(r["id"] for r in rows.where(catalog.tag_filter(expression, F.col("tags"))).collect()) == ids
    assert rows.where(catalog.tag_filter(expression, F.lit(None).cast("map<string,string>"))).count() == 0


def test_pairs_must_be_complete(spark):
    rows = [(w, s, a, float(w + s + (a == "y"))) for w in (1, 2) for s in (0, 1) for a in "xy"]
    table = spark.createDataFrame(rows, "w int, seed int, arm string, loss double")
    design = table.select("w", "seed").distinct()
    assert {tuple(r) for r in stats.paired(table, ["w", "seed"], "arm", "x", "y", "loss", design).collect()} == {(w, s, 1.0) for w in (1, 2) for s in (0, 1)}
    gone = table.where("not (w = 2 and seed = 1 and arm = 'y')")
    assert stats.paired(gone, ["w", "seed"], "arm", "x", "y", "loss").count() == 3
    with pytest.raises(stats.Incomplete, match=r"\(2, 1\) without y"):
        stats.paired(gone, ["w", "seed"], "arm", "x", "y", "loss", design)
    with pytest.raises(stats.Incomplete, match="beyond the design"):
        stats.paired(table, ["w", "seed"], "arm", "x", "y", "loss", design.where("w = 1"))


def test_ratios_without_their_reference_are_null(spark):
    rows = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("b", 1.0)], "arm string, cost double")
    assert {r.arm: (r.cost_ratio, r.row_ratio) for r in campaigns.ratios(rows, "arm", "cost", "a").collect()} == {"a": (1.0, 1.0), "b": (2.0, 2.0)}
    assert {tuple(r) for r in campaigns.ratios(rows, "arm", "cost", "z").collect()} == {("a", 1, 2.0, None, None), ("b", 2, 4.0, None, None)}
    assert {r.ratio for r in campaigns.nominal_costs(rows, "arm", "cost", "z").collect()} == {None}


def test_what_a_target_affords(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in (1, 2, 3, 3, 4)], "chunk int, cost double")
    got = [tuple(r) for r in campaigns.affordable(rows, "chunk", "cost", F.lit(3.5)).orderBy("chunk").collect()]
    assert got == [(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 6.0, 9.0)]
    have, cost = campaigns.bought_prefix([rows.where(F.col("chunk") == k) for k in (1, 2, 3, 4)], lambda c: c, "cost", 3.5)
    assert (len(have), cost) == (3, 9.0) and campaigns.affordable(rows, "chunk", "cost", F.lit(0.0)).count() == 0


def test_a_label_set_has_one_policy(spark):
    rows = [("a", 1, "f", "x", "p", 1, None), ("a", 2, "f", "y", "p", 3, "h1"), ("a", 3, "g", None, "p", 2, "h1"), (None, 1, "f", "x", "p", 1, None)]
    table = spark.createDataFrame(rows, "s string, seq int, family string, authority string, producer string, registry_version int, policy_hash string")
    got = {r.s: r for r in labels.set_references(table, "s", "seq").collect()}
    assert got["a"].families == {"f": 2, "g": 1} and got["a"].authorities == {"x": 1, "y": 1} and (got["a"].rows, got["a"].registry_version, got["a"].policy_hash) == (3, 2, "h1")
    assert got[None].policy_hash is None and got[None].producers == {"p": 1}
    two = table.withColumn("policy_hash", F.col("seq").cast("string"))
    with pytest.raises(Exception, match="several policy hashes: a"):
        labels.set_references(two, "s", "seq").collect()


def test_identities_are_pinned(spark, tmp_path):
    path = str(tmp_path / "run")
    mine = {"policy": "p1", "seed": 3, "caps": {"b": 1.5, "a": [1]}}
    assert funnel.pin_identity(spark, path, mine) and not funnel.pin_identity(spark, path, dict(reversed(mine.items())))
    with pytest.raises(funnel.IdentityError, match="differs in caps, oracle, seed"):
        funnel.pin_identity(spark, path, mine | {"seed": 4, "caps": {"a": [1]}, "oracle": "x"})
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "tier1.jsonl").write_text("{}")
    with pytest.raises(funnel.IdentityError, match="results of tier1 and no identity"):
        funnel.pin_identity(spark, str(tmp_path / "old"), mine)
    (tmp_path / "pool.jsonl").write_text('{"a":1}\n\n{"a":2}')
    assert funnel.input_rows(spark, [str(tmp_path / "pool.jsonl")] * 1) == 2 and funnel.input_rows(spark, []) == 0


def test_a_study_is_whole_or_refused(spark):
    design = spark.createDataFrame([("X1", a, s, f"d{a}") for a in "ab" for s in (0, 1)] + [("X2", "a", 0, "other")], "experiment string, arm string, seed int, dataset string")
    made = [(f"R{k}", "X1", a, s, f"d{a}", "COMPLETED", False) for k, (a, s) in enumerate((a, s) for a in "ab" for s in (0, 1))]
    runs = lambda rows: spark.createDataFrame(rows, "run string, experiment string, arm string, seed int, dataset string, status string, retry boolean")
    gate = lambda rows: campaigns.study_gate(runs(rows), design, ["arm", "seed"], "run", "experiment", ["dataset"], "status", "retry")
    assert gate(made) == "X1"
    for rows, why in (
        ([], "one experiment"),
        ([*made, ("R9", "X2", "a", 0, "other", "COMPLETED", False)], "one experiment: ..X1., .X2"),
        ([*made, ("R9", "X1", "c", 0, "dc", "COMPLETED", False)], "R9: its cell"),
        ([*made[:3], ("R9", "X1", "b", 1, "da", "COMPLETED", False)], "R9: it differs in dataset"),
        (made[:3], r"\('b', 1\) missing"),
        ([*made, ("R9", "X1", "b", 1, "db", "COMPLETED", True)], r"\('b', 1\) duplicate"),
    ):
        with pytest.raises(campaigns.GateError, match=why):
            gate(rows)


