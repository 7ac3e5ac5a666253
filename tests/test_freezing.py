"""Registry objects, frozen universes and arms, and striped maps."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quarrymill.operators.freezing import Refused, compute_gap, freeze_arms, freeze_universe
from quarrymill.operators.stripes import PLACE, striped_map
from quarrymill.sources.objects import ObjectError, ObjectStore


def test_objects_are_sealed_and_ids_are_given_once(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "objects"))
    assert store.peek("D") == "D0001" and store.listed("D") == []
    given, errors = [], []

    def write(k):
        try:
            mine = ObjectStore(spark, str(tmp_path / "objects"))
            given.extend((mine.create("D", {"by": k, "n": i, "note": "\xe9"}), k, i) for i in range(6))
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not errors and sorted(g[0] for g in given) == [f"D{i:04d}" for i in range(1, 25)] == store.listed("D")
    assert all((o["by"], o["n"]) == (k, i) for name, k, i in given[:5] for o in [store.get(name)])
    assert not [p for p in (tmp_path / "objects" / "D").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    with pytest.raises(ObjectError, match="never used again"):
        store.create("D", {}, "D0003")
    path = tmp_path / "objects" / "D" / "D0007.json"
    payload = json.loads(path.read_text())
    path.unlink()
    path.write_text(json.dumps(dict(reversed(payload.items()))))
    assert store.get("D0007")["n"] == payload["n"]  # another layout of the same record
    path.write_text(json.dumps(payload | {"n": 99}))
    with pytest.raises(ObjectError, match="changed"):
        store.get("D0007")
    assert store.get("D0007", verify=False)["n"] == 99
    assert {r.id for r in store.audit("D").where("not ok").collect()} == {"D0007"} and store.audit("D").count() == 24
    for bad in ("D1", "x", "D9999"):
        with pytest.raises(ObjectError):
            store.get(bad)
    assert store.create("D", {}, "D0400") == "D0400" and store.create("D", {}) == "D0401"


@pytest.fixture(scope="module")
def evidence(spark):
    candidates = spark.range(300).select(F.col("id").alias("record_id"), F.concat(F.lit("g"), (F.col("id") % 90).cast("string")).alias("group"), F.lit(True).alias("train_eligible"), F.lit(1).alias("split"))
    deep = spark.range(200).select(F.col("id").alias("record_id"), (1000 + F.col("id") % 3).alias("nodes"))
    chosen = spark.range(80).select(F.lit("PRIORITY").alias("arm"), F.col("id").alias("record_id")).unionByName(spark.range(60, 140).select(F.lit("UNIFORM").alias("arm"), F.col("id").alias("record_id")))
    return candidates, deep, chosen


def test_a_universe_is_frozen_alike_whatever_the_order(evidence, spark, tmp_path):
    candidates, deep, chosen = evidence
    one = freeze_universe(candidates, deep, chosen, 5)
    two = freeze_universe(candidates.orderBy(F.desc("record_id")).repartition(3), deep, chosen.unionByName(chosen), 5)
    assert one.identity == two.identity and one.arms.count() == 160
    assert freeze_universe(candidates, deep, chosen, 6).identity["split_policy"] != one.identity["split_policy"]
    assert one.candidates.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert compute_gap(one, 0.01)["nodes"] == {"PRIORITY": sum(1000 + i % 3 for i in range(80)), "UNIFORM": sum(1000 + i % 3 for i in range(60, 140))}
    labelled = candidates.select("record_id", F.lit("x").alias("label"), F.lit("mine").alias("arm"))
    report = freeze_arms(one, labelled, str(tmp_path / "a"), 0.01).collect()
    assert sum(r.rows for r in report) == 160 and {r.arm for r in report} == {"PRIORITY", "UNIFORM"}
    kept = spark.read.parquet(str(tmp_path / "a" / "UNIFORM"))
    assert kept.join(one.candidates.withColumnRenamed("split", "s"), "record_id").where("s <> split").count() == 0 and kept.count() == 80
    everything = freeze_arms(one, labelled, str(tmp_path / "b"), 0.01, all_train=True).collect()
    assert {(r.arm, r.split, r.rows) for r in everything} == {("PRIORITY", "train", 80), ("UNIFORM", "train", 80)}
    with pytest.raises(Exception, match="(?i)exists"):
        freeze_arms(one, labelled, str(tmp_path / "b"), 0.01)


def test_each_refusal(evidence, tmp_path):
    candidates, deep, chosen = evidence
    change = lambda df, column, value, where="record_id = 7": df.withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))
    for why, args in (
        ("no candidates", (candidates.where("false"), deep, chosen)),
        ("unknown groups: 1, the first of them 7", (change(candidates, "group", F.lit("S1:UNKNOWN")), deep, chosen)),
        ("unknown groups: 1", (change(candidates, "group", F.lit(None)), deep, chosen)),
        ("may not be trained", (change(candidates, "train_eligible", F.lit(False)), deep, chosen)),
        ("there twice: 1, the first of them 299", (candidates.unionByName(candidates.where("record_id = 299")), deep, chosen)),
        ("without a recorded selection: ..UNIFORM", (candidates, deep, chosen.where("arm = 'PRIORITY'"))),
        ("outside the candidates", (candidates.where("record_id <> 70"), deep, chosen)),
        ("without measured deep labels: 1, the first of them 7", (candidates, change(deep, "nodes", F.lit(0)), chosen)),
        ("without measured deep labels", (candidates, deep.where("record_id <> 90"), chosen)),
        ("row-matched", (candidates, deep, chosen.where("record_id <> 139"))),
    ):
        with pytest.raises(Refused, match=why):
            freeze_universe(*args, 5)
    whole = freeze_universe(candidates, deep, chosen, 5)
    with pytest.raises(Refused, match="differ in compute"):
        freeze_arms(freeze_universe(candidates, change(deep, "nodes", F.col("nodes") * 2, "record_id < 60"), chosen, 5), candidates, str(tmp_path / "x"), 0.1)
    for labelled in (candidates.where("record_id <> 5"), candidates.unionByName(candidates.where("record_id = 5"))):
        with pytest.raises(Refused, match="don't match"):
            freeze_arms(whole, labelled.select("record_id"), str(tmp_path / "y"), 0.1)
    assert not (tmp_path / "x").exists() and not (tmp_path / "y").exists()


def test_striped_map_equals_the_serial_one(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), F.lit("x").alias("v")).repartition(5)
    work = lambda df: df.select("k", (F.col("k") * 2).alias("twice"), PLACE)
    got = striped_map(rows, ["k"], work, stripes=7)
    assert [tuple(r) for r in got.collect()] == [(k, 2 * k) for k in range(500)]
    seen = striped_map(rows, ["k"], lambda df: df.withColumn("task", F.spark_partition_id()), stripes=7).collect()
    assert len({r.task for r in seen}) > 3 and len({r.task for r in seen[:20]}) > 3
    for bad in (lambda df: df.where("k <> 3"), lambda df: df.unionByName(df.where("k = 3"))):
        with pytest.raises(ValueError, match="500 rows were given"):
            striped_map(rows, ["k"], bad)
    with pytest.raises(ValueError, match="must keep"):
        striped_map(rows, ["k"], lambda df: df.select("k"))
    assert striped_map(rows.where("false"), ["k"], work).collect() == []
