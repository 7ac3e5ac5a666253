"""From a source file to a finding: snapshot, records, labels, universe, arms, runs, study gate, contrast and finding, all sealed."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions.positions import active_inputs
from quarrymill.operators import campaigns, labels, models, records, stats
from quarrymill.operators.freezing import freeze_arms, freeze_universe
from quarrymill.sources import readers
from quarrymill.sources.objects import ObjectStore
from quarrymill.streaming import funnel
from quarrymill.streaming.providers import Provider


def test_source_to_finding(spark, tmp_path):
    rng = random.Random(11)
    lines = []
    for game in range(60):
        for ply in range(4):
            queens, rooks = rng.randint(0, 4), rng.randint(0, 4)
            fen = f"k7/{'q' * queens + str(8 - queens)}/8/8/{'R' * rooks + str(8 - rooks)}/8/{ply + 1}P{6 - ply}/{7 if game % 2 else '6N'}{'K'} w - - 0 {game + 1}"
            lines.append({"game": f"g{game}", "ply": ply, "fen": fen, "cp": 500 * rooks - 900 * queens, "res": 1.0})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "positions.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    store = ObjectStore(spark, str(tmp_path / "objects"))

    # S: the import and its snapshot; the run's folder is pinned to it.
    rows = readers.read_rows(spark, str(tmp_path / "in"))
    shot = readers.snapshot(rows)
    assert (shot["rows"], shot["games"]) == (240, 60)
    source = store.create("S", shot)
    assert funnel.pin_identity(spark, str(tmp_path / "run"), {"source": source, **shot})

    # N: canonical records; repeats of a position go, and their games are one group.
    kept = records.normalized(rows, "source_file", "source_row", F.concat(F.lit("rec_"), F.substring(F.sha2("fen", 256), 1, 20)), "game", F.col("fen").isNotNull())
    kept.write.parquet(str(tmp_path / "records"))
    kept = spark.read.parquet(str(tmp_path / "records"))

    # Labels by a checked provider, resumed without effect, and registered.
    fens = rows.select(F.concat(F.lit("rec_"), F.substring(F.sha2("fen", 256), 1, 20)).alias("record_id"), "fen", "cp").dropDuplicates(["record_id"])
    search = Provider("search", "search_derived", "record_id string, cp int, nodes long", lambda df: df.select("record_id", "cp", (1000 + F.pmod(F.xxhash64("record_id"), F.lit(5))).alias("nodes")), "v1", "record_id", ("cp",))
    for _ in range(2):
        funnel.run_stage(fens, str(tmp_path / "run" / "tier3"), search, "record_id")
    deep = spark.read.parquet(str(tmp_path / "run" / "tier3"))
    assert deep.count() == kept.count()
    records.register(deep, kept, "record_id", ["record_id", "provider"])
    reference = labels.set_references(deep.select(F.lit("L1").alias("set"), F.lit("cp").alias("family"), F.col("provenance_class").alias("authority"), "producer", F.lit(1).alias("registry_version"), F.lit("p1").alias("policy_hash"), "record_id"), "set", "record_id").first()
    assert reference.rows == kept.count() and reference.policy_hash == "p1"

    # D: the universe and both arms, with splits by component.
    half = kept.select("record_id").orderBy("record_id").limit(160)
    first, second = half.limit(80).withColumn("arm", F.lit("PRIORITY")), half.subtract(half.limit(80)).withColumn("arm", F.lit("UNIFORM"))
    universe = freeze_universe(kept.select("record_id", "group", F.lit(True).alias("train_eligible")), deep, first.select("arm", "record_id").unionByName(second.select("arm", "record_id")), 3)
    report = freeze_arms(universe, deep.select("record_id", "cp"), str(tmp_path / "datasets"), 0.1, all_train=True)
    datasets = {r.arm: store.create("D", {"rows": r.rows, "ids_hash": r.ids_hash, "universe": universe.identity["universe"], "source": source}) for r in report.orderBy("arm").collect()}

    # R: a network for each arm and seed, evaluated on records of no arm.
    parts = [spark.read.parquet(f"{tmp_path}/datasets/{arm}").withColumn("arm", F.lit(arm)) for arm in datasets]
    inputs = F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: F.array_contains("on", i).cast("double"))
    encoded = fens.select("record_id", active_inputs(F.col("fen")).alias("on")).select("record_id", inputs.alias("x"))
    train = parts[0].unionByName(parts[1]).join(encoded, "record_id").withColumn("target", models.target_space(F.col("cp").cast("double"), F.lit(None).cast("double"), 400.0, 1.0)).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    nets = models.train_networks(train, ["arm"], "seed", "x", "target", "record_id", 4, epochs=40, batch=16, slope=1.0)
    exam = kept.join(half, "record_id", "left_anti").join(fens.select("record_id", "cp"), "record_id").join(encoded, "record_id")
    scored = exam.crossJoin(nets.select("arm", "seed", "into", "shift", "out", "bias")).withColumn("score", models.predict_network(F.col("x"), F.col("into"), F.col("shift"), F.col("out"), F.col("bias")))
    scored = scored.withColumn("predicted", 1 / (1 + F.exp(-F.col("score")))).withColumn("actual", models.target_space(F.col("cp").cast("double"), F.lit(None).cast("double"), 400.0, 1.0))
    losses = models.evaluate(scored, ["arm", "seed"], "predicted", "actual", 0.0).collect()
    runs = [(store.create("R", {"dataset": datasets[r.arm], "seed": r.seed, "loss": r.loss}), "X1", r.arm, r.seed, datasets[r.arm], "COMPLETED", False, r.loss) for r in losses]
    assert len(runs) == 4 and all(np.isfinite(r[-1]) and r[-1] < 0.25 for r in runs)

    # X and F: the whole matrix with every contract kept, then the paired contrast and its finding.
    made = spark.createDataFrame(runs, "run string, experiment string, arm string, seed int, dataset string, status string, retry boolean, loss double")
    design = spark.createDataFrame([("X1", a, s, d) for a, d in datasets.items() for s in (0, 1)], "experiment string, arm string, seed int, dataset string")
    assert campaigns.study_gate(made, design, ["arm", "seed"], "run", "experiment", ["dataset"], "status", "retry") == "X1"
    contrast = stats.paired(made.withColumn("width", F.lit(4)), ["width", "seed"], "arm", "UNIFORM", "PRIORITY", "loss", complete=design.select(F.lit(4).alias("width"), "seed").distinct())
    found = stats.mean_interval(contrast, ["width"], F.col("d")).withColumn("finding", campaigns.finding(F.col("low"), F.col("high"), F.col("mean"), 0.0)).first()
    assert found.n == 2 and found.finding in ("SUPPORTED", "REJECTED", "INCONCLUSIVE")
    finding = store.create("F", {"experiment": "X1", "finding": found.finding, "runs": [r[0] for r in runs]})

    # Everything is still as it was sealed, and a run that goes on under another source is refused.
    assert all(store.audit(kind).where("not ok").isEmpty() for kind in "SDRF") and store.get(finding)["runs"] == store.listed("R")
    with pytest.raises(funnel.IdentityError, match="rows"):
        funnel.pin_identity(spark, str(tmp_path / "run"), {"source": source, **shot, "rows": 241})
