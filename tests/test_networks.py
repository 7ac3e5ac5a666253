"""Networks: gradients, independence of the heads' draws, batches, learning, and stored weights."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import models


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = models.Network(5, 4, 2, 1)
    net.weights["shift"] += 0.5
    x, y, aux = rng.normal(0, 1, (7, 5)), rng.normal(0, 1, 7), rng.normal(0, 1, (7, 2))
    for k, g in net.gradients(x, y, aux, 0.3).items():
        flat = net.weights[k].reshape(-1)
        for i in range(flat.size):
            kept = flat[i]
            flat[i] = kept + 1e-6
            up = net.loss(x, y, aux, 0.3)
            flat[i] = kept - 1e-6
            down = net.loss(x, y, aux, 0.3)
            flat[i] = kept
            assert abs((up - down) / 2e-6 - np.reshape(g, -1)[i]) < 1e-5


def test_heads_change_no_start_and_batches_walk_without_repeats():
    a, b = models.Network(6, 3, 0, 9), models.Network(6, 3, 4, 9)
    assert all((a.weights[k] == b.weights[k]).all() for k in models.Network.SHARED)
    seen = [x.tolist() for x in itertools.islice(models.batches(10, 4, 5), 4)]
    assert all(len(set(seen[k] + seen[k + 1])) == 8 for k in (0, 2)) and seen != [x.tolist() for x in itertools.islice(models.batches(10, 4, 6), 4)]
    assert len(next(models.batches(3, 100, 0))) == 3


@pytest.mark.parametrize("optimizer", ["adam", "sgd"])
def test_networks_learn_and_are_asked_from_their_weights(spark, optimizer):
    rng = np.random.default_rng(1)
    data = [(i, i % 2, [float(v) for v in x], float(abs(x[0]) + x[1])) for i, x in enumerate(rng.uniform(-1, 1, (400, 2)))] + [(1000, 0, [0.0, 0.0], None)]
    rows = spark.createDataFrame(data, "id long, seed int, x array<double>, y double")
    nets = models.train_networks(rows, [], "seed", "x", "y", "id", 16, updates=1500, batch=32, rate=0.02 if optimizer == "adam" else 0.2, optimizer=optimizer).cache()
    got = {r["seed"]: r for r in nets.collect()}
    assert {r["rows"] for r in got.values()} == {200} and all(r["loss"] < 0.02 for r in got.values())
    scored = rows.join(nets, "seed").where("y is not null").select("seed", "y", models.predict_network(F.col("x"), F.col("into"), F.col("shift"), F.col("out"), F.col("bias")).alias("p"))
    again = {r["seed"]: r["m"] for r in scored.groupBy("seed").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("m")).collect()}
    assert all(abs(again[s] - got[s]["loss"]) < 1e-9 for s in got)
    with pytest.raises(Exception, match="no y"):
        models.encoded(rows, "y", "raise").collect()
    assert models.encoded(rows, "y").count() == 400


@pytest.mark.parametrize("slope", [None, 1.7])
def test_gradients_in_target_space_with_bucket_heads(slope):
    rng = np.random.default_rng(8)
    net = models.Network(5, 4, 2, 1, families=3, classes=4, slope=slope)
    net.weights["shift"] += 0.5
    x, y, aux, buckets = rng.normal(0, 1, (7, 5)), rng.uniform(0, 1, 7), rng.normal(0, 1, (7, 2)), rng.integers(0, 4, (7, 3))
    found = net.gradients(x, y, aux, 0.3, buckets)
    assert set(found) == set(net.weights)
    for k, g in found.items():
        flat = net.weights[k].reshape(-1)
        for i in range(flat.size):
            kept = flat[i]
            flat[i] = kept + 1e-6
            up = net.loss(x, y, aux, 0.3, buckets)
            flat[i] = kept - 1e-6
            down = net.loss(x, y, aux, 0.3, buckets)
            flat[i] = kept
            assert abs((up - down) / 2e-6 - np.reshape(g, -1)[i]) < 1e-5


def test_targets_are_expected_results(spark):
    rows = spark.createDataFrame([(0.0, None), (256.0, 1.0), (None, 1.0)], "s double, r double")
    got = [r[0] for r in rows.select(models.target_space(F.col("s"), F.col("r"), 256.0, 0.75)).collect()]
    assert got[0] == 0.5 and abs(got[1] - (0.75 / (1 + np.exp(-1)) + 0.25)) < 1e-12 and got[2] is None


def test_norms_and_weight_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).tolist(), float(rng.uniform(0, 1)) if i % 10 else None, rng.normal(0, 1, 2).tolist(), rng.integers(0, 3, 2).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, x array<double>, y double, aux array<double>, b array<int>").repartition(4)
    norms = models.gradient_norms(table, [0, 3], "x", "y", "id", "aux", 5, batch=16, most_batches=3, slope=1.5, buckets="b", classes=3)
    got, want = {(r.seed, r.batch): r for r in norms.collect()}, {}
    import hashlib
    for seed in (0, 3):
        order = sorted((r for r in rows if r[2] is not None), key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
        for k in range(3):
            part = order[16 * k : 16 * k + 16]
            x, y, aux, b = (np.array([r[j] for r in part]) for j in (1, 2, 3, 4))
            net = models.Network(6, 5, 2, seed, 2, 3, 1.5)
            bare = models.Network(6, 5, 0, seed, slope=1.5)
            score = bare.gradients(x, y, aux, 0)["into"]
            want[seed, k] = np.linalg.norm(score), np.linalg.norm(net.gradients(x, y, aux, 1.0, b)["into"] - score)
    assert set(got) == set(want) and all(np.allclose((got[k].score_norm, got[k].aux_norm), v) and got[k].rows == 16 for k, v in want.items())
    ratio = np.mean([np.mean([want[s, k][1] for k in range(3)]) / np.mean([want[s, k][0] for k in range(3)]) for s in (0, 3)])
    row = models.calibrated_weight(norms, 0.25).first()
    assert abs(row.ratio - ratio) < 1e-9 and row.weight == float(f"{0.25 / ratio:.6g}") and abs(row.realised - 0.25) < 1e-5


def test_networks_of_expected_results_are_learnt_and_reloaded(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 4))
    rows = [(i, 0, v.tolist(), float(1 / (1 + np.exp(-2 * v[0]))), [int(v[1] > 0)]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "id long, seed int, x array<double>, y double, b array<int>")
    row = models.train_networks(table, [], "seed", "x", "y", "id", 8, None, 0.1, epochs=120, batch=32, slope=1.0, buckets="b", classes=2).first()
    assert row.loss < 0.01 and "choice" not in row.asDict()
    net = models.Network.stored(row.asDict(), slope=1.0)
    assert abs(np.mean((net.expected(net.score(x)) - np.array([r[3] for r in rows])) ** 2) - row.loss) < 1e-9
