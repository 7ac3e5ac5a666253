"""Streams in any batching against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators.sequences import sessions_by_counter
from quarrymill.streaming import funnel


def batches(spark, tmp_path, rows, schema, cuts):
    """One file for each batch, which the stream reads one at a time."""
    path, edges = str(tmp_path / "in"), [0, *cuts, len(rows)]
    for a, b in zip(edges, edges[1:]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_a_stage_reads_its_batch_and_not_its_results(spark, tmp_path):
    rows = [(i % 70, f"v{i % 70}") for i in range(200)]
    stream = batches(spark, tmp_path, rows, "id long, v string", [50, 100, 150])
    out, checkpoint, seen = str(tmp_path / "out"), str(tmp_path / "cp"), []
    work = lambda df: df.select("id", F.upper("v").alias("w"))
    q = funnel.stream_stage(stream, out, checkpoint, work)
    q.awaitTermination(120)
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [50] * 4 and [s["numRowsUpdated"] for p in progress for s in p["stateOperators"]] == [50, 20, 0, 0]
    assert all(out not in p["sources"][0]["description"] for p in progress) and "RocksDB" in str(progress[-1]["stateOperators"][0]["customMetrics"].keys()).replace("rocksdb", "RocksDB")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted({(i, v.upper()) for i, v in rows})
    spark.createDataFrame([(3, "again"), (900, "new")], "id long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        funnel.stream_stage(stream, out, checkpoint, work).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 71 and got.where("id = 900 and w = 'NEW'").count() == 1


@pytest.mark.parametrize("cuts", [[], [1, 2, 40, 41, 90], [75]])
def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path, cuts):
    rng, rows, at = random.Random(4), [], {}
    for _ in range(120):
        s = rng.choice(["a", "a", "a", "b", None])
        at[s] = at.get(s, -1) + rng.randint(1, 2)
        rows.append((s, at[s], rng.choice([1, 2, 3, 5, 8, None])))
    schema = "source string, row long, counter long"
    funnel.stream_sessions(batches(spark, tmp_path, rows, schema, cuts), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(240)
    want = sessions_by_counter(spark.createDataFrame(rows, schema), "source", ["row"], "counter")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_late_rows_and_replays_move_nothing(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 5, 2), ("a", 3, 9), ("a", 5, 1), ("a", None, 4), ("a", 6, 3), ("b", 0, 7)]
    stream = batches(spark, tmp_path, rows, "source string, row long, counter long", [2])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):
        funnel.stream_sessions(stream, out, checkpoint).awaitTermination(120)
        got = {(r.source, r.row, r.counter): r.session for r in spark.read.parquet(out).collect()}
        assert got == {("a", 0, 1): "g000001", ("a", 5, 2): "g000001", ("a", 3, 9): None, ("a", 5, 1): None, ("a", None, 4): None, ("a", 6, 3): "g000001", ("b", 0, 7): "g000001"}
    # A crash after a batch's writes, before its commit: the batch runs again and gives the same.
    (tmp_path / "cp" / "commits" / "1").unlink()
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    funnel.stream_sessions(stream, out, checkpoint).awaitTermination(120)
    again = spark.read.parquet(out)
    assert again.count() == 7 and {(r.source, r.row, r.counter): r.session for r in again.collect()} == got
