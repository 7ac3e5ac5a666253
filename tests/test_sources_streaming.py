import json

from pyspark.sql import functions as F

from quarrymill.sources import readers
from quarrymill.streaming import funnel


def test_rows_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"fen": "x", "cp": 5, "res": 0.0}\n\nnot json\n')
    rows = readers.read_rows(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r["fen"], r["cp"], r["res"]) for r in rows if r["_bad"] is None] == [("x", 5, 0.0)]
    assert sum(r["_bad"] is not None for r in rows) == 1
    df = spark.createDataFrame([("x", 1)], "fen string, cp int")
    readers.write_rows(df, str(tmp_path / "out"))
    assert [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()] == [{"fen": "x", "cp": 1}]


def test_games(spark, tmp_path):
    (tmp_path / "g.pgn").write_text('[Event "one"]\n[Result "1-0"]\n\n1. e4 e5 {good} 2. Nf3 Nc6 1-0\n\n[Event "two"]\n[Result "1/2-1/2"]\n\n1. d4 d5 1/2-1/2\n')
    games = {r["event"]: r for r in readers.read_games(spark, str(tmp_path / "g.pgn")).collect()}
    assert games["one"]["result"] == 1.0 and games["one"]["moves"] == ["e4", "e5", "Nf3", "Nc6"]
    assert games["two"]["result"] == 0.5 and games["two"]["moves"] == ["d4", "d5"]


def test_info_lines(spark):
    line = "info depth 12 nodes 4000 score cp -31 pv e2e4 e7e5"
    row = spark.createDataFrame([(line,), ("info score mate 3",)], "l string").select(readers.parse_info(F.col("l")).alias("i")).collect()
    assert row[0]["i"]["depth"] == 12 and row[0]["i"]["cp"] == -31 and row[0]["i"]["mate"] is None and row[0]["i"]["pv"] == ["e2e4", "e7e5"]
    assert row[1]["i"]["mate"] == 3 and row[1]["i"]["pv"] is None


def test_stage_resumes(spark, tmp_path):
    path = str(tmp_path / "stage")
    work = lambda df: df.withColumn("twice", F.col("id") * 2)
    funnel.run_stage(spark.range(5), path, work)
    funnel.run_stage(spark.range(8), path, work)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(8))


def test_stream_stage(spark, tmp_path):
    spark.range(6).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        funnel.stream_stage(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
