"""Numbered rows, data sources by name, table functions and providers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import tables
from quarrymill.sources import formats, readers
from quarrymill.streaming import funnel
from quarrymill.streaming.providers import Provider, ProviderError, Registry


@pytest.fixture
def small_splits(spark):
    """Files cut into splits of about a kilobyte."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1000")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_rows_are_numbered_over_splits(spark, tmp_path, small_splits):
    rng, want, whole = random.Random(1), {}, 0
    for name in ("b", "a", "c"):
        lines = [json.dumps({"fen": f"{name}{i} " + "x" * rng.randint(0, 90), "ply": i}) if rng.random() < 0.9 else rng.choice(["", "  ", "{bad"]) for i in range(150)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name != "c" else ""))
        want[name] = [x for x in lines if x.strip()]
    (tmp_path / "d.jsonl").write_text("")
    got = readers.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 10
    rows = got.collect()
    for name, lines in want.items():
        mine = sorted((r.source_row, r.value, r.row) for r in rows if r.source_file.endswith(f"/{name}.jsonl"))
        assert [x[:2] for x in mine] == list(enumerate(lines))
    for name in sorted(want):
        assert sorted(r.row for r in rows if r.source_file.endswith(f"/{name}.jsonl")) == list(range(whole, whole := whole + len(want[name])))
    read = readers.read_rows(spark, str(tmp_path))
    bad = sum(x == "{bad" for lines in want.values() for x in lines)
    assert read.where("_bad is not null").count() == bad > 0 and read.where("ply is null").count() == bad


def test_snapshots_tell_changes(spark, tmp_path):
    rows = [{"game": "g1", "ply": 1}, {"game": "", "ply": 3}, {"game": None, "ply": 4}, {"ply": 2}, {"game": "g1", "ply": 9}]
    def taken(name, rows):  # noqa: E306
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        return readers.snapshot(readers.read_rows(spark, str(tmp_path / name)))
    first, again, swapped = taken("one", rows), taken("two", rows), taken("three", rows[::-1])
    assert first == again and (first["rows"], first["games"]) == (5, 3)
    assert swapped["content_hash"] != first["content_hash"] and len(first["content_hash"]) == 64
    assert taken("none", [])["rows"] == 0


def test_outcomes_keep_a_null_score(spark):
    rows = spark.createDataFrame([(1, True, None, 1.0), (2, True, 0.0, 1.0), (3, False, None, 0.5)], "id int, s boolean, white double, res double")
    got = rows.select("id", readers.outcome(F.lit(None).cast("double"), F.col("res"), F.col("white"), F.col("s")).alias("o")).collect()
    assert {r.id: r.o for r in got} == {1: None, 2: 0.0, 3: 0.5}


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_games_of_any_ranges(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(formats, "READ_BYTES", 50)
    games = [f'[Event "e{i}"]\n[Result "{["1-0", "0-1", "*"][i % 3]}"]\n\n1. e4 {{a [Event of}} e5 2. m{i} ({"(x)" * (i % 3)} y) *\n\n' for i in range(23)]
    (tmp_path / "a.pgn").write_text("".join(games[:20]))
    (tmp_path / "b.pgn").write_bytes("".join(games[20:]).replace("\n", "\r\n").encode())
    (tmp_path / "c.txt").write_text("none")
    formats.register(spark)
    read = spark.read.format("pgn").option("rangebytes", size).load(str(tmp_path))
    got = {r.event: (r.result, r.moves) for r in read.collect()}
    assert got == {f"e{i}": ([1.0, 0.0, None][i % 3], ["e4", "e5", f"m{i}"]) for i in range(23)} and read.count() == 23
    assert {r.event for r in spark.read.format("pgn").load(f"file://{tmp_path}/b.pgn").collect()} == {"e20", "e21", "e22"}


def test_run_folders_load_by_name(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "positions.jsonl").write_text("".join(json.dumps({"id": f"p{i}", "fen": "x" * i}) + "\n" for i in range(40)) + "\n")
    (tmp_path / "tier1.jsonl").write_text('{"id":7,"a":{"b":[1]}}\n{broken\n[1]')
    (tmp_path / "notes.txt").write_text("no stream")
    rows = spark.read.format("funnel_run").option("rangebytes", 100).load(str(tmp_path))
    assert rows.where("stream = 'positions'").select("id").distinct().count() == 40 and rows.count() == 43
    assert {(r.id, r.valid) for r in rows.where("stream = 'tier1'").collect()} == {("7", True), (None, False)}
    only = spark.read.format("funnel_run").option("streams", "tier1").load(str(tmp_path))
    assert only.selectExpr("get_json_object(json, '$.a.b[0]') as b").where("b = '1'").count() == 1
    (tmp_path / "empty").mkdir()
    assert spark.read.format("funnel_run").load(str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="no streams"):
        spark.read.format("funnel_run").option("streams", "tier9").load(str(tmp_path)).count()


def test_table_functions_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, '[Event "x"]\n[Result "1-0"]\n1. e4 (1. d4) e5 2. Nf3 1-0'), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("some_games")
    got = spark.sql("SELECT id, ply, move, result FROM some_games, LATERAL pgn_plies(text)").collect()
    assert [tuple(r) for r in sorted(got)] == [(1, 1, "e4", 1.0), (1, 2, "e5", 1.0), (1, 3, "Nf3", 1.0)]
    fens = ["k7/8/8/8/8/8/R7/q3K3 w - - 0 1", "k7/8/8/8/8/8/R7/q3K3 b - - 0 1", "k7/8/8/8/8/8/R7/q3K2 w", "x", None]
    spark.createDataFrame(list(enumerate(fens)), "id int, fen string").createOrReplaceTempView("some_fens")
    got = spark.sql("SELECT id, square, piece, input FROM some_fens, LATERAL fen_pieces(fen) ORDER BY id, input").collect()
    from quarrymill.functions.positions import active_inputs
    want = {r.id: r.i for r in spark.table("some_fens").where("id < 2").select("id", active_inputs(F.col("fen")).alias("i")).collect()}
    assert {i: [r.input for r in got if r.id == i] for i in (0, 1)} == want and {r.id for r in got} == {0, 1}
    assert ("a8", "k") in {(r.square, r.piece) for r in got}


def test_providers_are_checked(spark, tmp_path):
    twice = lambda df: df.select("id", (F.col("x") * 2).alias("twice"))
    registry = Registry()
    good = registry.register(Provider("double", "deterministic_geometry", "id long, twice long", twice, "v1", needs=("x",)))
    rows = spark.range(4).withColumn("x", F.col("id"))
    funnel.run_stage(rows, str(tmp_path / "out"), registry.get("double", static=True))
    assert {(r.id, r.twice, r.provenance_class, r.producer) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(i, 2 * i, "deterministic_geometry", "v1") for i in range(4)}
    assert registry.register(good) is good
    search = registry.register(Provider("search", "search_derived", "id long, twice int", twice, "v1"))
    with pytest.raises(ProviderError, match="twice: bigint, declared int"):
        funnel.run_stage(rows, str(tmp_path / "bad"), search)
    assert not (tmp_path / "bad").exists()
    for wrong, why in (
        (lambda: registry.get("search", static=True), "no static input"),
        (lambda: registry.get("none"), "no provider"),
        (lambda: registry.register(Provider("double", "outcome", "id long", twice, "v2")), "registered already"),
        (lambda: registry.register(Provider("x", "guess", "id long", twice, "v2")), "no provenance"),
        (lambda: registry.register(Provider("x", "outcome", "k long", twice, "v2")), "lacks id"),
        (lambda: good(spark.range(2)), "needs columns"),
        (lambda: Provider("y", "outcome", "id long, gone string", twice, "v1")(rows), "gone: missing.*twice: not declared"),
    ):
        with pytest.raises(ProviderError, match=why):
            wrong()
