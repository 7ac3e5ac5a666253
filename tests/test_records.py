"""The write path, selections without a single task, sessions over partitions, and rules that refuse."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import positions
from quarrymill.operators import campaigns, funnel, records, selection, sequences, stacks, stats
from quarrymill.sources import readers
from quarrymill.streaming import funnel as stages


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in list(root)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), i, f"g{rng.randrange(40)}" if rng.random() < 0.9 else None, f"t{rng.randrange(120)}") for i in range(200)]
    return data, spark.createDataFrame(data, "source string, row long, game string, text string")


def normalized(df):
    return records.normalized(df, "source", "row", F.col("text"), "game", F.col("text") != "t7")


def test_normalized_groups_are_components(rows):
    data, df = rows
    got = {r["record_id"]: r for r in normalized(df).collect()}
    games = union_find([(f"{s}:{g}", "text " + t) for s, _, g, t in data if g and t != "t7"])
    first = {}
    for s, i, g, t in sorted(data, key=lambda r: (r[0], r[1])):
        if t != "t7":
            first.setdefault(t, (s, i, g))
    assert set(got) == set(first)
    by_root = {}
    for t, (s, i, g) in first.items():
        r = got[t]
        assert (r["source"], r["row"], r["group_unknown"]) == (s, i, g is None)
        if g is None:
            assert r["group"] == f"{s}:UNKNOWN"
        else:
            by_root.setdefault(games[f"{s}:{g}"], set()).add(r["group"])
    assert all(len(names) == 1 for names in by_root.values())
    assert len({next(iter(n)) for n in by_root.values()}) == len(by_root)
    members = {}
    for s, _, g, t in data:
        if g and t != "t7":
            members.setdefault(games[f"{s}:{g}"], set()).add(f"{s}:{g}")
    for root, names in by_root.items():
        name = next(iter(names))
        assert name.startswith("xc") and len(name) == 10 if len(members[root]) > 1 else name in members[root]


def test_freeze_refuses_or_shares_unknown_groups_and_verifies(rows):
    _, df = rows
    kept = normalized(df)
    with pytest.raises(ValueError, match="unknown groups"):
        records.frozen(kept, 1)
    with pytest.raises(ValueError, match="fractions"):
        records.frozen(kept, 1, 0.9, 0.2, "shared")
    data = records.frozen(kept, 1, unknown="shared").cache()
    assert data.groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    recorded = records.manifest(data)
    assert records.verification(data, recorded).count() == 0
    one = data.select("record_id").orderBy("record_id").first()[0]
    changed = data.withColumn("row", F.when(F.col("record_id") == one, -1).otherwise(F.col("row")))
    assert [r["what"] for r in records.verification(changed, recorded).collect()] == ["rows_hash"]
    other = data.withColumn("split", F.when(F.col("record_id") == one, F.when(F.col("split") == "train", "val").otherwise("train")).otherwise(F.col("split")))
    assert {"ids_hash", "rows_hash"} <= {r["what"] for r in records.verification(other, recorded).collect()}
    assert any(r["what"].endswith("in several") for r in records.verification(data.unionByName(data.withColumn("split", F.lit("x"))), recorded).collect())


def test_registering_refuses(spark):
    known = spark.createDataFrame([(1,), (2,)], "id long")
    good = spark.createDataFrame([(1, "f"), (2, "f"), (2, "g")], "id long, family string")
    assert records.register(good, known, "id", ["id", "family"]).count() == 3
    with pytest.raises(ValueError, match="unknown records"):
        records.register(good.unionByName(spark.createDataFrame([(9, "f")], good.schema)), known, "id", ["id", "family"])
    with pytest.raises(ValueError, match="twice"):
        records.register(good.unionByName(good), known, "id", ["id", "family"])
    sizes = spark.createDataFrame([("a", 3, 3), ("b", 3, 2)], "arm string, raw long, joined long")
    with pytest.raises(Exception, match="arm sizes differ"):
        records.row_matched(sizes, "raw", "joined").collect()
    with pytest.raises(Exception, match="no record 9"):
        stacks.by_exact_ids(known, "id", spark.createDataFrame([(1, 0), (9, 1)], "id long, position long")).collect()


def test_smallest_is_a_sorted_prefix(spark, monkeypatch):
    monkeypatch.setattr(stacks, "EDGE_ROWS", 3)
    df = spark.range(3000).repartition(7)
    order = F.sha2((F.col("id") % 1500).cast("string"), 256)
    want = [r["id"] for r in df.orderBy(order, "id").collect()]
    for n in (0, 1, 2, 777, 2999, 3000, 5000):
        assert sorted(r["id"] for r in stacks.smallest(df, order, "id", n).collect()) == sorted(want[:n])
    assert stacks.smallest(df.where("false"), order, "id", 5).count() == 0


def test_sessions_go_on_over_partitions(spark):
    rng = random.Random(4)
    data = [(None if i % 50 == 0 else "big" if rng.random() < 0.6 else f"s{rng.randrange(30)}", i, rng.randrange(6), "own" if rng.random() < 0.05 else None) for i in range(2000)]
    df = spark.createDataFrame(data, "source string, row long, counter int, game string").repartition(9)
    got = {r["row"]: r["session"] for r in sequences.sessions_by_counter(df, "source", ["row"], "counter", "game").collect()}
    state = {}
    for s, i, c, g in data:
        if g is not None:
            assert got[i] == g
            continue
        n, before = state.get(s, (0, None))
        n += before is None or c <= before
        state[s] = n, c
        assert got[i] == f"g{n:06d}"


def test_t_at_all_degrees_of_freedom():
    # The chance between -t and t, by Simpson's rule over the density.
    for df, one in ((1, False), (2, False), (7, True), (30, False), (399, True), (399, False), (100_000, False)):
        t, n = stats.t_critical(df, one_sided=one), 20_000
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        f = [(1 + (t * k / n) ** 2 / df) ** (-(df + 1) / 2) * (1 if k in (0, n) else 4 if k % 2 else 2) for k in range(n + 1)]
        assert math.isclose(2 * scale * sum(f) * t / n / 3, 0.9 if one else 0.95, abs_tol=1e-9)
    assert abs(stats.t_critical(4999) - stats.t_critical(5000)) < 1e-7


def test_decisions_need_every_width(spark):
    c = spark.createDataFrame([(1, -2.0, -1.0), (2, -3.0, -0.5)], "width int, low double, high double")
    assert stats.decision(c, [1, 2]).first()["decision"] == "SUPPORTED"
    assert stats.noninferiority(c, 1.0, [1, 2]).first()["verdict"] == "NONINFERIOR"
    for rule in (lambda: stats.decision(c, [1, 2, 4]), lambda: stats.noninferiority(c, 1.0, [4]), lambda: stats.decision(c.where("false"), [1])):
        with pytest.raises(Exception, match="no interval for width"):
            rule().collect()


def test_positions_with_missing_fields(spark):
    fens = ["nnbbk3/8/8/8/8/8/8/NNBBK3 w - -", "garbage", "", None, "k7/8/8/8/8/8/8/K7 b - - 0 x", "k7/8/8/8/8/8/8/K7 b - - 0 5"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string")
    got = [tuple(r) for r in df.select("i", positions.ply(F.col("fen")), positions.side(F.col("fen")), positions.phase(F.col("fen")), F.size(positions.active_inputs(F.col("fen")))).orderBy("i").collect()]
    assert got[0][1:4] == (0, "w", "middlegame") and got[1][1:3] == (0, "w") and got[3][1] is None and got[4][1] == 1 and got[5][1] == 9


def test_games_with_variations_comments_and_carriage_returns(spark, tmp_path):
    text = '[Event "a"]\r\n[Result "1-0"]\r\n\r\n1. e4 {[%clk 0:01]\r\n} (1. d4 d5 (1... Nf6 2. c4)) e5 2. Nf3 1-0\r\n\r\n[Event "b"]\n[Result "*"]\n\n1. c4 ; note (\n c5 *\n'
    (tmp_path / "x.pgn").write_text(text)
    got = {r["event"]: (r["result"], r["moves"]) for r in readers.read_games(spark, str(tmp_path)).collect()}
    assert got == {"a": (1.0, ["e4", "e5", "Nf3"]), "b": (None, ["c4", "c5"])}


def test_stages_do_each_key_once_and_report_faults(spark, tmp_path):
    path, work = str(tmp_path / "out"), lambda df: df.withColumn("n", F.lit(1))
    df = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    stages.run_stage(df, path, work)
    stages.run_stage(df.unionByName(spark.createDataFrame([(3,)], "id long")), path, work)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        stages.done_rows(spark, str(tmp_path / "bad")).count()


def test_engine_lines(spark):
    line = "info depth 9 seldepth 12 multipv 1 score cp -31 nodes 4096 time 17 hashfull 3 pv e2e4 e7e5"
    df = spark.createDataFrame([(line,), ("bestmove e2e4 ponder e7e5",), ("bestmove (none)",)], "l string")
    r = df.select(readers.parse_info(F.col("l")).alias("i"), readers.best_move(F.col("l")).alias("b")).collect()
    assert r[0]["i"].asDict() == {"depth": 9, "seldepth": 12, "multipv": 1, "nodes": 4096, "time": 17, "hashfull": 3, "cp": -31, "mate": None, "pv": ["e2e4", "e7e5"]}
    assert [x["b"] for x in r] == [None, "e2e4", None]


def test_lines_are_written_once_with_their_hash(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "b long, a string")
    n, h = readers.write_lines(df, str(tmp_path / "l"))
    assert n == 2 and len(h) == 64 and h == readers.write_lines(df.orderBy("b"), str(tmp_path / "m"))[1]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"a":"x","b":1}', '{"a":null,"b":2}']
    with pytest.raises(Exception):
        readers.write_lines(df, str(tmp_path / "l"))
    files = readers.merged_files(spark.createDataFrame([("p", 3, "s"), ("q", 3, "s"), ("r", 1, "t")], "path string, bytes long, sha256 string"))
    assert {r["sha256"]: (r["path"], r["places"]) for r in files.collect()} == {"s": ("p", 2), "t": ("r", 1)}


def test_schemas_are_walked_for_forbidden_keys(spark):
    schema = spark.createDataFrame([], "id long, a struct<b: array<struct<stockfish: int>>, cost: struct<stockfish: int>>, stockfish string, m map<string, struct<x: int>>").schema
    assert selection.forbidden_keys(schema, ["stockfish", "x"]) == ["a.b.stockfish", "stockfish", "m.x"]


def test_bought_prefix_stops_at_its_target(spark):
    chunks = [spark.createDataFrame([(k,)], "k int") for k in range(5)]
    bought = []
    have, total = campaigns.bought_prefix(chunks, lambda c: bought.append(1) or c.withColumn("cost", F.lit(2.0)), "cost", 5.0)
    assert (len(have), total, len(bought)) == (3, 6.0, 3)


def test_object_numbers(spark):
    objects = spark.createDataFrame([("D2",), ("D10",), ("M3",), ("D1x",)], "id string")
    assert funnel.next_number(objects, "id", "D") == 11 and funnel.next_number(objects, "id", "D", [40]) == 41 and funnel.next_number(objects, "id", "Q") == 1


def test_runs_and_pools_are_read_and_written(spark, tmp_path):
    (tmp_path / "positions.jsonl").write_text('{"id": "a", "fen": "x"}\n\n{"id": "b", "fen": "y"}\n')
    run = funnel.read_run(spark, str(tmp_path), {s: "id string, fen string" for s in funnel.STREAMS})
    assert run["positions"].where("id is not null").count() == 2 and run["tier4"].count() == 0
    kept = records.snapshot(run["positions"], run["tier0"], str(tmp_path / "pool"))
    assert {r["table"]: r["rows"] for r in kept.collect()}["games"] == 0
    with pytest.raises(Exception):
        records.snapshot(run["positions"], run["tier0"], str(tmp_path / "pool"))


def test_rebuilding_refuses_to_repeat(rows):
    _, df = rows
    kept = normalized(df).where("not group_unknown")
    before = records.frozen(kept, 5)
    with pytest.raises(ValueError, match="the same"):
        records.rebuilt(kept, F.lit(True), 5, before)
    assert records.rebuilt(kept, F.col("source") == "a", 5, before).where("source <> 'a'").count() == 0
