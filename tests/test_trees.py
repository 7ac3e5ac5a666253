"""Walks over JSON against recursive functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import trees


def differences(a, b, path="", most=None):
    if isinstance(a, dict) and isinstance(b, dict):
        return [p for k in sorted({*a, *b}) for p in differences(a.get(k), b.get(k), f"{path}.{k}" if path else k, most)]
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            return [f"{path}.length({len(a)}!={len(b)})"]
        return [p for i, (x, y) in enumerate(zip(a, b, strict=True)) for p in differences(x, y, f"{path}[{i}]", most)]
    if path in (most or {}) and isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return [] if abs(a - b) <= most[path] else [path]
    return [] if a == b else [path or "<root>"]


def numbers(x, in_list=True):
    if isinstance(x, list):
        return sum(numbers(y) for y in x)
    if isinstance(x, dict):
        return sum(numbers(y, False) for y in x.values())
    return int(in_list and isinstance(x, (int, float)) and not isinstance(x, bool))


def value(rng, depth=0):
    kind = rng.random()
    if depth < 5 and kind < 0.3:
        return {rng.choice(["a", "b", "Nodes", 'q"x', "cost", "pv"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 5 and kind < 0.55:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, 1, 2, -7, 1.0, 2.5, 1e20, "", "x", 'a"1" \\ y 5', "[{", "é"])


def changed(rng, x):
    if isinstance(x, dict) and x and rng.random() < 0.9:
        return {k: changed(rng, v) for k, v in x.items() if rng.random() < 0.9}
    if isinstance(x, list) and x and rng.random() < 0.9:
        return [changed(rng, v) for v in x]
    return value(rng, 3) if rng.random() < 0.3 else x


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(9)
    left = [value(rng) for _ in range(400)]
    return [(x, changed(rng, x)) for x in left]


@pytest.fixture(scope="module")
def texts(spark, pairs):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id long, l string, r string").repartition(3)


def test_parity_equals_recursion(texts, pairs):
    most = {"a": 1.0, "b[0]": float("inf"), "a.b": 2.0}
    got = sorted((r.id, r.path) for r in trees.parity(texts, "l", "r", most).collect())
    assert got == sorted((i, p) for i, (a, b) in enumerate(pairs) for p in differences(a, b, "", most)) and len(got) > 100


def test_parity_of_places_roots_and_missing(spark):
    rows = [(1, '{"t":{"ms":[1,2.5]},"s":"x"}', '{"t":{"ms":[1.4,9]},"s":"y"}'), (2, None, "null"), (3, "{", "{"), (4, "{", "[]"), (5, "9007199254740993", "9007199254740992")]
    both = spark.createDataFrame(rows, "id long, l string, r string")
    got = {(r.id, r.path) for r in trees.parity(both, "l", "r", {"x.t.ms[*]": 0.5}, accepted=["x.s"], root="x").collect()}
    assert got == {(1, "x.t.ms[1]"), (4, "x"), (5, "x")}
    ours = spark.createDataFrame([(1, 100, "[1]"), (1, 200, "[1]")], "id long, budget long, json string")
    theirs = spark.createDataFrame([(1, 100, "[2]"), (2, 100, "[2]")], "id long, budget long, json string")
    found = trees.keyed_parity(ours, theirs, ["id", "budget"], "json", "missing", root="run")
    assert {tuple(r) for r in found.collect()} == {(1, 100, "run[0]"), (1, 200, "missing")}
    assert trees.parity(both.where("id > 9"), "l", "r").count() == 0


def test_list_numbers_equal_recursion(texts, pairs):
    got = {r.id: r.numbers for r in trees.list_numbers(texts, "l", "id").collect()}
    assert got == {i: numbers(a) for i, (a, _) in enumerate(pairs)} and sum(got.values()) > 50


def test_numbers_in_escaped_strings_and_fields_do_not_count(spark):
    rows = [(1, '{"a":"x\\"1\\" y 5","b":2}'), (2, '{"w":[[1,2],[3e4,true]],"n":7,"o":{"p":[{"q":1},"4",5]}}'), (3, None), (4, "{oops"), (5, "7")]
    got = trees.list_numbers(spark.createDataFrame(rows, "id long, j string"), "j", "id").collect()
    assert {tuple(r) for r in got} == {(1, 0), (2, 4), (3, 0), (4, 0), (5, 1)}


def test_leaks_are_found_in_any_case_but_not_below_cost(spark):
    rows = [
        (1, '{"id":"p","cost":{"nodes":1,"wallMs":2},"taxonomy":{"slugs":["nodes","pv"]}}'),
        (2, '{"id":"p","deterministic_geometry":{"x":[{"Nodes":1},{"y":{"bestMove":"e4"}}]}}'),
        (3, '{"id":"p","extra":1,"Cost":{"depth":1},"status":{"note":"\\"pv\\": 1"}}'),
        (4, "not json"),
        (5, None),
    ]
    table = spark.createDataFrame(rows, "rec long, j string")
    got = {tuple(r) for r in trees.leaks(table, "j", "rec").collect()}
    places = "deterministic_geometry.x[0].Nodes", "deterministic_geometry.x[1].y.bestMove"
    assert got == {*((2, "forbidden", p) for p in places), (3, "field", "extra"), (3, "field", "Cost"), (4, "malformed", "")}
    trees.assert_static(table.where("rec in (1, 5)"), "j", "rec")
    with pytest.raises(ValueError, match=r"record 2: forbidden: \['deterministic_geometry.x\[0\].Nodes', 'deterministic_geometry.x\[1\].y.bestMove'\]"):
        trees.assert_static(table, "j", "rec")


def test_walks_stay_in_their_stage(texts):
    plan = trees.walk(texts, "l").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("Exchange") == 1  # the fixture's own
    assert trees.deepest(texts, "l") == texts.agg(F.max(trees.depth_of(F.col("l")))).first()[0] >= 4


def test_parity_walks_both_texts_once_however_deep_they_are(spark):
    deep = lambda x: '{"a":[' * 300 + x + "]}" * 300
    data = [(1, deep("1"), deep("2")), (2, deep("1"), deep("1.0")), (3, '{"a":[1,true]', '{"a":[1,true]}'), (4, '{"n":123456789012345678901}', '{"n":123456789012345678902}'), (5, '{"b":true}', '{"b":1}')]
    found = trees.parity(spark.createDataFrame(data, "id long, l string, r string"), "l", "r")
    assert sorted((r.id, r.path) for r in found.collect()) == [(1, ".".join(["a[0]"] * 300)), (3, "__malformed"), (3, "a"), (4, "n")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
