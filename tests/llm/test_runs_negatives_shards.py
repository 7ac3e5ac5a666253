"""Operators 11 to 13 against brute force, and their odd inputs."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from quarrymill.llm import minimax_shards, onebit_negatives
from quarrymill.llm.minimax_shards import search, shards
from quarrymill.llm.onebit_negatives import hard_negatives
from quarrymill.llm.periodic_runs import periodic_runs, planted, run_digests, runs_of

# periodic runs


def all_runs(words, power=4, shortest=6):
    found = set()
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(shortest, power * q) and not any(all(words[k] == words[k + d] for k in range(start, end - d)) for d in range(1, q)):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        letters, n, words = "abcdefghijklmnop"[: rng.choice([1, 2, 3, 5, 16])], rng.randint(0, 70), []
        while len(words) < n:
            words += [rng.choice(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 7)
        words = [w.encode() for w in words[:n]]
        for power in (4, 5):
            assert runs_of(words, power) == all_runs(words, power), words


def test_long_texts_of_few_words_are_scanned_in_time():
    rng = random.Random(3)
    assert runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    block = [str(rng.random()).encode() for _ in range(5_000)]
    assert runs_of([b"x", b"y", *block * 5, *block[:7], b"z"]) == [(2, 25_007, 5_000)]
    noise = [rng.choice([b"a", b"b", b"c"]) for _ in range(2_000)]
    assert runs_of(noise) == all_runs(noise)


def expected_runs(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best if best else (None, None, None)), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_run_query_equals_brute_force(spark, docs, rows):
    more = [(i, " ".join(random.Random(i).choice("ab\xe9") + " x" for _ in range(40))) for i in range(200, 330)]
    wide = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = run_digests(periodic_runs(planted(wide)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(expected_runs(i, t) for i, t in rows + more)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want) >= 10


def test_run_operator_on_odd_tables(spark, odd, empty):
    assert periodic_runs(planted(empty)).count() == 0
    got = run_digests(periodic_runs(planted(odd))).collect()
    assert len(got) == odd.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in got)
    named = spark.createDataFrame([("k", "a " * 9, 1, 2)], "doc_id string, text string, runs int, collapsed int")
    row = periodic_runs(named).first()
    assert (row.doc_id, row.collapsed, row.runs[0]["length"]) == ("k", "a", 9)
    with pytest.raises(ValueError):
        periodic_runs(named, power=2)


# hard negatives


def expected_negatives(rows, every=100):
    kept = []
    for vec_id, e, label in rows:
        if label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a in dict.fromkeys((i, label, tuple(v)) for i, label, v in kept if i is not None and i % every == 0):
        scored = [(i, sum(x * y for x, y in zip(v, a[2], strict=True)), label) for i, label, v in kept if len(v) == len(a[2])]
        for p in sorted((r for r in scored if r[2] == a[1] and r[0] != a[0]), key=key)[:5]:
            fits = sorted((r for r in scored if r[2] != a[1] and 80 * p[1] <= 100 * r[1] <= 100 * p[1]), key=key)[:5]
            out += [(a[0], p[0], k + 1, r[0], p[1], r[1]) for k, r in enumerate(fits)]
    return sorted(out, key=str)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((4, dim))
    rows = [(int(i), (middles[i % 4] + spread * rng.standard_normal(dim)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.5] * (dim - 1), 2), (n + 2, [float("nan")] * dim, 3), (n + 3, [float("inf")] * dim, 3), (n + 4, rows[100][1], None)]
    rows += [rows[100], rows[100], rows[101], rows[101], (None, rows[100][1], 4), (None, rows[100][1], 5), (700, [0.0] * dim, 5), (710, [0.5, 1.0], 1), (800, [0.5, 0.9], 1), (900, [], 1), (901, [], 2), (902, [], 1)]
    return rows


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.05), (64, 2.0), (70, 0.5), (3, 0.3)])
def test_negatives_equal_brute_force(spark, dim, spread):
    rows = vectors(dim, 650, dim, spread)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rank", "'x' as code").repartition(5)
    small = onebit_negatives.Settings(rows_a_tile=100, anchors_a_tile=3)
    assert sorted(map(tuple, hard_negatives(table, small).collect()), key=str) == expected_negatives(rows)


def test_intervals_hold_scores_and_rule_pairs_out():
    rng = np.random.default_rng(2)
    for dim, spread in ((64, 0.3), (100, 1.0), (5, 0.1)):
        middles = 200 * rng.standard_normal((5, dim))
        v = np.floor(middles[rng.integers(0, 5, 400)] + 200 * spread * rng.standard_normal((400, dim)))
        code, along, rest = onebit_negatives.coded(v, 7)
        tile = onebit_negatives.Anchors(v[:40], 7, 7)
        least, greatest = tile.bounds(code, along, rest)
        exact = v[:40] @ v.T
        assert (least <= exact).all() and (exact <= greatest).all()
        if spread == 0.3:  # clusters: most pairs can't reach 80 % of an anchor's own square
            assert (greatest < 0.8 * (v[:40] ** 2).sum(axis=1)[:, None]).mean() > 0.5


def test_negatives_without_anchors_or_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(none).collect() == []
    assert hard_negatives(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], none.schema)).collect() == []


# shards


def least_capacity(sizes, shards):
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min((max(best[j], sum(sizes[j:i])) for j in range(i + 1)), default=0) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    places = [rng.randrange(1 << 63) for _ in range(60)] if seed else [rng.randrange(1 << 40) for _ in range(60)]
    sizes = [rng.choice([1, 5, rng.randint(1, 100), 1000 * (seed == 3)]) + 1 for _ in places]
    groups = spark.createDataFrame(list(zip(places, sizes, strict=True)), "place long, bytes long")
    settings, k = minimax_shards.Settings(first_bits=2, more_bits=1), rng.randint(2, 9)
    capacity, cuts = search(groups, k, settings)
    in_order = [s for _, s in sorted(zip(places, sizes, strict=True))]
    assert capacity == least_capacity(in_order, k)
    edges = [-1 << 63, *cuts, 1 << 64]
    assert max(sum(s for p, s in zip(places, sizes, strict=True) if a <= p < b) for a, b in itertools.pairwise(edges)) <= capacity and len(cuts) == k - 1


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_keep_groups_and_are_near_equal(spark, hot):
    rng = random.Random(hot)
    texts = ["w" * rng.randint(0, 90) + str(rng.randrange(900)) for _ in range(1500)] + ["copy " * 5] * hot + [None, "", "\xe9日"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as shard", "2 as place", "3 as size").repartition(4)
    settings = minimax_shards.Settings(shards=10, first_bits=4, more_bits=2, rows_a_bucket=20)
    got = shards(table, settings).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    home = {}
    assert all(home.setdefault(texts[r.doc_id] or "", r.shard) == r.shard for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(10))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(10)]
    alone = home["copy " * 5] if hot else None
    rest = [s for k, s in enumerate(sizes) if k != alone]
    assert max(rest) - min(rest) <= 0.05 * sum(rest) / len(rest) + 2 * 120
    if hot:
        assert alone == 0 and sizes[0] == hot * 41
    again = shards(table.repartition(7, "text"), settings).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_shards_of_odd_tables(spark, odd, empty):
    assert shards(empty).count() == 0
    got = shards(odd).collect()
    assert len(got) == odd.count() and {r.shard for r in got} <= set(range(40))
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})
    one = shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), minimax_shards.Settings(shards=1)).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
