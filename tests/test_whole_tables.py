"""Queries over whole tables, where others keep a slice that SQL can follow."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrymill import session
from quarrymill.operators import campaigns, canonical, components, records
from quarrymill.sources import readers

ROWS = [(1, 7, 1.0), (2, 7, 50.0), (2, 8, 3.0), (3, 8, 4.0), (4, 9, 50.0), (5, 9, 50.0), (10, 5, 2.0), (11, 5, 2.0), (12, 6, 50.0), (3, 11, 9.0), (13, 11, 1.0), (14, None, 1.0)]


def union_find(rows):
    up = {g: g for g, *_ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for g, k, _ in rows:
        for other, key, _ in rows:
            if k is not None and key == k:
                a, b = find(g), find(other)
                up[max(a, b)] = min(a, b)
    return {g: find(g) for g in up}


def test_links_of_all_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = union_find(ROWS)
    assert {tuple(r) for r in entry.queries()["components_whole"](spark, str(tmp_path)).collect()} == set(want.items())
    bad = {want[g] for g, *_ in ROWS if g % 10 == 0}
    train = [g for g, *_ in ROWS if g % 10]
    assert tuple(entry.queries()["leakage_clean_whole"](spark, str(tmp_path)).first()) == (len(train), sum(want[g] not in bad for g in train))


def test_rare_keys_are_counted(spark, tmp_path):
    spark.createDataFrame([(1, "One two"), (2, "two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in entry.queries()["coverage_counts_whole"](spark, str(tmp_path)).collect()} == {("one", 1), ("two", 2), ("__positions__", 2)}


def test_components_whose_names_begin_alike_are_told_apart(spark, tmp_path):
    """The hashes of these two customers' members share their first eight digits."""
    rows = [(i, c, p) for c in (21952, 33846) for i, p in enumerate(["1-URGENT", "2-HIGH"])] + [(9, 5, "2-HIGH")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert {tuple(r) for r in entry.queries()["component_names"](spark, str(tmp_path)).collect()} == {(False, 2), (True, 1)}


def test_prefixes_end_between_lines_of_one_number(spark, tmp_path):
    rows = [(1, 1, 40000.0), (1, 1, 30000.0), (1, 1, 45000.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert con.execute(entry.oracle_sql()["prefix_budget"]).fetchall() == [(1, 30000.0)]
    assert tuple(entry.queries()["prefix_budget"](spark, str(tmp_path)).first()) == (1, 30000.0)


def test_keys_of_many_rows_are_not_sent_to_one_task(spark, monkeypatch):
    """A star, a chain and a pair, with every key of over two rows held by many: components stay, and the hub's rows are not shuffled by it."""
    monkeypatch.setattr(components, "MANY_ROWS", 2)
    edges = [(0, i) for i in range(1, 9)] + [(i, i + 1) for i in range(20, 60)] + [(i, 60) for i in range(70, 75)] + [(90, 91), (None, 3), (5, 5)]
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == dict.fromkeys(range(9), 0) | dict.fromkeys([*range(20, 61), *range(70, 75)], 20) | {90: 90, 91: 90}
    rows, entries = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 9), (3, 7), (None, 8)], "k long, v long"), spark.createDataFrame([(1, "a"), (2, "b")], "k long, e string")
    for how in ("inner", "left", "left_anti"):
        joined = components.look_up(rows, entries, "k", how=how)
        assert sorted(map(str, joined.collect())) == sorted(map(str, rows.join(entries, "k", how).collect()))
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_shuffles_of_a_written_table_are_cut_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    before = spark.conf.get(session.PARTITIONS), spark.conf.get(session.COALESCE)
    kept = session.Scratch(spark).table(spark.range(1000).select((F.col("id") * 7).alias("k")).groupBy("k").count().withColumn("part", F.spark_partition_id()), "t", 1000)
    assert kept.select("part").distinct().count() == 10 and kept.count() == 1000
    assert (spark.conf.get(session.PARTITIONS), spark.conf.get(session.COALESCE)) == before


def test_proofs_shuffle_counts_of_ids_and_no_sums_of_hashes(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, 1.0), ("b", None, 4.0)], "arm string, id long, cost double")
    proof = campaigns.prefix_proof(rows, "id", "cost", ["arm"])
    want = rows.groupBy("arm").agg(F.count(F.lit(1)), F.count_distinct("id"), readers.content_hash(F.col("id").cast("string")), F.sum("cost"))
    assert sorted(map(tuple, proof.collect())) == sorted(map(tuple, want.collect()))
    plan = proof._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "sha2" not in plan[plan.rindex("Exchange hashpartitioning"):]
    assert campaigns.prefix_proof(rows.where("false"), "id", "cost").first()["rows"] == 0


def test_manifests_count_groups_beside_the_sums(spark):
    data = spark.createDataFrame([(1, "g", "train"), (2, "g", "train"), (3, "h", "val"), (4, "h", None)], "record_id long, group string, split string")
    made = records.manifest(data)
    assert {(r["split"], r["rows"], r["groups"]) for r in made.collect()} == {("train", 2, 1), ("val", 1, 1), (None, 1, 1)}
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not [x for x in plan.splitlines() if "HashAggregate(keys=" in x and "group#" in x.split("functions=")[0] and "sum(" in x]


def test_arm_report_looks_up_the_arms_rows_alone(spark):
    sf = "/root/testdata/sf0.001"
    report = entry.queries()["arm_report"](spark, sf)
    flags = entry.queries()["arms_topk_uniform_audit"](spark, sf).collect()
    assert {r.arm: r.n for r in report.collect()} == {a: n for a in ("deep", "uniform", "audit") if (n := sum(r[a] for r in flags))}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3


def test_rows_are_tied_before_the_rounds(spark, monkeypatch):
    """Only what several pieces share goes through the rounds, however pieces fall; so it doesn't grow with the rows."""
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(600)}", rng.randrange(2_000) if i % 50 else None) for i in range(1_200)] + [(None, 3), ("a", None)]
    rows += [(f"c{i + d:03}", 5_000 + i) for i in range(300) for d in (0, 1)]
    want = union_find([(g, k, 0) for g, k in rows if g is not None])
    table = spark.createDataFrame(rows, "g string, k int").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for piece, batch in ((1, "30"), (1 << 19, before)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        monkeypatch.setattr(components, "TIED_ROWS", piece)
        scratch = session.Scratch(spark)
        assert {r["g"]: r["component"] for r in canonical.link_groups(table, "g", "k", scratch).collect()} == want
    # One piece a partition: a partition's part of the chain is one tie.
    chain = table.where("g like 'c%'").repartition(4)
    scratch = session.Scratch(spark)
    assert canonical.link_groups(chain, "g", "k", scratch).select("component").distinct().count() == 1
    assert spark.read.parquet(f"{scratch.root}/cc_edges_0").count() < 20
