import public_tokenizers
import pytest
import tiktoken
from test_dedup import brute_exact, brute_near

import corpus_pipeline
from quarrymill.llm import bpe


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, rows):
    root = tmp_path_factory.mktemp("sf")
    item = "what is the sum of all the small parts that the first and the second machine have made"
    toxic = [(200 + i, "you are an idiot and everything about it number " + " ".join(f"n{i}k{k}" for k in range(8))) for i in range(60)]
    fine = [(300 + i, "it is a good thing and everything about it number " + " ".join(f"m{i}k{k}" for k in range(8))) for i in range(90)]
    every = [r for r in rows if r[0] is not None] + toxic + fine + [(500, "Here it is. " + item + ". There it was.")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _ in every], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), every


def test_run_equals_brute_force(spark, tables):
    root, every = tables
    left = [(i, t) for i, t in every if not 200 <= i < 300]
    keep = brute_exact(left)
    left = [(i, t) for i, t in left if keep[i][2]]
    keep = brute_near(left, 5)
    left = [(i, t) for i, t in left if keep[i][2] and i != 500]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(got) == {i for i, _ in left}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert all(got[i]["n_tokens"] == len(library.encode_ordinary(t or "")) for i, t in left)


def test_stages_keep_columns(spark, tables):
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), root).columns == docs.columns


def _stages(spark, root, docs, first, last):
    for _, stage in corpus_pipeline.STAGES[first:last]:
        docs = stage(spark, docs, root)
    return docs


@pytest.fixture(scope="module")
def repeated(spark):
    """doc_ids with several texts, rows that are there twice, a null doc_id, null and empty texts, and a clashing column."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3) + " end"), (4, text(3) + " fin"), (4, text(4)), (5, text(5)), (5, text(5)), (6, None), (6, ""), (7, None), (None, text(6)), (8, text(6))]
    return rows, spark.createDataFrame([(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, __toxic long")


def test_a_row_is_an_id_and_its_text(spark, tables, repeated):
    rows, docs = repeated
    root, _ = tables
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in _stages(spark, root, docs, 1, 3).collect())
    want = {(1, rows[0][1]), (2, rows[2][1]), (3, rows[3][1]), (4, rows[5][1]), (5, rows[6][1]), (6, ""), (0, rows[11][1])}
    assert kept == sorted(want)
    assert {(r["doc_id"], r["text"]) for r in _stages(spark, root, docs, 0, 1).collect()} == set(rows)


def test_the_order_of_rows_and_partitions_decides_nothing(spark, tables, repeated):
    _, docs = repeated
    root, _ = tables
    drop = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    other = docs.orderBy("__toxic", ascending=False).repartition(5)
    assert drop(_stages(spark, root, docs, 0, 4)) == drop(_stages(spark, root, other, 0, 4))
    assert _stages(spark, root, other, 0, 4).columns == docs.columns


def test_empty_table(spark, tables):
    root, _ = tables
    docs = spark.read.parquet(f"{root}/documents.parquet").where("false")
    assert _stages(spark, root, docs, 0, 5).count() == 0
