"""Cleaning a corpus: toxic documents go, then copies, near copies and benchmark leaks; what stays is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns a row of token digests for each document. A null text counts as empty; an empty table
gives an empty result; other columns go along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.bpe import encode_decode
from quarrymill.llm.exact_names import exact_dedup
from quarrymill.llm.ftrl import fit, fold, score
from quarrymill.llm.minhash_join import near_duplicates
from quarrymill.llm.minhash_join import Settings as NearSettings
from quarrymill.llm.queries import token_digests
from quarrymill.llm.template_decontam import decontaminate
from quarrymill.session import Scratch, table

#: Up to so many rows to drop are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _row() -> Column:
    """The hash of doc_id and whole text, by which a row is known: a doc_id with several texts loses only those that must go."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _without(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without those that ``rows`` (row) names by ``_row``."""
    rows = scratch.table(rows.select(F.col("row").alias("__gone")).distinct(), "dropped")
    few = rows.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rows) if few else rows, _row() == rows["__gone"], "left_anti").select(*docs.columns)


def _once(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id and text that ``rows`` (row) names more than once."""
    twice = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row").alias("__twice"))
    single = docs.join(twice, _row() == twice["__twice"], "left_anti").select(*docs.columns)
    return single.unionByName(docs.join(twice, _row() == twice["__twice"], "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. The model doesn't learn from the fold that the operator holds out."""
    column = "__toxic"
    while column in docs.columns:
        column += "_"
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 5) != 0)
    return score(docs, model, column=column).where(F.col(column) < 0.5).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones. Of rows that repeat a doc_id and its text one stays, whatever else is in them."""
    scratch = Scratch(spark)
    named = exact_dedup(docs.select(F.struct("doc_id", _row().alias("row")).alias("doc_id"), "text"), scratch=scratch)
    named = scratch.table(named.select("doc_id.row", "kept"), "named")
    left = _without(docs, named.where("not kept"), scratch)
    return _once(left, named.where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity of 0.8 or more): that of the smallest
    doc_id, before which a null one comes."""
    scratch = Scratch(spark)
    named = near_duplicates(docs.select(_row().alias("doc_id"), "text"), NearSettings(words=5), scratch)
    linked = scratch.table(named.where("not kept").select(F.col("doc_id").alias("row"), "component_id").distinct(), "linked")
    # A component is named by one of its rows.
    members = linked.unionByName(linked.select(F.col("component_id").alias("row"), "component_id").distinct())
    best = members.join(docs.select(_row().alias("row"), "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    return _without(docs, members.join(best.select("best.row"), "row", "left_anti"), scratch)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    scratch = Scratch(spark)
    named = decontaminate(docs.select(_row().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), scratch=scratch)
    return _without(docs, named.where("contaminated").select(F.col("doc_id").alias("row")), scratch)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return token_digests(encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: A learned score, MinHash and a vocabulary file are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next one reads it."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
