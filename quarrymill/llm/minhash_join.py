"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with equal shingle sets form a class, and one of each class goes on. Its signature's coordinates are posted
as (coordinate, value) tokens. Linked documents share most of their tokens, so a pair must have at least ``matches``
of them in common; then the pair also meets in the prefix of each, its rarest tokens but matches - 1, and only
prefixes are joined (tokens that no other document has are skipped at once, and so is a document with fewer than
``matches`` others). A text that very many documents share makes frequent tokens, which stand last in that order.

A posting list isn't expanded into all its pairs (see pairing.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.pairing import linked_components, long_lists, shared, spread
from quarrymill.llm.words import WordHashes, frugal, sequences, sliced, small_batches
from quarrymill.session import Scratch


@dataclass(frozen=True)
class Settings:
    words: int = 4
    #: Linked if 100 * |intersection| >= percent * |union|.
    percent: int = 80
    #: With 32 coordinates, a pair at 80 % has fewer than 12 in common with a chance of 3e-8.
    coordinates: int = 32
    matches: int = 12
    #: Rounds of pivots before the rest of the pairs are listed, and how many a document may have on average to list them sooner.
    pivot_rounds: int = 4
    pairs_a_document: int = 4


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of a shorter text, of its whole word sequence; of none, nothing."""
    h = hashes.of((text or "").encode().lower().split())
    return np.unique(sequences(h, min(words, len(h)))) if len(h) else h


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    sig = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        sig = np.minimum(sig, (shingles[start : start + 2048, None] * factors[None, :]).min(0))
    return sig


def _set_key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHashes(), np.random.default_rng(11).integers(0, 2**63, s.coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in sliced(batches, "text", 1_000_000):
            sets = [shingle_set(t, s.words, hashes) for t in batch.column("text").to_pylist()]
            sigs = [signature(x, factors) if len(x) else x for x in sets]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_set_key(x) for x in sets], pa.binary()), long_lists(sigs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _sets(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, "text", 1_000_000):
            sets = [shingle_set(t, s.words, hashes) for t in batch.column("text").to_pylist()]
            own = [_set_key(x) == k for x, k in zip(sets, batch.column("set_key").to_pylist())]
            sets = [x for x, o in zip(sets, own) if o]
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(pa.array(own, pa.bool_())), long_lists(sets)], ["rep", "shingles"])

    return run


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are what ASCII white space divides, with A-Z lower-cased. Texts without words (or null) link with nothing.
    A document is kept if it has the smallest doc_id of its component. Rows that repeat a doc_id and its text get
    equal answers; rows with a null doc_id link with nothing, have a null component and are kept. Other columns are
    ignored, and an empty table gives an empty result.
    """
    s, scratch = settings, scratch or Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = scratch.table(docs.mapInArrow(frugal(_signatures(s)), "doc_id long, n_shingles long, set_key binary, sig array<long>"), "sigs")
    linkable = sigs.where("doc_id is not null and n_shingles > 0")
    # All of a class have one signature, so any of them will do.
    classes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.table(classes, "classes")
    links = _links(docs, classes, s, scratch)
    comp = links.select(F.col("node").alias("rep"), F.col("component")) if links is not None else None
    named = classes.select("set_key", "rep")
    named = named.join(comp, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")) if comp is not None else named.withColumnRenamed("rep", "component_id")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(docs: DataFrame, classes: DataFrame, s: Settings, scratch: Scratch) -> DataFrame | None:
    """(node, component) of class representatives that have links; None if no pair needs a test."""
    tokens = classes.select("rep", "n", F.posexplode("sig").alias("c", "v")).select("rep", "n", F.xxhash64("v", "c").alias("token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(several, "token").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    ranked = ranked.where(F.size("ranked") >= s.matches)
    ranked = scratch.table(ranked.select("rep", "n", F.transform("ranked", lambda x: x["token"]).alias("tokens")), "ranked")
    count = ranked.count()
    if not count:
        return None
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - (s.matches - 1))
    postings = scratch.table(ranked.select(F.col("rep").alias("node"), "n", F.explode(prefix).alias("token")), "postings")
    wanted = docs.join(classes.join(ranked.select("rep"), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "set_key"), "doc_id")
    sets = wanted.select(F.col("doc_id").alias("rep"), "set_key", "text").mapInArrow(frugal(_sets(s)), "rep long, shingles array<long>")
    sets = scratch.table(sets.dropDuplicates(["rep"]).withColumnRenamed("rep", "node"), "sets")
    ta, tb = (ranked.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(ta, "a").join(tb, "b").where(F.size(F.array_intersect("ta", "tb")) >= s.matches).select("a", "b")

    def elements(nodes: DataFrame) -> DataFrame:
        return sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("s"))

    return linked_components(postings, lambda pairs: shared(pairs, sets), elements, lambda pairs: spread(pairs, sets), s.percent, s.pairs_a_document * count, scratch, s.pivot_rounds, likely)
