"""Exact dedup by deterministic block naming.

A document, without its ASCII white space, is cut into blocks of a fixed number of characters. Every block gets an
integer name, and adjacent names are named in pairs, level by level, until one integer is left; two documents with the
same number of blocks have the same integer exactly if they are equal.

A name is the block's place in a two-level sort: by bucket (the low bits of a 64-bit hash), then by content within the
bucket. Almost every bucket holds one content, whose place is 0, so its name is known where the block is, without
moving it back. A level's one shuffle brings the distinct contents of each bucket together (with partial aggregation,
so a text that a third of the rows share travels once from each task), sorts them, and lists the buckets with more
than one; only the members of those are given other places by a join. Names depend on content alone, never on
partitioning or order of arrival, so a recomputed task gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import Scratch

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Up to so many crowded buckets are broadcast; a larger list is joined by a shuffle.
BROADCAST_BUCKETS = 2000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def blocks_of(norm: Column, block_chars: int) -> Column:
    """The text's blocks; an empty text has one empty block."""
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _bucket(item: Column, bits: int) -> Column:
    return F.xxhash64(item).bitwiseAND(F.lit((1 << bits) - 1))


def _crowded(items: DataFrame) -> DataFrame:
    """Buckets with several contents, each with its contents in order. items: bucket, item."""
    return items.groupBy("bucket").agg(F.array_sort(F.collect_set("item")).alias("members")).where(F.size("members") > 1)


def _settle(level: DataFrame, items: DataFrame, scratch: Scratch, step: str, bits: int) -> DataFrame:
    """level with the names of crowded buckets replaced by bucket + place * 2**bits. items: rk, at, bucket, item."""
    crowded = scratch.table(_crowded(items.select("bucket", "item")), f"crowded_{step}")
    n = crowded.count()
    if not n:
        return level
    if n <= BROADCAST_BUCKETS:
        crowded = F.broadcast(crowded)
    place = F.array_position("members", F.col("item")) - 1
    moved = (
        items.join(crowded, "bucket")
        .select("rk", "at", (F.col("bucket") + F.shiftleft(place, bits)).alias("name"))
        .groupBy("rk")
        .agg(F.map_from_entries(F.collect_set(F.struct("at", "name"))).alias("moved"))
    )
    names = F.transform("names", lambda x, i: F.coalesce(F.try_element_at("moved", i), x))
    return level.join(moved, "rk", "left").withColumn("names", F.when(F.col("moved").isNull(), F.col("names")).otherwise(names)).drop("moved")


def name_documents(docs: DataFrame, block_chars: int = 2048, name_bits: int = 48, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_chars, digest (sha256 of the normalised text), n_blocks, name.

    (n_blocks, name) is the document's identity.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    norm = normalised(F.col("text"))
    base = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("rk"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), norm.alias("norm"))
    blocks = base.withColumn("blocks", blocks_of(F.col("norm"), block_chars))
    level = blocks.select(
        "rk", "n_chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.size("blocks").alias("n_blocks"), F.transform("blocks", lambda b: _bucket(b, name_bits)).alias("names")
    )
    level = scratch.table(level, "level_0")
    items = blocks.select("rk", F.posexplode("blocks").alias("at", "item")).withColumn("bucket", _bucket(F.col("item"), name_bits))
    level = _settle(level, items, scratch, "0", name_bits)
    done, k = [], 0
    keep = ["rk", "n_chars", "digest", "n_blocks"]
    # The longest document has this many blocks, and each round halves them.
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    while True:
        done.append(level.where(F.size("names") == 1).select(*keep, F.element_at("names", 1).alias("name")))
        if longest == 1:
            break
        k, longest = k + 1, (longest + 1) // 2
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(F.get("names", 2 * i).alias("l"), F.get("names", 2 * i + 1).alias("r")))
        paired = level.where(F.size("names") > 1).select(*keep, pairs.alias("pairs"))
        name = lambda p: F.when(p["r"].isNull(), p["l"]).otherwise(_bucket(p, name_bits))
        level = scratch.table(paired.select(*keep, "pairs", F.transform("pairs", name).alias("names")), f"level_{k}")
        items = level.select("rk", F.posexplode("pairs").alias("at", "item")).where("item.r is not null").withColumn("bucket", _bucket(F.col("item"), name_bits))
        level = _settle(level.drop("pairs"), items, scratch, str(k), name_bits)
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    return named.withColumn("doc_id", F.col("rk.doc_id")).drop("rk")


def exact_dedup(docs: DataFrame, block_chars: int = 2048, name_bits: int = 48, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting ASCII white space. Of equal texts the one with the most code points
    stays, then the one with the smallest doc_id. A null text counts as empty; empty texts form one group. A null
    doc_id sorts before all others. Rows that repeat a doc_id and its text count in group_size and get the same
    answer. An empty table gives an empty result; other columns are ignored.
    """
    named = name_documents(docs.select("doc_id", "text"), block_chars, name_bits, scratch)
    groups = named.groupBy("n_blocks", "name").agg(F.min(F.struct(-F.col("n_chars"), "doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
