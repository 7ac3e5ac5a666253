"""Sharding by a minimax contiguous partition of groups that stay whole.

Groups of equal texts are put in a fixed order, by the hash of their text, and cut into contiguous shards such that the
largest shard is as small as it can be: the smallest capacity is found by binary search, and each candidate is checked
greedily, by filling one shard after the other as far as it goes. A group larger than the fair share of what is left
would dictate that capacity, so it comes first in the order and takes a shard of its own. Among the cuts that keep the
capacity, those nearest to equal sizes are taken.

The sizes of all groups are never in one place. The driver has totals of at most 2^16 stretches of the order; a search
in which stretches may be cut anywhere gives a lower bound, one in which they stay whole an upper bound, and only
stretches where a cut can fall between the two are divided further, by one aggregation for all of them, until cuts
fall between single groups. Slots within a shard are numbered by buckets of documents, with the sizes of the buckets
before added, so no task has a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import Scratch, range_partitions

#: Bits of a group's place in the order.
BITS = 63


@dataclass(frozen=True)
class Settings:
    shards: int = 40
    #: Besides its text a document counts for so many bytes.
    overhead: int = 16
    #: The order is first seen in 2^first_bits stretches, and a stretch is divided into 2^more_bits.
    first_bits: int = 16
    more_bits: int = 5
    rows_a_bucket: int = 50_000


class Stretches:
    """Totals of consecutive stretches of the order: start, bits of the prefix that its groups share, bytes, groups."""

    def __init__(self, start: np.ndarray, bits: np.ndarray, size: np.ndarray, groups: np.ndarray):
        by = np.argsort(start, kind="stable")
        self.start, self.bits, self.size, self.groups = start[by], bits[by], size[by], groups[by]
        self.open = (self.groups > 1) & (self.bits < BITS)
        self.before = np.concatenate([[0], np.cumsum(self.size)])

    def whole(self, capacity: int, shards: int) -> list[int]:
        """Stretches before the end of each shard when shards are filled greedily with whole stretches."""
        ends, at = [], 0
        for _ in range(shards):
            at = int(np.searchsorted(self.before, self.before[at] + capacity, "right")) - 1
            ends.append(at)
        return ends

    def fluid(self, capacity: int, shards: int) -> list[int]:
        """Bytes before the end of each shard when open stretches may be cut anywhere."""
        ends, x, total = [], 0, int(self.before[-1])
        for _ in range(shards):
            target = min(x + capacity, total)
            k = int(np.searchsorted(self.before, target, "right")) - 1
            x = target if k >= len(self.size) or self.open[k] else max(x, int(self.before[k]))
            ends.append(x)
        return ends

    def least(self, fits, low: int, high: int) -> int:
        """The smallest capacity that fits, between low and high, which does."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fits(middle) else (middle + 1, high)
        return low

    def bounds(self, shards: int) -> tuple[int, int]:
        """The smallest capacity lies between these."""
        total = int(self.before[-1])
        fair = -(-total // shards)
        low = self.least(lambda c: self.fluid(c, shards)[-1] == total, fair, total)
        return low, self.least(lambda c: self.whole(c, shards)[-1] == len(self.size), low, total)

    def unsettled(self, low: int, high: int, shards: int) -> np.ndarray:
        """Open stretches in which a greedy cut can fall for a capacity between low and high."""
        heavy = self.open & (self.size > low // 8)
        if heavy.any():
            return np.flatnonzero(heavy)
        chosen = np.zeros(len(self.size), bool)
        for near, far in zip(self.whole(low, shards), self.fluid(high, shards), strict=True):
            chosen[near : int(np.searchsorted(self.before, far, "left"))] = True
        return np.flatnonzero(chosen & self.open)

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Stretches before the end of each shard but the last: no shard over the capacity, sizes as near as can be."""
        total, latest, at = int(self.before[-1]), [], len(self.size)
        for _ in range(shards):  # the earliest ends that leave the shards after them enough room
            at = int(np.searchsorted(self.before, self.before[at] - capacity, "left"))
            latest.append(at)
        earliest, ends, at = latest[::-1][1:], [], 0
        for k, need in enumerate(earliest):
            ideal = total * (k + 1) / shards
            near = int(np.searchsorted(self.before, ideal, "left"))
            if near and ideal - self.before[near - 1] <= self.before[min(near, len(self.size))] - ideal:
                near -= 1
            reach = int(np.searchsorted(self.before, self.before[at] + capacity, "right")) - 1
            at = min(max(near, need, at), reach)
            ends.append(at)
        return ends


def sized(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, size, text_crc32 and the place of the text's group in the order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + settings.overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - BITS).alias("place"),
    )


def _totals(groups: DataFrame, bits: int) -> DataFrame:
    prefix = F.shiftright("place", BITS - bits)
    return groups.groupBy(prefix.alias("prefix")).agg(F.lit(bits).alias("bits"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))


def _arrays(rows: list) -> tuple[np.ndarray, ...]:
    bits = np.array([r.bits for r in rows], np.int64)
    return np.array([r.prefix for r in rows], np.int64) << (BITS - bits), bits, np.array([r.bytes for r in rows], np.int64), np.array([r.groups for r in rows], np.int64)


def search(groups: DataFrame, shards: int, settings: Settings) -> tuple[int, list[int]]:
    """The smallest capacity for so many contiguous shards of ``groups`` (place, bytes), and the places where shards after the first begin."""
    now = Stretches(*_arrays(_totals(groups, settings.first_bits).collect()))
    if not len(now.size):
        return 0, []
    while True:
        low, high = now.bounds(shards)
        todo = now.unsettled(low, high, shards)
        if not len(todo):
            break
        parts = None
        for bits in sorted(set(now.bits[todo].tolist())):
            some = [(int(now.start[k]) >> (BITS - bits),) for k in todo if now.bits[k] == bits]
            wanted = groups.sparkSession.createDataFrame(some, "wanted bigint")
            inside = groups.join(F.broadcast(wanted), F.shiftright("place", BITS - bits) == F.col("wanted"))
            totals = _totals(inside, min(BITS, bits + settings.more_bits))
            parts = totals if parts is None else parts.unionByName(totals)
        stay = np.setdiff1d(np.arange(len(now.size)), todo)
        now = Stretches(*(np.concatenate([old[stay], new]) for old, new in zip((now.start, now.bits, now.size, now.groups), _arrays(parts.collect()), strict=True)))
    ends = now.cuts(high, shards)
    return high, [int(now.start[k]) if k < len(now.start) else 1 << BITS for k in ends]


def _shard_of(place: Column, cuts: list[int], first: int) -> Column:
    """The number of the shard among those that begin at the cuts, by halving."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    if cuts[k] >= 1 << BITS:  # begins after all places
        return _shard_of(place, cuts[:k], first)
    return F.when(place < F.lit(cuts[k]), _shard_of(place, cuts[:k], first)).otherwise(_shard_of(place, cuts[k + 1 :], first + k + 1))


def shards(docs: DataFrame, settings: Settings = Settings(), scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's bytes in UTF-8 (0 for null) plus ``overhead``; the law is ``bytes``: equal texts share a shard
    (null counts as empty), and sizes of shards are near equal, with the largest as small as the order allows. With
    fewer groups than shards some shards are empty. slot counts the documents of a shard from 0 without gaps;
    grown_shard is null, as it belongs to another law. Ids may be null or repeat: each row has its own slot, and which
    of rows equal in all columns has which is all the same. An empty table gives an empty result; other columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(sized(docs, settings), "rows")
    groups = scratch.table(rows.groupBy("place").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("docs")), "groups")
    left, total, n_rows = settings.shards, *groups.agg(F.sum("bytes"), F.sum("docs")).first()
    total, n_rows, own = total or 0, n_rows or 0, []
    for r in groups.orderBy(F.desc("bytes"), "place").limit(settings.shards - 1).collect():
        if r.bytes * left <= total or left == 1:
            break
        own.append(r.place)
        left, total = left - 1, total - r.bytes
    rest = groups.where(~F.col("place").isin(own)) if own else groups
    _, cuts = search(rest, left, settings)
    shard = _shard_of(F.col("place"), cuts, len(own))
    if own:
        alone = F.create_map(*(x for k, place in enumerate(own) for x in (F.lit(place), F.lit(k))))
        shard = F.coalesce(F.try_element_at(alone, F.col("place")), shard)
    buckets = max(range_partitions(docs.sparkSession), -(-n_rows // settings.rows_a_bucket))
    dealt = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "place"), F.lit(buckets)).alias("bucket"))
    sizes = scratch.table(dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "place", "size", "text_crc32"))
    return dealt.withColumn("at", inside).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
