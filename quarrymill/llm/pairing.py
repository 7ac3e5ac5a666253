"""Components of documents (or lines) that meet in posting lists and whose sets are similar, without all pairs of a list.

First each list tests its members against one pivot, its most central member, and the links found give components. A
pair inside one component needs no test of its own. What is left are pairs between components within a list. In a few
rounds, members outside a list's largest component are tested against other members of that. Then those still outside
meet the others, where a bound lets them be linked: all are compared with the most central node of the list's largest
component, the elements that a member shares with that are counted in a few buckets, and two members share at most the lesser count of each bucket, and beyond it at
most what the lesser has there that others have too. The bound is exact, so it drops no link; copies that differ too
much from each other, each in its own way, don't meet at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.components import connected_components
from quarrymill.session import Scratch


#: Width of the size classes by which members are matched.
STEP = 1.02
#: Buckets by which elements shared with a pivot are counted, and 64-bit words of the bitmap of the others.
BUCKETS, WORDS = 24, 32
#: The members of lists of up to so many are paired as they are.
SHORT = 8


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")


def linked_components(
    postings: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame] | None,
    spread: Callable[[DataFrame], DataFrame],
    percent: int,
    few: int,
    scratch: Scratch,
    pivot_rounds: int = 4,
    likely: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) of the nodes that have links.

    postings: token, node, n (the size of the node's set). compare: from pairs (a, b) to a, b, na, nb, common, the sizes
    of their sets and of the intersection. elements: from nodes (node) to node, s, the entries of their sets, if it is worth while to look for entries that no other
    node has. spread: from
    pairs (a, b) to a, b, spread, bits: the counts of the intersection's entries in ``BUCKETS`` buckets, and a bitmap of
    ``WORDS`` longs of b's other entries. Linked are nodes that
    meet in a list if 100 * |intersection| >= percent * |union|. While there are more than ``few`` open pairs, and fewer
    with each round, up to ``pivot_rounds`` pivots of a list are tried. ``likely`` may drop pairs (a, b) before they are
    compared, if it knows that they can't be linked.
    """
    p = percent / 100
    enough = lambda both, a, b: both * 100 >= (a + b - both) * percent

    def linked(pairs: DataFrame) -> DataFrame:
        found = compare(likely(pairs) if likely else pairs)
        return found.where(enough(F.col("common"), F.col("na"), F.col("nb"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    # The most central member is the one in most company.
    sizes = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    company = scratch.table(postings.join(sizes, "token").groupBy("node").agg(F.sum("df").alias("company")), "company")
    first = F.min(F.struct((-F.col("company")).alias("order"), "node", "n")).alias("p")
    pivots = scratch.table(postings.join(company, "node").groupBy("token").agg(first).select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")), "pivots_0")
    # Sets whose sizes alone keep them from being linked aren't compared.
    stars = postings.join(pivots, "token").where((F.col("node") != F.col("pivot")) & enough(F.least("n", "pn"), F.col("n"), F.col("pn")))
    stars = stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    edges = scratch.table(linked(stars), "links_0")
    comp, left = connected_components(edges, scratch, "cc_0").select("node", F.col("component").alias("comp")), math.inf
    for k in range(1, pivot_rounds + 1):
        members = postings.join(comp, "node", "left").select("node", "n", "token", F.coalesce("comp", "node").alias("comp"))
        # A list's largest component, and its member that comes first in an order that differs from round to round.
        order = F.struct(F.xxhash64(F.col("node"), F.lit(k)).alias("order"), "node", "n")
        parts = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("first"))
        lists = parts.groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max(F.struct("c", "comp", "first")).alias("top"), F.count(F.lit(1)).alias("parts"))
        # The pair of a list of two has been looked at.
        lists = lists.where((F.col("parts") > 1) & (F.col("all") > 2))
        lists = scratch.table(lists.select("token", "all", ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("open"), F.col("top.comp").alias("most"), F.col("top.first.node").alias("next"), F.col("top.first.n").alias("pn")), f"lists_{k}")
        before, left = left, lists.agg(F.sum("open")).first()[0] or 0
        # Pivots that close less than a quarter of what was open aren't what is missing.
        if k == pivot_rounds or left <= few or left > 0.75 * before:
            break
        stars = members.join(lists, "token").where((F.col("comp") != F.col("most")) & enough(F.least("n", "pn"), F.col("n"), F.col("pn")))
        stars = stars.select(F.col("next").alias("a"), F.col("node").alias("b")).distinct()
        edges = scratch.table(edges.unionByName(linked(stars)), f"links_{k}")
        comp = connected_components(edges, scratch, f"cc_{k}").select("node", F.col("component").alias("comp"))
    if not left:
        return comp.select("node", F.col("comp").alias("component"))

    # The members of short lists, beside the pivot that all have been compared with, meet each other.
    short = members.join(lists.where(F.col("all") <= SHORT).select("token"), "token").join(pivots, "token").where("node <> pivot").drop("pivot", "pn")
    other = short.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "comp")))
    fits = (F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & enough(F.least("n", "n2"), F.col("n"), F.col("n2"))
    close = short.join(other, "token").where(fits).select(F.col("node").alias("a"), F.col("node2").alias("b"))

    # A longer list's members are seen from the most central node of its largest component, whether that is in the list or
    # not. Lists with one such node are looked at as one, so that members of many common lists meet once.
    nodes = members.select("node", "n", "comp").distinct().join(company, "node")
    centers = nodes.groupBy("comp").agg(F.min(F.struct((-F.col("company")).alias("order"), "node", "n")).alias("p")).select(F.col("comp").alias("most"), F.col("p.node").alias("pivot"), F.col("p.n").alias("size"))
    seen = members.join(lists.where(F.col("all") > SHORT).select("token", "most").join(centers, "most"), "token")
    selves = seen.select("pivot", F.col("pivot").alias("node"), F.col("size").alias("n"), F.col("most").alias("comp"), "most")
    groups = scratch.table(seen.select("pivot", "node", "n", "comp", "most").unionByName(selves).distinct(), "groups")
    # What a member shares with the pivot is counted, and what it shares with no one.
    common = spread(groups.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).select(F.col("a").alias("pivot"), F.col("b").alias("node"), "spread", "bits")
    nothing = groups.where("false").select("node", F.lit(0).alias("s"))
    lone = (elements(groups.select("node").distinct()) if elements else nothing).groupBy("s").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("df")).where("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    known = groups.join(common, ["pivot", "node"]).join(lone, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    beyond = F.col("n") - F.aggregate("spread", F.lit(0), lambda t, x: t + x)
    known = known.select("pivot", "node", "n", "comp", "most", "spread", "bits", F.greatest(F.lit(0), beyond - F.col("u")).alias("e"), (F.col("n") - F.col("u")).alias("most_shared"),
                         (beyond - F.aggregate("bits", F.lit(0), lambda t, x: t + F.bit_count(x))).alias("more"))
    known = scratch.table(known, "open_members")
    # x can be linked to sizes from p * n up to most_shared * (1 + p) / p - n.
    low, high = F.col("n") * p, F.least(F.col("n") / p, F.col("most_shared") * ((1 + p) / p) - F.col("n"))
    own = lambda side: [F.col("spread")[i].alias(f"{side}{i}") for i in range(BUCKETS)] + [F.col("bits")[i].alias(f"{side}b{i}") for i in range(WORDS)]
    x = known.where("comp <> most").where(low <= high + 1e-6)
    x = x.select("pivot", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("e").alias("ex"), F.col("more").alias("mx"), *own("x"), F.explode(F.sequence(_size_class(F.greatest(low, F.lit(1.0))) - 1, _size_class(F.greatest(high, F.lit(1.0))) + 1)).alias("size"))
    y = known.select("pivot", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("e").alias("ey"), F.col("more").alias("my"), *own("y"), _size_class(F.col("n")).alias("size"))
    # Of the entries that fall on one bit, all but one of the lesser's may be shared beside what the bitmaps tell.
    beside = F.least("mx", "my")
    for i in range(WORDS):
        beside = beside + F.bit_count(F.col(f"xb{i}").bitwiseAND(F.col(f"yb{i}")))
    inside = F.least("x0", "y0")
    for i in range(1, BUCKETS):
        inside = inside + F.least(f"x{i}", f"y{i}")
    # The bitmaps are only looked at where the counts don't tell enough.
    fits = [enough(bound, F.col("nx"), F.col("ny")) for bound in (inside + F.least("ex", "ey"), inside + F.least("ex", "ey", beside))]
    met = x.join(y, (x["pivot"] == y["pivot"]) & (x["size"] == y["size"]) & (F.col("cx") != F.col("cy")) & fits[0] & fits[1])
    pairs = scratch.table(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(close).distinct(), "open_pairs")
    # Components of what was found, contracted to the components so far.
    own = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    rest = linked(pairs).join(own("src"), "src", "left").join(own("dst"), "dst", "left").select(F.coalesce("src_comp", "src").alias("src"), F.coalesce("dst_comp", "dst").alias("dst"))
    over = connected_components(rest, scratch, "cc_open")
    named = comp.join(over.select(F.col("node").alias("comp"), "component"), "comp", "left").select("node", F.coalesce("component", "comp").alias("component"))
    fresh = over.join(comp, "node", "left_anti")
    return named.unionByName(fresh.select("node", "component")).dropDuplicates(["node"])


def shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets and of the intersection: a, b, na, nb, common."""
    sa, sb = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return pairs.join(sb, "b").join(sa, "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def spread(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the counts of their common elements in buckets, and a bitmap of b's others."""
    sa, sb = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = pairs.join(sb, "b").join(sa, "a").select("a", "b", F.array_intersect("sa", "sb").alias("both"), F.array_except("sb", "sa").alias("rest"))
    count = lambda i: F.size(F.filter("both", lambda s: F.pmod(s, F.lit(BUCKETS)) == i))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(s, 5), F.lit(64)).cast("int"))
    word = lambda i: F.aggregate(F.filter("rest", lambda s: F.pmod(s, F.lit(WORDS)) == i), F.lit(0).cast("long"), lambda t, s: t.bitwiseOR(bit(s)))
    return met.select("a", "b", F.array(*map(count, range(BUCKETS))).alias("spread"), F.array(*map(word, range(WORDS))).alias("bits"))


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of unsigned 64-bit integers as lists of longs."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
