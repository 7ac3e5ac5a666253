"""Connected components as rounds of DataFrame steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import PARTITIONS, ROWS_A_TASK, Scratch

#: Rows of a key beyond which a join doesn't send them all to one task.
MANY_ROWS = 200_000
#: Rows that a task ties at a time.
TIED_ROWS = 1 << 19


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """For each entry its place among the distinct ones in their order, and these."""
    coded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal codes together, and where each code begins in it. No code is left out."""
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.diff(codes[order], prepend=-1))


def _least_linked(g: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each g the smallest one that rows (g, k) lead to."""
    (by_k, starts_k), (by_g, starts_g) = _runs(k), _runs(g)
    up = np.arange(len(starts_g))
    while True:
        per_k = np.minimum.reduceat(up[g[by_k]], starts_k)
        seen = np.minimum.reduceat(per_k[k[by_g]], starts_g)
        new = np.minimum(up, seen)
        # The root of a group follows what its members see, and all follow their roots.
        np.minimum.at(new, up, seen)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            return up
        up = new


def _tied(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    bare = pc.unique(rows.filter(pc.is_null(rows["k"]))["g"])
    rows = rows.filter(pc.is_valid(rows["k"]))
    gs, ks, ties = [bare], [pa.nulls(len(bare), rows["k"].type)], [bare]
    if rows.num_rows:
        (g, groups), (k, keys) = _ranked(rows["g"]), _ranked(rows["k"])
        up = _least_linked(g, k)
        of_key = np.empty(len(keys), np.int64)
        of_key[k] = up[g]
        gs += [groups, pa.nulls(len(keys), groups.type)]
        ks += [pa.nulls(len(groups), keys.type), keys]
        ties += [groups.take(pa.array(up)), groups.take(pa.array(of_key))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (gs, ks, ties)], ["g", "k", "tie"])


def _tie(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield _tied(held)
                held, n = [], 0
        if n:
            yield _tied(held)

    return run


def tied(rows: DataFrame, size: int) -> DataFrame:
    """(g, k, tie): every group and every key of ``rows`` (g, k), the other being null, with the smallest group that some of the
    rows lead to from it, once or oftener. All links of the rows are those of groups and of keys to their ties.

    A task ties TIED_ROWS at a time, so what is inside of such a piece is one tie after it. Rows come by key, so a key is
    in one piece but for one with many rows, which several tasks share. ``size``: at most so many rows come in.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get(PARTITIONS)), size // ROWS_A_TASK)
    near = rows.where("g is not null").repartitionByRange(parts, "k", F.xxhash64("g"))
    types = {c: rows.schema[c].dataType.simpleString() for c in "gk"}
    return near.mapInArrow(_tie(TIED_ROWS), f"g {types['g']}, k {types['k']}, tie {types['g']}")


def links_to_least(ties: DataFrame, of: str) -> DataFrame:
    """(src, dst): the ties of each entry of column ``of`` to the smallest of them."""
    several = ties.groupBy(of).agg(F.min("tie").alias("least"), F.max("tie").alias("most")).where("least < most").select(of, "least")
    return ties.join(several, of).where("tie <> least").select(F.col("tie").alias("src"), F.col("least").alias("dst"))


def look_up(rows: DataFrame, entries: DataFrame, key: str, many: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with the entry of their key, where ``entries`` has one row a key at most.

    Keys of over MANY_ROWS rows are few (the number of rows divided by that), so their entries are broadcast and their rows
    stay where they are; the others meet in a shuffle. ``many`` has these keys; without it, rows are counted.
    """
    if many is None:
        many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_ROWS)
    keys = [r[0] for r in many.where(F.col(key).isNotNull()).select(key).collect()]
    if not keys:
        return rows.join(entries, key, how)
    often = F.col(key).isin(keys)
    few = rows.where(~F.coalesce(often, F.lit(False))).join(entries, key, how)
    return few.unionByName(rows.where(often).join(F.broadcast(entries.where(often)), key, how))


def connected_components(edges: DataFrame, scratch: Scratch | None = None, name: str = "cc", rows: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the smallest node reachable.

    Each round hooks every component to its smallest neighbour, follows the hooks to their roots by pointer doubling,
    and contracts the edges, so both rounds and doublings are logarithmic in the number of nodes. Only nodes that others
    hook to are doubled. The rounds' roots are put together from the last to the first, so one join has all nodes. Every
    step is an aggregation that combines before its shuffle or a ``look_up``, so neither a node with very many edges nor
    a component with most of the nodes is a bottleneck. Rounds are cut by written tables, whose shuffles have partitions by
    their rows (``rows``: at most so many edges come in). Nulls and self-loops link nothing.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    linked = edges.where("src is not null and dst is not null and src <> dst")
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    both = linked.select(F.inline(F.array(pair("src", "dst"), pair("dst", "src"))))
    live = scratch.table(both.distinct(), f"{name}_edges_0", 2 * rows)
    rounds: list[DataFrame] = []
    while size := live.count():
        r = len(rounds) + 1
        hooks = scratch.table(live.groupBy("u").agg(F.least("u", F.min("v")).alias("p"), F.count(F.lit(1)).alias("degree")), f"{name}_hooks_{r}", size)
        hubs = hooks.where(F.col("degree") > MANY_ROWS).select("u")
        hooks = hooks.select("u", "p")
        pointed = hooks.groupBy(F.col("p").alias("u")).agg(F.count(F.lit(1)).alias("n"))
        inner = scratch.table(hooks.join(pointed, "u"), f"{name}_inner_{r}_0", size)
        many, ups, jump = inner.where(F.col("n") > MANY_ROWS).select(F.col("u").alias("p")), inner.select("u", "p"), 0
        while True:
            jump += 1
            up = ups.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            doubled = scratch.table(look_up(ups, up, "p").select("u", "pp", (F.col("pp") != F.col("p")).alias("moved")), f"{name}_inner_{r}_{jump}", size)
            ups = doubled.select("u", F.col("pp").alias("p"))
            if doubled.where("moved").isEmpty():
                break
        roots = look_up(hooks, ups.select(F.col("u").alias("p"), F.col("p").alias("root")), "p", many).select("u", F.col("root").alias("p"))
        roots = scratch.table(roots, f"{name}_roots_{r}", size)
        rounds.append(roots)
        to = roots.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = look_up(live, roots, "u", hubs).select("v", F.col("p").alias("u"))
        contracted = look_up(moved, to, "v", hubs.select(F.col("u").alias("v"))).select("u", F.col("pv").alias("v"))
        live = scratch.table(contracted.where("u <> v").distinct(), f"{name}_edges_{r}", size)
    if not rounds:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component")).where("false")
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("u").alias("p"), F.col("p").alias("root"))
        found = look_up(rounds[-1], later, "p", how="left").select("u", F.coalesce("root", "p").alias("p"))
        found = scratch.table(found, f"{name}_found_{len(rounds)}", rounds[-1].count())
        rounds.pop()
    return found.select(F.col("u").alias("node"), F.col("p").alias("component"))
