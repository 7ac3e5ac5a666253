"""Seeded samples (arms), stacks of them, and selections. A sample is a prefix of a hash order, so it doesn't depend on
how rows are partitioned and grows by whole prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.hashing import sample_order, unit_hash
from quarrymill.session import Scratch, range_partitions


#: Up to so many rows are sorted at the edge of a selection; more are told apart by further digits first.
EDGE_ROWS = 100_000


def smallest(rows: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The first n rows by ``order``, a column of strings of equal length, and then by key; n may be a share of all rows.

    No task gathers n rows: rows are counted by the order's leading digits, those of all lower digits are taken as they
    are, and only the rows that share the digits at the edge are sorted.
    """
    if n <= 0:
        return rows.limit(0)
    held, prefix, need = rows.withColumn("__order", order), "", n
    while True:
        digits = F.substring("__order", len(prefix) + 1, 4).alias("digits")
        counts = held.where(F.col("__order").startswith(prefix)).groupBy(digits).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, 0))
        edge = counts.withColumn("upto", upto).where(F.col("upto") >= need).orderBy("digits").first()
        if edge is None:
            return rows
        prefix, need = prefix + edge["digits"], need - (edge["upto"] - edge["n"])
        if edge["n"] <= EDGE_ROWS or not edge["digits"]:
            break
    below = held.where(F.col("__order") < prefix)
    last = held.where(F.col("__order").startswith(prefix)).orderBy("__order", key).limit(need)
    return below.unionByName(last).drop("__order")


def fixed_rows(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows by hash order."""
    return smallest(rows, sample_order(seed, F.col(key)), key, n)


def fraction_rows(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """max(1, round(fraction * rows)) rows by hash order."""
    n = rows.count()
    return fixed_rows(rows, key, max(1, round(fraction * n)), seed) if n else rows


def balanced(rows: DataFrame, key: str, bucket: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each bucket, by hash order."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(sample_order(seed, F.col(key)), key))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


def stack(arms: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The union of arms; a record in several belongs to the first. Adds arm, arm_order and in_arms (how many have it)."""
    parts = [df.withColumns({"arm": F.lit(name), "arm_order": F.lit(i)}) for i, (name, df) in enumerate(arms)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    body = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.min_by(F.struct(*body), "arm_order").alias("b"), F.count(F.lit(1)).alias("in_arms")).select(key, "b.*", "in_arms")


def containment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only one side has, and whether each side holds the other."""
    per = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    only_left, only_right = F.count_if(F.col("r") == 0), F.count_if(F.col("l") == 0)
    return per.agg(only_left.alias("only_left"), only_right.alias("only_right"), (only_left == 0).alias("right_holds_left"), (only_right == 0).alias("left_holds_right"))


def preview(arms: Sequence[tuple[str, DataFrame, DataFrame]], key: str) -> DataFrame:
    """For each arm (name, available rows, sampled rows): available, sampled and effective (after earlier arms) counts."""
    sizes = reduce(lambda a, b: a.unionByName(b), (df.agg(F.count(F.lit(1)).alias("available")).withColumn("arm", F.lit(n)) for n, df, _ in arms))
    taken = reduce(lambda a, b: a.unionByName(b), (df.agg(F.count(F.lit(1)).alias("sampled")).withColumn("arm", F.lit(n)) for n, _, df in arms))
    got = stack([(n, s.select(key)) for n, _, s in arms], key).groupBy("arm").agg(F.count(F.lit(1)).alias("effective"))
    return sizes.join(taken, "arm").join(got, "arm", "left").select("arm", "available", "sampled", F.coalesce("effective", F.lit(0)).alias("effective"))


def holdout(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """rows with a holdout flag that depends on the key alone."""
    return rows.withColumn("holdout", unit_hash(seed, "holdout", F.col(key)) < fraction)


def selected_arms(ranked: DataFrame, key: str, deep: float, audit: float, seed: int = 0) -> DataFrame:
    """Arms over a ranked pool (key, rank, holdout): the deep arm has the best ranks, the uniform arm as many by hash
    order, and the audit arm a share of what deep left, by hash order. Holdouts are in none, but count in the shares.

    Each arm is a prefix of an order, taken without a global sort (see smallest).
    """
    out = ranked
    for name, ids in arm_ids(ranked, key, deep, audit, seed).items():
        out = out.join(ids.withColumn(name, F.lit(True)), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("deep", "uniform", "audit")})


def arm_ids(ranked: DataFrame, key: str, deep: float, audit: float, seed: int = 0) -> dict[str, DataFrame]:
    """The keys of each arm of ``selected_arms``, for callers that need no rows outside the arms."""
    n = ranked.count()
    k, a = round(deep * n), round(audit * n)
    pool = ranked.where("not holdout").select(key, "rank")
    deep_ids = smallest(pool, F.lpad(F.hex(F.col("rank").cast("long")), 16, "0"), key, k).select(key)
    uniform = smallest(pool, sample_order(seed, F.col(key), "uniform"), key, k).select(key)
    left = pool.join(deep_ids, key, "left_anti")
    audit_ids = smallest(left, sample_order(seed, F.col(key), "audit"), key, a).select(key)
    return {"deep": deep_ids, "uniform": uniform, "audit": audit_ids}


def by_exact_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows of the asked ids, in the asked order (ids: key, position); of an id asked twice, the first place counts.

    An id without a row fails the query.
    """
    asked = ids.groupBy(key).agg(F.min("position").alias("position"))
    got = asked.join(rows.withColumn("__there", F.lit(True)), key, "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no record "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return got.where(there).select(*rows.columns, "position")


def nearest_prefix(rows: DataFrame, order: Sequence[Column], cost: str, target: float) -> DataFrame:
    """One row: the prefix of an order whose summed cost is nearest to the target (the shorter of equal ones).

    A prefix ends before the first missing cost. Sums run by range-partitioned chunks: chunk totals first, which are
    few, then sums within chunks.
    """
    ordered = rows.select(F.struct(*order).alias("o"), F.col(cost).cast("double").alias("c"))
    # Written first: range bounds are sampled, and come out differently when a plan is run twice.
    chunked = ordered.repartitionByRange(range_partitions(ordered.sparkSession), "o").withColumn("p", F.spark_partition_id())
    chunked = Scratch(rows.sparkSession).table(chunked, "ranges")
    totals = chunked.groupBy("p").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c").isNull()).alias("gaps"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("p", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("gaps").over(before), F.lit(0)).alias("g0"))
    inside = Window.partitionBy("p").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.select("p", F.sum("c").over(inside).alias("s"), F.count(F.lit(1)).over(inside).alias("k"), F.count_if(F.col("c").isNull()).over(inside).alias("g"))
    run = summed.join(F.broadcast(totals), "p").where(F.col("g0") + F.col("g") == 0).select((F.col("n0") + F.col("k")).alias("size"), (F.col("s0") + F.col("s")).alias("cost"))
    best = F.min_by(F.struct("size", "cost"), F.struct(F.abs(F.col("cost") - target), "size")).alias("b")
    return run.agg(best).select("b.size", "b.cost")
