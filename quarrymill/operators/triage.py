"""Ranking candidates by how much a label would tell: coverage, rarity, weighted components, reasons and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.hashing import sample_order
from quarrymill.session import Scratch, range_partitions


def coverage_counts(rows: DataFrame, keys: Column, total: str = "__positions__") -> DataFrame:
    """(key, n): how many rows have each key of an array of keys, each once a row; and the number of rows."""
    listed = F.concat(F.array_distinct(keys), F.array(F.lit(total)))
    return rows.select(F.explode(listed).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def rarity(count: Column, total: Column, share: float, least: float) -> Column:
    """min(1, target / count): 1 for what is rarer than its target, which is a share of all rows, at least ``least``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(least), F.lit(share) * total) / F.greatest(F.lit(1.0), count.cast("double")))


def priority(components: Mapping[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """The weighted mean of components in [0, 1] (null counts as 0), and an array of (name, contribution)."""
    total = sum(w for _, w in components.values()) or 1.0
    parts = [F.struct(F.lit(name).alias("name"), F.bround(F.coalesce(c.cast("double"), F.lit(0.0)) * w / total, 6).alias("contribution")) for name, (c, w) in components.items()]
    score = sum((F.bround(F.coalesce(c.cast("double"), F.lit(0.0)) * w / total, 6) for c, w in components.values()), F.lit(0.0))
    return F.bround(score, 6), F.array(*parts)


def top_reasons(contributions: Column, n: int = 4) -> Column:
    """Names of the largest positive contributions, equal ones by name."""
    positive = F.filter(contributions, lambda x: x["contribution"] > 0)
    ordered = F.array_sort(F.transform(positive, lambda x: F.struct((-x["contribution"]).alias("k"), x["name"].alias("name"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["name"])


def ranked(rows: DataFrame, score: str, key: str, seed: int = 0) -> DataFrame:
    """rows with a dense global rank by score, ties by hash order.

    A global row number without one big partition: rows are range-partitioned by the order, numbered within their
    partition, and moved by the number of rows before it. The partitions are written first, since range bounds are
    sampled and come out differently when a plan is run twice.
    """
    order = F.struct((-F.col(score)).alias("a"), sample_order(seed, F.col(key), "tie").alias("b"), F.col(key).alias("c"))
    n = range_partitions(rows.sparkSession)
    parts = Scratch(rows.sparkSession).table(rows.withColumn("__o", order).repartitionByRange(n, "__o").withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__o"))
    return parts.withColumn("__r", inside).join(F.broadcast(sizes), "__p").withColumn("rank", F.col("__r") + F.col("__before")).drop("__o", "__p", "__r", "__before")


def arm_report(rows: DataFrame, arms: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """(arm, n, measures): a row belongs to each arm whose flag it has."""
    flags = F.array_compact(F.array(*(F.when(F.col(a), F.lit(a)) for a in arms)))
    long = rows.withColumn("arm", F.explode(flags))
    return long.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in measures.items()))


def parity(costs: DataFrame, arm: str, cost: str, tolerance: float) -> DataFrame:
    """One row: the largest and smallest total of the arms, their relative gap, and whether it is within tolerance."""
    sums = costs.groupBy(arm).agg(F.sum(cost).alias("total"))
    gap = (F.max("total") - F.min("total")) / F.max("total")
    return sums.agg(F.max("total").alias("largest"), F.min("total").alias("smallest"), F.bround(gap, 6).alias("gap"), (gap <= tolerance).alias("within"))
