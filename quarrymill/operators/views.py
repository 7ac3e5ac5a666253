"""Views over several tables: tiers, memberships, totals, contrasts along a ladder, and exceedances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier_join(base: DataFrame, tiers: Mapping[str, DataFrame], key: str) -> DataFrame:
    """base with each tier's row as a struct (null where the tier hasn't seen the record) and the number of tiers it has."""
    out = base
    for name, df in tiers.items():
        out = out.join(df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name)), key, "left")
    return out.withColumn("tiers", sum((F.col(n).isNotNull().cast("int") for n in tiers), F.lit(0)))


def memberships(records: DataFrame, datasets: DataFrame, key: str, dataset: str, split: str) -> DataFrame:
    """(key, datasets): for each record a map from dataset to its sorted splits."""
    per = datasets.groupBy(key, dataset).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    maps = per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(dataset).cast("string"), "splits")))).alias("datasets"))
    return records.select(key).join(maps, key, "left")


def totals(rows: DataFrame, sums: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Long totals (measure, key, value): each sum overall, and counts by each of some columns."""
    pairs = [F.struct(F.lit(name).alias("measure"), F.lit("all").alias("key"), c.cast("double").alias("value")) for name, c in sums.items()]
    pairs += [F.struct(F.lit(f"count_by_{b}").alias("measure"), F.col(b).cast("string").alias("key"), F.lit(1.0).alias("value")) for b in by]
    return rows.select(F.inline(F.array(*pairs))).groupBy("measure", "key").agg(F.bround(F.sum("value"), 2).alias("value"))


def ladder_steps(means: DataFrame, rung: str, value: str) -> DataFrame:
    """(rung, step, accelerating): the change from one rung to the next, and whether it exceeds the one before.

    A ladder has few rungs, one row each.
    """
    w = Window.orderBy(rung)
    steps = means.withColumn("step", F.col(value) - F.lag(value).over(w))
    return steps.select(rung, "step", (F.col("step") > F.lag("step").over(w)).alias("accelerating")).where("step is not null")


def exceedance(rows: DataFrame, by: Sequence[str], value: Column, thresholds: Sequence[float]) -> DataFrame:
    """(by, n, largest, and for each threshold the share of values above it)."""
    shares = [F.bround(F.avg((value > t).cast("double")), 6).alias(f"above_{t:g}".replace(".", "_")) for t in thresholds]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.max(value).alias("largest"), *shares)


def disagreement(labels: DataFrame, key: str, authority: str, value: str, first: str, second: str) -> DataFrame:
    """One row over records that both authorities have labelled: n, the mean of |difference|, the share of equal signs.

    Records where either is 0 have no sign and aren't counted in the share.
    """
    per = labels.where(F.col(authority).isin(first, second)).groupBy(key).agg(F.max(F.when(F.col(authority) == first, F.col(value))).alias("a"), F.max(F.when(F.col(authority) == second, F.col(value))).alias("b"))
    signs = F.when((F.col("a") != 0) & (F.col("b") != 0), (F.signum("a") == F.signum("b")).cast("double"))
    return per.where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_gap"), F.bround(F.avg(signs), 6).alias("sign_agreement"))


def tiered_backlog(items: DataFrame, state: str, tiers: Mapping[str, int], other: int) -> DataFrame:
    """items with the tier of their state."""
    tier = F.lit(other)
    for name, t in tiers.items():
        tier = F.when(F.col(state) == name, t).otherwise(tier)
    return items.withColumn("tier", tier)


def largest_effect(rows: DataFrame, by: Sequence[str], name: str, effect: Column, level: Column) -> DataFrame:
    """(by, name, relative): the largest |effect| relative to its level; of equal ones the first by name."""
    relative = F.abs(effect / F.nullif(level, F.lit(0.0)))
    return rows.withColumn("__r", relative).groupBy(*by).agg(F.max_by(F.struct(name, F.bround("__r", 6).alias("relative")), F.struct("__r", F.col(name))).alias("b")).select(*by, "b.*")
