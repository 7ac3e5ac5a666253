"""Paired contrasts, intervals, decisions, correlations, order statistics and the bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import Scratch, range_partitions


def t_within(t: float, df: int) -> float:
    """The chance that Student's t lies between -t and t: for whole degrees of freedom a finite sum in the angle atan(t / sqrt(df))."""
    angle = math.atan(t / math.sqrt(df))
    cosine, odd = math.cos(angle), df % 2
    term = cosine if odd else 1.0
    total = 0.0
    for j in range(df // 2):
        total += term
        term *= cosine * cosine * (2 * j + 1 + odd) / (2 * j + 2 + odd)
    return 2 / math.pi * (angle + math.sin(angle) * total) if odd else math.sin(angle) * total


@lru_cache(maxsize=100_000)
def t_critical(df: int, level: float = 0.95, one_sided: bool = False) -> float:
    """The critical value of Student's t for any whole degrees of freedom from 1.

    Newton steps from the normal quantile, which lies below the answer: the distribution function is concave there, so
    they only rise. From 5,000 degrees of freedom on, the expansion about the normal quantile is exact to 12 digits.
    """
    within = 2 * level - 1 if one_sided else level
    z = NormalDist().inv_cdf((1 + within) / 2)
    if df >= 5_000:
        return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
    scale = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    t = z
    for _ in range(200):
        step = (within - t_within(t, df)) / (scale * (1 + t * t / df) ** (-(df + 1) / 2))
        t += step
        if abs(step) <= 1e-14 * t:
            break
    return t


def critical_column(df: Column, level: float = 0.95, one_sided: bool = False) -> Column:
    """Critical values over a column of degrees of freedom of aggregated rows, which are few; null under 1."""

    def of(parts: pd.Series) -> pd.Series:
        return parts.map(lambda k: t_critical(int(k), level, one_sided) if k >= 1 else None).astype("float64")

    return F.pandas_udf(of, "double")(df.cast("long"))


def mean_interval(rows: DataFrame, by: Sequence[str], value: Column, level: float = 0.95, one_sided: bool = False) -> DataFrame:
    """(by, n, mean, low, high): the mean and its t interval; null bounds for fewer than two values."""
    stats = rows.withColumn("__v", value).groupBy(*by).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("__s"))
    half = critical_column(F.col("n") - 1, level=level, one_sided=one_sided) * F.col("__s") / F.sqrt("n")
    return stats.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


class Incomplete(ValueError):
    """A paired analysis that lacks some of its cells, which must be reported and not dropped."""


def paired(rows: DataFrame, keys: Sequence[str], arm: str, first: str, second: str, value: str, complete: DataFrame | None = None) -> DataFrame:
    """(keys, d): the second arm's mean value less the first's, for keys that have both.

    ``complete`` (keys) is the design, which has one row a cell: every one of its cells must have both arms, and there may
    be no others, or this raises with the first of them. Without it, keys that lack an arm are left out.
    """
    per = rows.where(F.col(arm).isin(first, second)).groupBy(*keys).agg(F.avg(F.when(F.col(arm) == first, F.col(value))).alias("a"), F.avg(F.when(F.col(arm) == second, F.col(value))).alias("b"))
    if complete is not None:
        both = complete.select(*keys, F.lit(True).alias("__due")).join(per, list(keys), "full")
        why = F.when(F.col("__due").isNull(), "beyond the design").when(F.col("a").isNull(), F.lit(f"without {first}")).when(F.col("b").isNull(), F.lit(f"without {second}"))
        bad = both.select(*keys, why.alias("why")).where("why is not null").orderBy(*keys).limit(20).collect()
        if bad:
            raise Incomplete("; ".join(f"{tuple(r[k] for k in keys)} {r['why']}" for r in bad))
    return per.where("a is not null and b is not null").select(*keys, (F.col("b") - F.col("a")).alias("d"))


def adjacent_interaction(differences: DataFrame, seed: str, width: str) -> DataFrame:
    """(seed, width, previous, interaction): the change of a contrast from the width before to this one, by seed."""
    w = Window.partitionBy(seed).orderBy(width)
    return differences.select(seed, width, F.lag(width).over(w).alias("previous"), (F.col("d") - F.lag("d").over(w)).alias("interaction")).where("previous is not null")


def verdict(low: Column, high: Column) -> Column:
    """better (below 0 throughout), worse, or unresolved."""
    return F.when(high < 0, "better").when(low > 0, "worse").otherwise("unresolved")


def _complete(widths: Sequence[object] | None, width: str) -> Column:
    """True, or an error that names what is missing, if not every preregistered width has an interval."""
    if widths is None:
        return F.lit(True)
    missing = F.array_except(F.array(*map(F.lit, widths)), F.collect_set(F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.col(width))))
    text = F.concat(F.lit(f"no interval for {width} "), F.array_join(missing.cast("array<string>"), ", "))
    return F.when(F.size(missing) > 0, F.raise_error(text).cast("boolean")).otherwise(True)


def decision(intervals: DataFrame, widths: Sequence[object] | None = None, width: str = "width") -> DataFrame:
    """One row: SUPPORTED if every interval lies below 0, REJECTED if every one above, else INCONCLUSIVE.

    With ``widths``, each of them must have an interval, or the query fails. Without any interval it's INCONCLUSIVE.
    """
    below, above = F.bool_and(F.col("high") < 0), F.bool_and(F.col("low") > 0)
    verdict_ = F.when(below, "SUPPORTED").when(above, "REJECTED").otherwise("INCONCLUSIVE")
    return intervals.agg(F.count(F.lit(1)).alias("n"), F.when(_complete(widths, width), verdict_).alias("decision"))


def noninferiority(intervals: DataFrame, margin: float, widths: Sequence[object] | None = None, width: str = "width") -> DataFrame:
    """One row: NONINFERIOR if all upper bounds are under the margin, FLOOR_CROSSED if all lower ones over it; and equivalence.

    With ``widths``, each of them must have an interval, or the query fails.
    """
    good, bad = F.bool_and(F.col("high") < margin), F.bool_and(F.col("low") > margin)
    verdict_ = F.when(good, "NONINFERIOR").when(bad, "FLOOR_CROSSED").otherwise("INCONCLUSIVE")
    return intervals.agg(F.when(_complete(widths, width), verdict_).alias("verdict"), F.bool_and((F.col("low") > -margin) & (F.col("high") < margin)).alias("equivalent"), F.max("high").alias("largest_upper"))


def within_margin(intervals: DataFrame, margin: float, width: str) -> DataFrame:
    """One row: the widths whose upper bound is under the margin and those whose isn't, ascending."""
    inside = F.coalesce(F.col("high") < margin, F.lit(False))
    lists = (F.array_sort(F.collect_list(F.when(c, F.col(width)))) for c in (inside, ~inside))
    return intervals.agg(*(c.alias(name) for c, name in zip(lists, ("inside", "outside"))))


def difference_in_differences(rows: DataFrame, key: str, first: str, second: str, value: str) -> DataFrame:
    """(key, d): by key, how much the effect of ``second`` (true less false) differs between ``first`` true and false.

    first and second are boolean columns; keys without all four cells are left out. The other order, the effect of
    ``first`` by ``second``, is the same number.
    """
    cell = lambda a, b: F.avg(F.when((F.col(first) == a) & (F.col(second) == b), F.col(value)))
    per = rows.groupBy(key).agg(cell(True, True).alias("tt"), cell(True, False).alias("tf"), cell(False, True).alias("ft"), cell(False, False).alias("ff"))
    return per.select(key, ((F.col("tt") - F.col("tf")) - (F.col("ft") - F.col("ff"))).alias("d")).where("d is not null")


def pattern(verdicts: DataFrame, exam: str, width: str, wanted: dict[str, str]) -> DataFrame:
    """One row: over widths, whether every one has the wanted verdict on each exam (``pattern``), and on how many it has.

    verdicts: exam, width, verdict. wanted: the verdict by exam. A width without a verdict on some exam counts against.
    """
    hits = [F.coalesce(F.max(F.when(F.col(exam) == e, F.col("verdict") == v)), F.lit(False)) for e, v in wanted.items()]
    per = verdicts.groupBy(width).agg(F.array_min(F.array(*hits)).alias("all"))
    return per.agg(F.count(F.lit(1)).alias("widths"), F.count_if("all").alias("agreeing"), F.bool_and("all").alias("pattern"))


def interaction_label(intervals: DataFrame) -> DataFrame:
    """One row: COMPLEMENTS if every interval of an interaction lies below 0, SUBSTITUTES if every one above, HETEROGENEOUS if
    some lie below and some above, else UNRESOLVED; with the counts."""
    below, above, n = F.count_if(F.col("high") < 0), F.count_if(F.col("low") > 0), F.count(F.lit(1))
    label = F.when((n > 0) & (below == n), "COMPLEMENTS").when((n > 0) & (above == n), "SUBSTITUTES").when((below > 0) & (above > 0), "HETEROGENEOUS").otherwise("UNRESOLVED")
    return intervals.agg(n.alias("n"), below.alias("below"), above.alias("above"), label.alias("label"))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with ranks from 1, equal values sharing their mean rank.

    Counts by value are numbered instead of rows: each distinct value's place is the count below it.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    n = range_partitions(rows.sparkSession)
    # Written first: range bounds are sampled, and come out differently when a plan is run twice.
    parts = Scratch(rows.sparkSession).table(counts.repartitionByRange(n, value).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__p").agg(F.sum("__n").alias("__s"))
    sizes = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__n").over(Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn("__upto", inside).join(F.broadcast(sizes), "__p").select(value, (F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return rows.join(ranks, value)


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson's and Spearman's correlation; null for fewer than three rows or a constant side."""
    clean = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(clean, "x", "rx"), "y", "ry")
    enough = (F.count(F.lit(1)) >= 3) & (F.var_pop("x") > 0) & (F.var_pop("y") > 0)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.corr("x", "y")).alias("pearson"), F.when(enough, F.corr("rx", "ry")).alias("spearman"))


def order_statistic(rows: DataFrame, by: Sequence[str], value: str, index: Column, out: str) -> DataFrame:
    """(by, out): the sorted value at ``index``, an expression over ``n``, from 0.

    Works on counts by value: the answer is the least value whose running count exceeds the index. The counts lie in
    range partitions, written first, and what each partition adds up to for a group is carried on to the next, so a
    group of any number of values is no single task's.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    parts = counts.repartitionByRange(range_partitions(spark), *by, value).withColumn("__p", F.spark_partition_id())
    parts = Scratch(spark).table(parts, "ranges")
    group = Window.partitionBy(*by)
    sums = parts.groupBy("__p", *by).agg(F.sum("c").alias("s"))
    before = F.coalesce(F.sum("s").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("__p").alias("p"), *(F.col(c).alias(f"__{c}") for c in by), before.alias("before"), F.sum("s").over(group).alias("n"))
    same = F.col("__p") == F.col("p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.sum("c").over(Window.partitionBy("__p", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    summed = parts.withColumn("upto", inside).join(sums, same).withColumn("upto", F.col("upto") + F.col("before"))
    return summed.where(F.col("upto") > index).groupBy(*by).agg(F.min(value).alias(out))


def bootstrap_interval(rows: DataFrame, by: Sequence[str], key: str, value: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): a Poisson bootstrap of the mean, 2.5 % to 97.5 %.

    Each row draws its weights for all resamples from a generator seeded by its key, so the result doesn't depend on
    partitions; tasks add up weights and weighted values, and only ``resamples`` sums a group are shuffled.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def partial(parts):
        for pdf in parts:
            pdf = pdf[np.isfinite(pdf["v"])]
            for group, own in pdf.groupby(list(by), dropna=False):
                w = np.stack([np.random.default_rng([seed, k & 0xFFFFFFFF]).poisson(1.0, resamples) for k in own["k"]])
                yield pd.DataFrame([[*group, len(own), float(own["v"].sum()), w.sum(0).astype(float), w.T @ own["v"].to_numpy()]], columns=[*by, "n", "s", "w", "ws"])

    cols = rows.select(*by, F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    parts = cols.mapInPandas(partial, f"{kinds}, n long, s double, w array<double>, ws array<double>")
    each = parts.select(*by, "n", "s", F.posexplode(F.arrays_zip("w", "ws")).alias("b", "x"))
    sums = each.groupBy(*by, "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), (F.sum("x.ws") / F.sum("x.w")).alias("m"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), (F.max("s") / F.max("n")).alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
