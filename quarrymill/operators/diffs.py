"""Comparisons of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(keys, change): added, removed, changed or same, for every key of either side."""
    a = old.select(*keys, F.struct(*payload).alias("a"))
    b = new.select(*keys, F.struct(*payload).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change"))


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], examples: int = 3) -> DataFrame:
    """(field, n, examples) over common keys: how many values differ and the first keys that do."""
    a = left.select(key, *(F.col(f).alias(f"a_{f}") for f in fields))
    b = right.select(key, *(F.col(f).alias(f"b_{f}") for f in fields))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), (~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias("differs")) for f in fields))
    long = a.join(b, key).select(key, F.inline(rows))
    counts = long.groupBy("field").agg(F.count_if("differs").alias("n"))
    # The smallest keys only, found by repeated minima over what is bounded: one row a field and task.
    firsts = None
    seen = long.where("differs").select("field", key)
    for i in range(examples):
        nth = seen.groupBy("field").agg(F.min(key).alias(f"e{i}"))
        firsts = nth if firsts is None else firsts.join(nth, "field", "left")
        seen = seen.join(nth, "field").where(F.col(key) > F.col(f"e{i}")).drop(f"e{i}")
    lists = firsts.select("field", F.array_compact(F.array(*(F.col(f"e{i}").cast("string") for i in range(examples)))).alias("examples"))
    return counts.join(lists, "field", "left").select("field", "n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows either side has beyond the other; both 0 if the tables are equal as bags."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("__s")).unionByName(b.select(*cols, F.lit(-1).alias("__s")))
    per = both.groupBy(*cols).agg(F.sum("__s").alias("d"))
    return per.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_right"))


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(change, n): how many distinct keys were added, removed and kept."""
    seen = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n"))).groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    change = F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("kept")
    return seen.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))
