"""Filters, tag expressions, facets and pages over a catalog of records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comparison signs of a tag expression, in the order in which they are looked for. Fixed values.
TAG_SIGNS = ("!=", ">=", "<=", ">", "<", ":")


def conjunction(conditions: Mapping[str, object]) -> Column:
    """All conditions hold. A plain name compares as text (null as "None"); name_min and name_max are inclusive bounds."""
    parts = []
    for name, value in conditions.items():
        if value is None:
            continue
        if m := re.fullmatch(r"(.+)_(min|max)", name):
            parts.append(F.col(m[1]) >= value if m[2] == "min" else F.col(m[1]) <= value)
        elif isinstance(value, (list, tuple, set)):
            parts.append(F.col(name).isin(list(value)))
        else:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("None")) == F.lit(str(value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tag_filter(expression: str, tags: Column) -> Column:
    """A condition on a map of tags: ``tag`` (present), ``tag:value``, ``tag!=value``, or a comparison.

    Names match in any letter case, and so does the text after ``:``, which is compared as text. The other signs compare
    numbers where both sides are numbers, and else text as it is written. Of tags that differ in letter case alone any
    may fit; a missing tag, or one without a value, fails every comparison.
    """
    sign = next((s for s in TAG_SIGNS if s in expression), None)
    name, _, value = (x.strip() for x in expression.partition(sign)) if sign else (expression.strip(), "", "")
    try:
        number = F.lit(float(value))
    except ValueError:
        number = F.lit(None).cast("double")
    ops = {"!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}

    def fits(entry: Column) -> Column:
        named = F.lower(entry["key"]) == name.lower()
        have = entry["value"].cast("string")
        if sign is None:
            return named
        if sign == ":":
            return named & (F.lower(have) == value.lower())
        mine = have.try_cast("double")
        return named & F.when(mine.isNotNull() & number.isNotNull(), ops[sign](mine, number)).otherwise(ops[sign](have, F.lit(value)))

    return F.coalesce(F.exists(F.filter(F.map_entries(tags), lambda e: F.coalesce(fits(e), F.lit(False))), lambda e: F.lit(True)), F.lit(False))


def _tagged(name: str):
    return lambda x: F.struct(F.lit(name).alias("facet"), x.cast("string").alias("key"))


def facets(rows: DataFrame, row_facets: Mapping[str, Column], list_facets: Mapping[str, Column] | None = None) -> DataFrame:
    """Counts in long form (facet, key, n). A row facet counts rows; a list facet counts entries of an array, each once a row."""
    pairs = [F.array(F.struct(F.lit(name).alias("facet"), c.cast("string").alias("key"))) for name, c in row_facets.items()]
    for name, c in (list_facets or {}).items():
        pairs.append(F.transform(F.array_distinct(c), _tagged(name)))
    return rows.select(F.inline(F.concat(*pairs))).groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension from one pass, by grouping sets: (facet, key, n)."""
    cols = [F.col(d).cast("string").alias(d) for d in dimensions]
    grouped = rows.select(*cols).groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    out = grouped.agg(F.count(F.lit(1)).alias("n"), *(F.grouping(d).alias(f"__g_{d}") for d in dimensions))
    facet, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dimensions:
        facet, key = F.when(F.col(f"__g_{d}") == 0, d).otherwise(facet), F.when(F.col(f"__g_{d}") == 0, F.col(d)).otherwise(key)
    return out.select(facet.alias("facet"), key.alias("key"), "n")


def page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of at most 500 rows; end ``order`` with a unique column."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def top_facets(facets: DataFrame, facet: str, key: str, n: str, most: int = 8) -> DataFrame:
    """The commonest keys of each facet, equal ones by key. A facet's distinct keys are few."""
    rank = F.row_number().over(Window.partitionBy(facet).orderBy(F.desc(n), F.asc_nulls_first(key)))
    return facets.withColumn("rank", rank).where(F.col("rank") <= most)
