"""Predicates and projections over records, labels and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_label(records: DataFrame, labels: DataFrame, key: str, **equal: object) -> DataFrame:
    """Records with at least one label that has all of the given column values (family, authority, producer, tier)."""
    cond = F.lit(True)
    for column, value in equal.items():
        cond &= F.col(column) == F.lit(value)
    return records.join(labels.where(cond).select(key).distinct(), key, "left_semi")


def has_value(values: Column, wanted: str) -> Column:
    """Whether an array of strings has a value, in any letter case."""
    return F.coalesce(F.exists(values, lambda v: F.lower(v) == wanted.lower()), F.lit(False))


def fact_at_least(facts: Column, name: str, least: int | None = None, favors: str | None = None) -> Column:
    """Whether a map of facts (bucket, favors) has one with at least a bucket and in favour of a side; a missing fact has bucket 0."""
    fact = F.try_element_at(facts, F.lit(name))
    cond = F.coalesce(fact["bucket"], F.lit(0)) >= (least or 0)
    return cond & F.coalesce(fact["favors"] == favors, F.lit(False)) if favors else cond


def fact_bucket(facts: Column, name: str) -> Column:
    """A fact's bucket, 0 if it is missing."""
    return F.coalesce(F.try_element_at(facts, F.lit(name))["bucket"], F.lit(0))


def members(records: DataFrame, memberships: DataFrame, key: str, dataset: object, split: object | None = None) -> DataFrame:
    """Records of a dataset, or of one split of it. memberships: key, dataset, split."""
    cond = F.col("dataset") == F.lit(dataset)
    if split is not None:
        cond &= F.col("split") == F.lit(split)
    return records.join(memberships.where(cond).select(key).distinct(), key, "left_semi")


def findings(rows: DataFrame, supersedes: DataFrame, key: str, text: str | None = None, state: str | None = None) -> DataFrame:
    """Findings with their state, SUPERSEDED where a later one names them, that have a text anywhere and are in a state."""
    out = rows.join(supersedes.select(key).distinct().withColumn("__s", F.lit(True)), key, "left")
    out = out.withColumn("state", F.when(F.col("__s"), F.lit("SUPERSEDED")).otherwise(F.col("state"))).drop("__s")
    if text:
        out = out.where(F.contains(F.lower(F.to_json(F.struct(*out.columns))), F.lit(text.lower())))
    return out.where(F.col("state") == state) if state else out


def forbidden_keys(schema: T.DataType, forbidden: Sequence[str], below: Sequence[str] = ("cost",), path: str = "") -> list[str]:
    """The dotted paths of fields with a forbidden name at any depth of a schema, except under the fields named in ``below``."""
    if isinstance(schema, T.ArrayType):
        return forbidden_keys(schema.elementType, forbidden, below, path)
    if isinstance(schema, T.MapType):
        return forbidden_keys(schema.valueType, forbidden, below, path)
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        here = f"{path}.{f.name}" if path else f.name
        out += ([here] if f.name in forbidden else []) + ([] if f.name in below else forbidden_keys(f.dataType, forbidden, below, here))
    return out


def in_state(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that have each given column value; None asks for nothing."""
    cond = F.lit(True)
    for column, value in wanted.items():
        if value is not None:
            cond &= F.col(column).eqNullSafe(F.lit(value))
    return rows.where(cond)


def coerced(value: Column, kind: str, low: float | None = None, high: float | None = None, choices: Sequence[object] | None = None) -> Column:
    """A switch's value in its type; null if it isn't of that type, out of bounds or none of the choices."""
    v = value.try_cast(kind)
    ok = v.isNotNull()
    if low is not None:
        ok &= v >= low
    if high is not None:
        ok &= v <= high
    if choices is not None:
        ok &= v.isin(*choices)
    return F.when(ok, v)


def capped_distinct(rows: DataFrame, source: str, order: str, value: Column, cap: int) -> DataFrame:
    """(source, rows, counted): the rows of each source, and distinct values among its first ``cap`` in its order.

    The order is a row number of the source's file, so that the cap is a comparison and needs no sorting.
    """
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(F.col(order) < cap, value)).alias("counted"))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The rows whose file row number is under n."""
    return rows.where(F.col(order) < n)


def arm_tags(flags: Sequence[str]) -> Column:
    """The names of the boolean columns that hold, in the given order."""
    return F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))


def output_order(rank: Column, rows: Column) -> Column:
    """What ranked output is sorted by, before the id: the rank, and after all ranks for what has none."""
    return F.coalesce(rank, rows + 1)


def computed_items(status: Column, items: Column) -> Column:
    """The items of a computed collection, empty if there are none; null if it wasn't computed, which isn't the same."""
    return F.when(status == "computed", F.coalesce(items, F.array().cast("array<string>")))


def budget_entry(budgets: Column, nodes: int) -> Column:
    """The first entry of an array of budgets that was searched with so many nodes; null if there is none."""
    return F.get(F.filter(budgets, lambda b: b["nodeBudget"] == nodes), F.lit(0))


def first_of_family(labels: Column, family: str) -> Column:
    """The first label of a family in an array of labels; null if there is none."""
    return F.get(F.filter(labels, lambda x: x["family"] == family), F.lit(0))


def catalog_order(sort: str, row: str, facts: str = "facts") -> list[Column]:
    """What the catalog is sorted by: "fact:<name>" by its bucket and label_count descending, others by their value as text, and
    record_id not at all; in file order where that leaves rows equal."""
    if sort.startswith("fact:"):
        return [fact_bucket(F.col(facts), sort[5:]).desc(), F.col(row)]
    if sort == "label_count":
        return [F.col(sort).desc(), F.col(row)]
    return [F.col(row)] if sort == "record_id" else [F.col(sort).cast("string"), F.col(row)]


def supersession(rows: DataFrame, chain: str, order: str, key: str) -> DataFrame:
    """rows with the key of the one before in their chain, by order."""
    return rows.withColumn("supersedes", F.lag(key).over(Window.partitionBy(chain).orderBy(order)))
