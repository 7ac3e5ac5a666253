"""Label observations in long form: registration checks, joins and exactly-one extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.scalars import dig


def unknown_records(labels: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Labels of records that don't exist; registering must refuse a set that has any."""
    return labels.join(records.select(key).distinct(), key, "left_anti")


def duplicate_observations(labels: DataFrame, key: Sequence[str]) -> DataFrame:
    return labels.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_labels(records: DataFrame, labels: DataFrame, key: str, order: Sequence[str], body: Sequence[str]) -> DataFrame:
    """records with an array ``labels`` of their observations in registration order; empty where there are none."""
    lists = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *body))).alias("labels"))
    kind = lists.schema["labels"].dataType.simpleString()
    return records.join(lists, key, "left").withColumn("labels", F.coalesce("labels", F.array().cast(kind)))


def long_form(wide: DataFrame, key: str, families: Sequence[str]) -> DataFrame:
    """(key, family, value) from a table with a column for each family; nulls are no observations."""
    pairs = F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).cast("double").alias("value")) for f in families))
    return wide.select(key, F.inline(pairs)).where("value is not null")


def has_all(labels: DataFrame, key: str, families: Sequence[str]) -> DataFrame:
    """Records with at least one observation of every family."""
    need = sorted(set(families))
    per = labels.where(F.col("family").isin(need)).groupBy(key).agg(F.countDistinct("family").alias("n"))
    return per.where(F.col("n") == len(need)).select(key)


def matching(labels: DataFrame, budget: dict[str, float] | None = None, value_path: str | None = None, **equal: object) -> Column:
    """A predicate: equal columns, a budget map that holds the asked entries (it may hold more), and a JSON ``value`` that has
    something at a dotted path."""
    cond = F.lit(True)
    for column, value in equal.items():
        cond &= F.col(column) == F.lit(value)
    for k, v in (budget or {}).items():
        cond &= F.try_element_at("budget", F.lit(k)) == F.lit(v)
    return cond & dig(F.col("value"), value_path).isNotNull() if value_path else cond


def not_exactly_one(records: DataFrame, labels: DataFrame, key: str, spec: Column) -> DataFrame:
    """(key, n) of the records for which a target spec doesn't match exactly one observation."""
    per = labels.where(spec).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return records.select(key).distinct().join(per, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def latest(labels: DataFrame, key: Sequence[str], order: Sequence[str], body: Sequence[str]) -> DataFrame:
    """The last observation of each key by registration order."""
    return labels.groupBy(*key).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("__b")).select(*key, "__b.*")


def provenance_counts(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by each of several columns, in long form (facet, key, n)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("key")) for c in by))
    return labels.select(F.inline(pairs)).groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))


def set_references(labels: DataFrame, label_set: str, order: str, columns: Sequence[str] = ("family", "authority", "producer")) -> DataFrame:
    """(label_set, rows, families, authorities, producers, registry_version, policy_hash) of each set of labels, in maps of counts.

    The registry version is that of the set's last row by ``order``. A set belongs to one policy: several policy hashes
    fail the query, naming the set; rows without one don't count. Families and the like are few, so that maps of them are small.
    """
    plural = {c: c[:-1] + "ies" if c.endswith("y") else c + "s" for c in columns}
    whole = labels.groupBy(label_set).agg(F.count(F.lit(1)).alias("rows"), F.max_by("registry_version", order).alias("registry_version"), F.min("policy_hash").alias("__p"), F.max("policy_hash").alias("__q"))
    refused = F.raise_error(F.concat(F.lit("a set of labels carries several policy hashes: "), F.coalesce(F.col(label_set).cast("string"), F.lit("null")))).cast("string")
    out = whole.select(label_set, "rows", "registry_version", F.when(F.col("__p").eqNullSafe(F.col("__q")), F.col("__p")).otherwise(refused).alias("policy_hash"))
    for c, name in plural.items():
        counts = labels.where(F.col(c).isNotNull()).groupBy(label_set, c).agg(F.count(F.lit(1)).alias("n")).groupBy(F.col(label_set).alias("__s")).agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias(name))
        out = out.join(counts, F.col(label_set).eqNullSafe(F.col("__s")), "left").drop("__s")
    return out


def listed_sets(references: DataFrame, registered: str) -> DataFrame:
    """References of sets in the order of their registration."""
    return references.orderBy(registered)
