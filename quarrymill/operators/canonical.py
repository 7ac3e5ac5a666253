"""From raw rows to canonical records: identity, dedup, groups, splits, inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.hashing import content_id, split_name, split_unit
from quarrymill.operators.components import connected_components, links_to_least, look_up, tied
from quarrymill.session import Scratch


def canonical_text(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. A min over an ordered struct, so that copies combine before the shuffle."""
    body = [c for c in rows.columns if c not in keys]
    ranked = rows.select(*keys, F.struct(*(F.col(o) if isinstance(o, str) else o for o in order)).alias("__order"), F.struct(*body).alias("__body"))
    return ranked.groupBy(*keys).agg(F.min_by("__body", "__order").alias("__body")).select(*keys, "__body.*")


def dedup_counts(rows: DataFrame, identity: Column, valid: Column) -> DataFrame:
    """One row: records, distinct records, duplicates and rejected rows."""
    ids = rows.select(F.when(valid, identity).alias("id"))
    per = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("id").isNotNull()
    total, unique = F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)), F.count_if(kept)
    return per.agg(total.alias("records"), unique.alias("unique_records"), (total - unique).alias("duplicates"), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("rejected"))


def inventory(rows: DataFrame, identity: Column, fields: Sequence[str], top: int = 12) -> DataFrame:
    """A corpus inventory in long form: (field, value, n, rank) with the commonest values of each field, and the field
    ``__identity`` whose values are rows, unique and max_multiplicity."""
    per = rows.groupBy(identity.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    facts = per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique"), F.max("n").alias("max_multiplicity"))
    facts = facts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("value"), F.col(c).cast("long").alias("n")) for c in ("rows", "unique", "max_multiplicity")))))
    out = facts.select(F.lit("__identity").alias("field"), "value", "n", F.lit(0).alias("rank"))
    pairs = rows.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))))
    counts = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return out.unionByName(counts.withColumn("rank", rank).where(F.col("rank") <= top))


def assign_split(rows: DataFrame, group: Column, seed: int = 0, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """rows with the split of their group, so that a group never straddles two."""
    return rows.withColumn("split", split_name(split_unit(seed, group), train, val))


def straddling_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key column, how many of its values are in more than one split. All must be 0."""
    pairs = rows.select("split", F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))))
    per = pairs.groupBy("key", "value").agg((F.min("split") != F.max("split")).alias("straddles"))
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("values"), F.count_if("straddles").alias("straddling"))


def link_groups(rows: DataFrame, group: str, key: str, scratch: Scratch | None = None) -> DataFrame:
    """(group, component) where groups that share a key value belong together, transitively.

    Rows are tied piece by piece first (``tied``), so only ties of groups and keys that several pieces have go through the
    rounds, and these grow with rows and not with pairs of groups. Rows without a group or key link nothing; a group that
    shares no key is its own component.
    """
    scratch, size = scratch or Scratch(rows.sparkSession), rows.count()
    ties = scratch.table(tied(rows.select(F.col(group).alias("g"), F.col(key).alias("k")), size), "ties", size)
    groups, keys = ties.where("g is not null").select("g", "tie"), ties.where("k is not null").select("k", "tie")
    edges = links_to_least(groups, "g").unionByName(links_to_least(keys, "k"))
    comp = connected_components(edges, scratch, rows=size).withColumnRenamed("node", "tie")
    found = look_up(groups.groupBy("g").agg(F.min("tie").alias("tie")), comp, "tie", how="left")
    return scratch.table(found.select(F.col("g").alias(group), F.coalesce("component", "tie").alias("component")), "groups", size)


def without_leaks(train: DataFrame, exam: DataFrame, group: str, key: str, scratch: Scratch | None = None) -> DataFrame:
    """train rows whose component holds no exam row. Components are taken over the union of both."""
    both = train.select(group, key).unionByName(exam.select(group, key))
    comp = link_groups(both, group, key, scratch)
    touched = exam.select(group).join(comp, group).select("component").distinct()
    clean = look_up(comp, touched, "component", how="left_anti").select(group)
    return train.join(clean, group, "left_semi")


def record_ids(rows: DataFrame, text: Column) -> DataFrame:
    return rows.withColumn("record_id", content_id(canonical_text(text)))
