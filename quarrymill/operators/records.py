"""The write path: canonical records with their groups, registered label sets, frozen datasets and their verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.hashing import split_name, split_unit
from quarrymill.operators.canonical import keep_first, link_groups
from quarrymill.operators.components import look_up
from quarrymill.operators.labels import duplicate_observations, unknown_records
from quarrymill.session import Scratch
from quarrymill.sources.readers import content_hash


def fail_if_any(bad: DataFrame, what: str) -> None:
    """Raises with up to three examples if there is any row."""
    some = bad.limit(3).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(tuple(r)) for r in some))


def component_labels(rows: DataFrame, group: str, key: str, scratch: Scratch | None = None) -> DataFrame:
    """(group, label): groups that share a key value, transitively, have one label: "xc" and eight digits of a hash of the
    group names in it, or 24 where several components have the same eight. A group that shares no key keeps its own name."""
    comp = link_groups(rows, group, key, scratch)
    short = F.substring("h", 1, 8)
    per = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"), content_hash(F.col(group).cast("string")).alias("h"))
    shared = per.where("n > 1").groupBy(short.alias("short")).agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    digits = F.when(F.col("of").isNull(), F.col("short")).otherwise(F.substring("h", 1, 24))
    name = F.when(F.col("n") > 1, F.concat(F.lit("xc"), digits))
    names = per.withColumn("short", short).join(shared, "short", "left").select("component", name.alias("name"))
    return look_up(comp, names, "component").select(group, F.coalesce("name", F.col(group).cast("string")).alias("label"))


def normalized(rows: DataFrame, source: str, row: str, identity: Column, game: str, valid: Column, scratch: Scratch | None = None) -> DataFrame:
    """Canonical records: record_id, source, row, ``group`` and ``group_unknown``, the first row of each identity.

    Games of a source that share an identity, before repeats go, are one group. A row without a game has the group
    "<source>:UNKNOWN" and is flagged. Rows that aren't valid are left out.
    """
    named = rows.where(valid).withColumns({"record_id": identity, "__game": F.concat_ws(":", F.col(source).cast("string"), F.col(game).cast("string"))})
    named = named.withColumn("__game", F.when(F.col(game).isNotNull(), F.col("__game")))
    labels = component_labels(named.select("__game", "record_id"), "__game", "record_id", scratch)
    kept = keep_first(named.select("record_id", source, row, "__game"), ["record_id"], [source, row])
    unknown = F.concat(F.col(source).cast("string"), F.lit(":UNKNOWN"))
    out = kept.join(labels, "__game", "left")
    return out.select("record_id", source, row, F.coalesce("label", unknown).alias("group"), F.col("__game").isNull().alias("group_unknown"))


def register(labels: DataFrame, records: DataFrame, key: str, observation: Sequence[str]) -> DataFrame:
    """``labels``, or an error if one is of no record or an observation is there twice."""
    fail_if_any(unknown_records(labels, records, key).select(key), "labels of unknown records")
    fail_if_any(duplicate_observations(labels, observation), "observations given twice")
    return labels


def registration_report(labels: DataFrame, records: DataFrame, key: str, observation: Sequence[str]) -> DataFrame:
    """One row: how many label rows there are, are of no record, and are observations given twice or more."""
    known = records.select(key).distinct().withColumn("__there", F.lit(True))
    per = labels.join(known, key, "left").groupBy(*dict.fromkeys([*observation, key])).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("__there").isNotNull()).alias("there"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~F.col("there"), F.col("n"))), F.lit(0)).alias("unknown"), F.count_if(F.col("n") > 1).alias("twice"))


def copied_labels(labels: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Labels of records that are still there."""
    return labels.join(records.select(key).distinct(), key, "left_semi")


def copy_report(labels: DataFrame, records: DataFrame, key: str, by: str) -> DataFrame:
    """(by, kept, dropped): how many labels of each kind are of records that are still there."""
    there = records.select(key).distinct().withColumn("__there", F.lit(True))
    joined = labels.join(there, key, "left")
    return joined.groupBy(by).agg(F.count_if(F.col("__there").isNotNull()).alias("kept"), F.count_if(F.col("__there").isNull()).alias("dropped"))


def frozen(records: DataFrame, seed: int, train: float = 0.8, val: float = 0.1, unknown: str = "refuse") -> DataFrame:
    """Records with the split of their group. Records of unknown groups make it fail, or with ``unknown="shared"`` are one group."""
    if abs(train + val - min(1.0, train + val)) > 1e-9 or min(train, val) < 0:
        raise ValueError("split fractions must be at least 0 and at most 1 in all")
    if unknown == "refuse":
        fail_if_any(records.where("group_unknown").select("record_id"), "records of unknown groups")
    group = F.when(F.col("group_unknown"), F.lit("UNKNOWN-GROUP")).otherwise(F.col("group"))
    return records.withColumn("group", group).withColumn("split", split_name(split_unit(seed, group), train, val))


def manifest(dataset: DataFrame, by: str = "split", key: str = "record_id") -> DataFrame:
    """(by, rows, groups, ids_hash, rows_hash) of a frozen dataset: what a later reader holds it against."""
    line = F.to_json(F.struct(*sorted(dataset.columns)), {"ignoreNullFields": "false"})
    # Groups are counted beside the sums: a distinct count among them would shuffle the hashes' sums for each group.
    sums = dataset.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), content_hash(F.col(key).cast("string")).alias("ids_hash"), content_hash(line).alias("rows_hash"))
    groups = dataset.groupBy(F.col(by).alias("__by")).agg(F.countDistinct("group").alias("groups"))
    return sums.join(groups, F.col(by).eqNullSafe(F.col("__by"))).select(by, "rows", "groups", "ids_hash", "rows_hash")


def verification(dataset: DataFrame, recorded: DataFrame, by: str = "split", key: str = "record_id") -> DataFrame:
    """(by, what): everything that differs from the recorded manifest, and ids or groups that are in several splits. None if all is well."""
    now, then = manifest(dataset, by, key), recorded
    joined = now.alias("a").join(then.alias("b"), by, "full_outer")
    checks = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("rows", "groups", "ids_hash", "rows_hash")]
    changed = joined.select(by, F.explode(F.array_compact(F.array(*checks))).alias("what"))
    several = lambda c: dataset.groupBy(c).agg((F.min(by) != F.max(by)).alias("s")).where("s").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("*").alias(by), F.lit(f"{c} in several").alias("what"))
    return changed.unionByName(several(key)).unionByName(several("group"))


def row_matched(sizes: DataFrame, raw: str, joined: str) -> DataFrame:
    """``sizes`` if each arm has as many rows joined as it had raw; a difference fails the query, nothing is trimmed."""
    text = F.concat(F.lit("arm sizes differ: "), F.to_json(F.struct(*sizes.columns)))
    return sizes.where(F.when(~F.col(raw).eqNullSafe(F.col(joined)), F.raise_error(text).cast("boolean")).otherwise(True))


def attestation(universe: DataFrame, facts: Mapping[str, Column], other: DataFrame) -> DataFrame:
    """(fact, ours, theirs) of the facts on which two universes differ: they are held against each other by content and not by name."""
    def of(df: DataFrame, column: str) -> DataFrame:
        row = df.agg(*(c.cast("string").alias(n) for n, c in facts.items()))
        return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("fact"), F.col(n).alias(column)) for n in facts))))

    return of(universe, "ours").join(of(other, "theirs"), "fact").where("not (ours <=> theirs)")


def leak_share(train: DataFrame, clean: DataFrame, stop: float = 0.05) -> DataFrame:
    """One row: rows, clean rows, the share that leaks, and whether it is more than may be dropped."""
    both = train.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(clean.agg(F.count(F.lit(1)).alias("clean"))))
    share = F.coalesce(F.try_divide(F.col("rows") - F.col("clean"), F.col("rows")), F.lit(0.0))
    return both.select("rows", "clean", F.bround(share, 6).alias("share"), (share > stop).alias("stop"))


def same_order(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """One row: the sizes of two ordered lists, at how many places they differ, and whether they are one list."""
    a, b = left.select(F.col(position).alias("p"), F.col(key).alias("a")), right.select(F.col(position).alias("p"), F.col(key).alias("b"))
    joined = a.join(b, "p", "full_outer")
    differ = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return joined.agg(F.count("a").alias("left"), F.count("b").alias("right"), differ.alias("differ"), (differ == 0).alias("same"))


def unseen(store: DataFrame, fresh: DataFrame, identity: str) -> DataFrame:
    """What a content-addressed store lacks: one row of each identity that it doesn't hold. Writing these again adds nothing."""
    return fresh.dropDuplicates([identity]).join(store.select(identity), identity, "left_anti")


def snapshot(positions: DataFrame, games: DataFrame, path: str) -> DataFrame:
    """Writes a pool once, as two tables that refuse to be overwritten, and gives back its manifest: table, rows, rows_hash.

    Repeated positions stay; a pool isn't deduplicated.
    """
    spark, parts = positions.sparkSession, []
    for name, df in (("positions", positions), ("games", games)):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        kept = spark.read.parquet(f"{path}/{name}")
        line = F.to_json(F.struct(*sorted(kept.columns)), {"ignoreNullFields": "false"})
        parts.append(kept.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), content_hash(line).alias("rows_hash")))
    return parts[0].unionByName(parts[1])


def rebuilt(records: DataFrame, selected: Column, seed: int, before: DataFrame, **policy: object) -> DataFrame:
    """A dataset's selection replayed on new records: frozen again by the same seed and policy. It must differ from what it was
    before, or there is nothing to rebuild."""
    fresh = frozen(records.where(selected), seed, **policy)
    if verification(fresh, manifest(before)).isEmpty():
        raise ValueError("the dataset would be the same")
    return fresh
