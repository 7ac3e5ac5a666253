"""Freezing an experiment's universe and its arms from recorded selections, refusing whatever doesn't fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.hashing import split_name, split_unit
from quarrymill.session import Scratch
from quarrymill.sources.readers import content_hash


class Refused(ValueError):
    """Evidence from which no fair experiment can be frozen."""


@dataclass(frozen=True)
class Universe:
    """candidates: record_id, group, split. arms: arm, record_id, group, split, nodes. identity: hashes by name."""

    candidates: DataFrame
    arms: DataFrame
    names: tuple[str, ...]
    identity: dict[str, str]
    seed: int
    fractions: tuple[float, float]


def _first(bad: DataFrame, why: str, column: str = "record_id") -> None:
    row = bad.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least")).first()
    if row["n"]:
        raise Refused(f"{why}: {row['n']}, the first of them {row['least']}")


def _hash(rows: DataFrame, *columns: str) -> str:
    return rows.agg(content_hash(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in columns))).alias("h")).first()["h"]


def freeze_universe(candidates: DataFrame, deep: DataFrame, selections: DataFrame, seed: int, train: float = 0.8, val: float = 0.1, arms: Sequence[str] = ("PRIORITY", "UNIFORM"), scratch: Scratch | None = None) -> Universe:
    """The population that arms are drawn from, with each component's split, and the arms as they were recorded.

    candidates: record_id, group, train_eligible (null counts as eligible): all that could have been selected. deep:
    record_id, nodes of records that got deep labels. selections: arm, record_id. Refused are: no candidates at all,
    candidates of unknown groups, that aren't eligible, or that are there twice; arms that are empty, name records
    outside the candidates or without measured nodes, or differ in size. A split belongs to the component alone and is
    the same for all arms. Repeated names in a selection count once. Other columns are ignored.
    """
    scratch = scratch or Scratch(candidates.sparkSession)
    unsafe = F.coalesce(F.col("group") == "", F.lit(True)) | F.col("group").endswith(":UNKNOWN")
    split = split_name(split_unit(seed, F.col("group")), train, val)
    everyone = scratch.table(candidates.select("record_id", F.col("group").cast("string").alias("group"), F.coalesce("train_eligible", F.lit(True)).alias("ok")).withColumn("split", split), "candidates")
    if everyone.isEmpty():
        raise Refused("the universe has no candidates")
    _first(everyone.where(unsafe), "candidates of unknown groups")
    _first(everyone.where("not ok"), "candidates that may not be trained on")
    _first(everyone.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "candidates that are there twice")
    nodes = deep.groupBy("record_id").agg(F.max("nodes").alias("nodes"))
    chosen = selections.where(F.col("arm").isin(list(arms))).select("arm", "record_id").distinct()
    known = everyone.select("record_id", "group", "split", F.lit(True).alias("known"))
    chosen = scratch.table(chosen.join(known, "record_id", "left").join(nodes, "record_id", "left"), "arms")
    sizes = {r["arm"]: r["n"] for r in chosen.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).collect()}
    if empty := [a for a in arms if a not in sizes]:
        raise Refused(f"arms without a recorded selection: {empty}")
    _first(chosen.where("known is null"), "selected records outside the candidates")
    _first(chosen.where("coalesce(nodes, 0) <= 0"), "selected records without measured deep labels")
    if len(set(sizes.values())) > 1:
        raise Refused(f"arms aren't row-matched: {sizes}")
    frozen = chosen.drop("known")
    policy = everyone.select("group", "split").distinct()
    identity = {"candidates": _hash(everyone, "record_id", "group"), "split_policy": _hash(policy, "group", "split"), "universe": _hash(frozen, "arm", "record_id", "group", "split", "nodes")}
    identity |= {f"splits:{a}": _hash(frozen.where(F.col("arm") == a), "record_id", "split") for a in arms}
    return Universe(everyone.drop("ok"), frozen, tuple(arms), identity, seed, (train, val))


def compute_gap(universe: Universe, tolerance: float) -> dict[str, object]:
    """Nodes by arm and their relative gap, refused beyond the tolerance that the plan declares."""
    nodes = {r["arm"]: r["n"] for r in universe.arms.groupBy("arm").agg(F.sum("nodes").alias("n")).collect()}
    most, least = max(nodes.values()), min(nodes.values())
    gap = (most - least) / (most or 1)
    if gap > tolerance:
        raise Refused(f"arms differ in compute by {gap:.2%}, more than {tolerance:.2%}: {nodes}")
    return {"nodes": nodes, "gap": round(gap, 6), "tolerance": tolerance}


def freeze_arms(universe: Universe, labelled: DataFrame, path: str, tolerance: float, all_train: bool = False) -> DataFrame:
    """Writes each arm's labelled records once, and gives back (arm, split, rows, nodes, ids_hash).

    labelled: record_id and what a record carries; only records with the labels that training needs. Membership comes
    from the universe alone, never from there being a label. Refused are: arms that differ in compute, records without
    labels or with several rows, and datasets whose files don't follow the universe's splits, which are read back for
    that. ``all_train`` puts every selected record in the training split, so that an arm is a treatment as a whole.
    """
    spark = universe.arms.sparkSession
    gap = compute_gap(universe, tolerance)
    body = [c for c in labelled.columns if c not in ("arm", "group", "split", "nodes")]
    members = universe.arms.withColumn("split", F.lit("train")) if all_train else universe.arms
    out = members.join(labelled.select(*body), "record_id")
    wanted = {r["arm"]: r["n"] for r in members.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).collect()}
    had = {r["arm"]: (r["n"], r["ids"]) for r in out.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids")).collect()}
    if wrong := {a: (n, *had.get(a, (0, 0))) for a, n in wanted.items() if had.get(a) != (n, n)}:
        raise Refused(f"selected records and their labelled rows don't match (selected, rows, records): {wrong}")
    for arm in universe.names:
        out.where(F.col("arm") == arm).drop("arm").write.mode("errorifexists").partitionBy("split").parquet(f"{path}/{arm}")
        kept = spark.read.parquet(f"{path}/{arm}")
        if all_train:
            if kept.where("split <> 'train'").count() or kept.count() != wanted[arm]:
                raise Refused(f"{arm}: not all selected records are in training")
        elif _hash(kept, "record_id", "split") != universe.identity[f"splits:{arm}"]:
            raise Refused(f"{arm}: its files don't follow the universe's splits")
    parts = [spark.read.parquet(f"{path}/{arm}").select(F.lit(arm).alias("arm"), "split", "record_id", "nodes") for arm in universe.names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    assert gap["gap"] <= tolerance
    return whole.groupBy("arm", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum("nodes").alias("nodes"), content_hash(F.col("record_id").cast("string")).alias("ids_hash"))
