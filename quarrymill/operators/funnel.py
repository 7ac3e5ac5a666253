"""What a labelling funnel needs beyond its stages: imports, summaries, comparisons and the nine components of priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.scalars import common_prefix
from quarrymill.operators.triage import rarity


def imported_positions(positions: DataFrame, key: str, file: str, line: str, game: Column, tiers: Mapping[str, DataFrame]) -> DataFrame:
    """positions with a reference to their source line, their game or that it is unknown, and which tiers have seen them."""
    out = positions.select(key, F.concat_ws(":", F.col(file).cast("string"), F.col(line).cast("string")).alias("source_ref"), game.cast("string").alias("game"), game.isNull().alias("game_unknown"))
    for name, rows in tiers.items():
        out = out.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


#: The streams of a funnel run's folder. Fixed values.
STREAMS = ("positions", "tier0", "tier1", "triage", "tier3", "tier4")


def read_run(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The streams of a run's folder by name, JSON lines each; one that isn't there is empty. schemas: by stream."""
    jvm = spark._jvm
    out = {}
    for name in STREAMS:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.jsonl")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        out[name] = spark.read.schema(schemas[name]).json(at.toString()) if there else spark.createDataFrame([], schemas[name])
    return out


def funnel_ids(rows: DataFrame, sources: DataFrame, source: str, row: str, funnel_id: str) -> DataFrame:
    """rows with their funnel id, looked up by source and row number, since row numbers of several sources collide."""
    return rows.join(sources.select(source, row, funnel_id), [source, row], "left")


def stage_costs(rows: DataFrame, stage: str, wall_ms: str, nodes: str) -> DataFrame:
    """(stage, rows, seconds, nodes): what each stage took."""
    return rows.groupBy(stage).agg(F.count(F.lit(1)).alias("rows"), F.bround(F.sum(wall_ms) / 1000, 6).alias("seconds"), F.sum(nodes).alias("nodes"))


def yield_ratio(rates: DataFrame, arm: str, rate: str, first: str, second: str) -> DataFrame:
    """One row: an arm's rate over another's; null if that is 0 or missing."""
    side = lambda a: F.max(F.when(F.col(arm) == a, F.col(rate)))
    return rates.agg(F.bround(F.try_divide(side(first), side(second)), 6).alias("ratio"))


def count_differences(ours: DataFrame, theirs: DataFrame, key: str, n: str) -> DataFrame:
    """(key, ours, theirs) of the keys whose counts differ; a missing key counts 0."""
    both = ours.select(key, F.col(n).alias("a")).join(theirs.select(key, F.col(n).alias("b")), key, "full_outer")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.where(a != b).select(key, a.alias("ours"), b.alias("theirs"))


def parity_differences(ours: DataFrame, theirs: DataFrame, key: str, tolerances: Mapping[str, float | None]) -> DataFrame:
    """(field, n, example): by field, how many common records differ by more than its tolerance, and the least key of those.

    A tolerance of None asks for equality, and infinity for nothing. Arrays differ if their lengths do, or any entry.
    """
    names = list(tolerances)
    both = ours.select(key, F.struct(*names).alias("a")).join(theirs.select(key, F.struct(*names).alias("b")), key)

    def off(name: str, most: float | None) -> Column:
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        if most == float("inf"):
            return F.lit(False)
        return ~a.eqNullSafe(b) if most is None else F.coalesce(F.abs(a - b) > most, a.isNull() != b.isNull())

    bad = F.array_compact(F.array(*(F.when(off(n, t), F.lit(n)) for n, t in tolerances.items())))
    return both.select(key, F.explode(bad).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example"))


def item_summary(items: Column) -> Column:
    """Of an array of items (kind, side): how many there are, of each side, which kinds, and whether both sides have some."""
    of = lambda s: F.size(F.filter(items, lambda x: x["side"] == s))
    kinds = F.array_sort(F.array_distinct(F.transform(items, lambda x: x["kind"])))
    return F.struct(F.size(items).alias("n"), of("w").alias("white"), of("b").alias("black"), kinds.alias("kinds"), ((of("w") > 0) & (of("b") > 0)).alias("both"))


def selected_labels(wanted: DataFrame, searches: DataFrame, key: str, budgets: str) -> DataFrame:
    """(key, last): the largest search so far of each wanted record; records without one are left out."""
    last = F.array_max(budgets)
    return searches.where(F.size(budgets) > 0).join(wanted.select(key).distinct(), key, "left_semi").select(key, last.alias("last"))


def tagged(triage: DataFrame, tags: str) -> DataFrame:
    """Rows with at least one tag."""
    return triage.where(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0)


def without_mates(rows: DataFrame, score: str, least: int = 100_000) -> DataFrame:
    """Rows whose score is no mate: |score| under ``least``. Studies differ in that number."""
    return rows.where(F.abs(F.col(score)) < least)


def linked_switches(records: DataFrame, evidence: DataFrame, path: str, switch: str) -> DataFrame:
    """records with the sorted set of switches that their path is evidence for; empty if none."""
    sets = evidence.groupBy(path).agg(F.array_sort(F.collect_set(switch)).alias("switches"))
    kind = sets.schema["switches"].dataType.simpleString()
    return records.join(sets, path, "left").withColumn("switches", F.coalesce("switches", F.array().cast(kind)))


def found_models(wanted: DataFrame, models: DataFrame, digest: str, name: str, model: str) -> DataFrame:
    """wanted with the model of its digest, or else of its file name; of several of one name the first by model."""
    by_digest = models.groupBy(digest).agg(F.min(model).alias("__d"))
    by_name = models.groupBy(name).agg(F.min(model).alias("__n"))
    return wanted.join(by_digest, digest, "left").join(by_name, name, "left").select(*wanted.columns, F.coalesce("__d", "__n").alias(model))


def worst_state(rows: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """(key, state): of each key's states the one that stands first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    return rows.where(rank > 0).groupBy(key).agg(F.min_by(state, rank).alias(state))


def registry(objects: DataFrame, object_id: str, kind: str) -> DataFrame:
    """Objects of a kind with the number in their id, by which they are listed."""
    return objects.where(F.col(object_id).rlike(rf"^{kind}\d+$")).withColumn("number", F.substring(object_id, len(kind) + 1, 20).cast("long"))


def next_number(objects: DataFrame, object_id: str, kind: str, reserved: Sequence[int] = ()) -> int:
    """The number after the largest of a kind and of those reserved; 1 if there is none."""
    most = registry(objects, object_id, kind).agg(F.max("number")).first()[0] or 0
    return max([most, *reserved]) + 1


#: How unsure a search is by its status, and how far scores count. Fixed values.
UNSURE = {"stable-at-budget": 0.0, "exact-tablebase": 0.0, "verified-forced-mate": 0.0, "unresolved-at-budget": 0.75, "omission-risk": 0.75, "verifier-conflict": 1.0, "unstable-trajectory": 1.0}
CLAMP = 2000


def outcome_against(score: Column, result: Column, margin: float, scale: float) -> Column:
    """How far a game's result speaks against white's score, from 0 to 1: beyond a margin, in units of a scale; half as much for a draw."""
    s = F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), score.cast("int"))).cast("double")
    against = F.when(result == 1, -s).when(result == 0, s).otherwise(F.abs(s) * 0.5)
    known = result.isNotNull() & score.isNotNull()
    return F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), against - margin) / scale)).otherwise(0.0)


def priority_components(
    change: Column, moved: Column, status: Column, pv_before: Column, pv_after: Column, tactics: Column, slug_counts: Column, bucket_count: Column, total: Column, score: Column,
    result: Column, in_check: Column, legal_moves: Column, skips: Column, reasons: Column, caps: Mapping[str, float], share: float, least: float,
) -> dict[str, Column]:
    """The nine components of a position's priority, each from 0 to 1, as columns.

    change: of the score between the least and the largest budget. moved: whether the best move changed. tactics: how many
    tactical items it has. slug_counts: how often each of its slugs is seen before; bucket_count: how often its material
    is. score: white's. result: the game's, for white. skips: moves that the search left out; reasons: why it is unsure.
    """
    unsure = F.lit(0.5)
    for name, value in UNSURE.items():
        unsure = F.when(status == name, F.lit(value)).otherwise(unsure)
    shorter = F.least(F.size(pv_before), F.size(pv_after))
    slugs = F.coalesce(F.array_max(F.transform(slug_counts, lambda c: rarity(c, total, share, least))), F.lit(0.0))
    partial = F.coalesce(F.array_contains(reasons, "partial-iteration-move-shift"), F.lit(False))
    return {
        "scoreInstability": F.least(F.lit(1.0), F.abs(change) / caps["scoreDeltaCp"]),
        "bestMoveChange": F.coalesce(moved, F.lit(False)).cast("double"),
        "trajectoryUnstable": unsure,
        "pvDisagreement": F.when(shorter > 0, 1 - common_prefix(pv_before, pv_after) / shorter).otherwise(0.0),
        "tacticalDensity": F.least(F.lit(1.0), tactics / caps["tacticalItems"]),
        "rarity": F.greatest(slugs, 0.5 * rarity(F.coalesce(bucket_count, F.lit(0)), total, share, least)),
        "outcomeDisagreement": outcome_against(score, result, caps["outcomeMarginCp"], caps["outcomeScaleCp"]),
        "selectivityEdge": F.when(partial, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(skips, F.lit(0)) / caps["seePruneSkips"])),
        "forcedness": (F.coalesce(in_check, F.lit(False)) | F.coalesce(legal_moves <= caps["forcedLegalMoves"], F.lit(False))).cast("double"),
    }
