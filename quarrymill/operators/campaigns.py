"""Study rules over runs: completeness, contrasts between subsets and regimes, reproduction, budgets and costs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.stats import mean_interval, paired
from quarrymill.sources.readers import content_hash


def full_membership(lattice: DataFrame, runs: DataFrame, cell: Sequence[str], status: str, replaces: str) -> DataFrame:
    """For each cell of the lattice or with runs: how many runs are completed, invalid, and invalid but replaced by a completed
    one, and the state: extra, missing, duplicate or complete.

    ``replaces`` is a boolean column: whether the run is a retry. The lattice must be small in itself.
    """
    done, invalid = F.col(status) == "COMPLETED", F.col(status) == "INVALID"
    per = runs.groupBy(*cell).agg(F.count_if(done).alias("completed"), F.count_if(invalid).alias("invalid"), F.count_if(done & F.col(replaces)).alias("retries"))
    both = lattice.withColumn("__e", F.lit(True)).join(per, list(cell), "full")
    n, bad, again = (F.coalesce(c, F.lit(0)) for c in ("completed", "invalid", "retries"))
    state = F.when(F.col("__e").isNull(), "extra").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("complete")
    return both.select(*cell, n.alias("completed"), bad.alias("invalid"), F.when(n > 0, F.least(bad, again)).otherwise(0).alias("replaced"), state.alias("state"))


def recovered(runs: DataFrame, cell: Sequence[str], status: str) -> DataFrame:
    """(cell, orphans, retry): running runs of a stopped session count as invalid, and a cell with invalid runs alone gets one
    retry, if it had one run only."""
    orphan = F.col(status) == "RUNNING"
    invalid = orphan | (F.col(status) == "INVALID")
    per = runs.groupBy(*cell).agg(F.count_if(orphan).alias("orphans"), F.count(F.lit(1)).alias("n"), F.bool_and(invalid).alias("bad"))
    return per.select(*cell, "orphans", (F.col("bad") & (F.col("n") == 1)).alias("retry"))


def subset_contrasts(rows: DataFrame, width: str, seed: str, arm: str, first: str, second: str, value: str, subsets: Mapping[str, Column]) -> DataFrame:
    """(subset, width, n, mean, low, high): the paired contrast of two arms by width, on each named subset of the seeds."""
    d = paired(rows, [width, seed], arm, first, second, value)
    tags = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in subsets.items())))
    return mean_interval(d.withColumn("subset", F.explode(tags)), ["subset", width], F.col("d"))


def between_regimes(contrasts: DataFrame, regime: str, first: str, second: str, width: str, value: str) -> DataFrame:
    """(width, difference): a contrast in one regime less that in another, for widths that have both."""
    side = lambda r: F.max(F.when(F.col(regime) == r, F.col(value)))
    per = contrasts.groupBy(width).agg((side(first) - side(second)).alias("difference"))
    return per.where("difference is not null")


def reproduced(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: how many keys both have, one alone has, and differ by more than the tolerance; and whether all is reproduced."""
    a, b = ours.select(*keys, F.col(value).alias("a")), theirs.select(*keys, F.col(value).alias("b"))
    both = a.join(b, list(keys), "full_outer")
    alone = F.count_if(F.col("a").isNull() | F.col("b").isNull())
    off = F.count_if(F.abs(F.col("a") - F.col("b")) > tolerance)
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), alone.alias("alone"), off.alias("differ"), ((alone == 0) & (off == 0)).alias("reproduced"))


def prefix_calibration(costs: DataFrame, cost: str, target: float, universe: int, headroom: float = 1.15, up: bool = True) -> DataFrame:
    """One row: the mean cost of a calibration sample, the rows that a budget buys at it, and whether the universe has enough more."""
    rows = (F.ceil if up else F.floor)(F.lit(target) / F.col("mean"))
    mean = costs.agg(F.count(cost).alias("sample"), F.avg(cost).alias("mean"))
    return mean.select("sample", "mean", rows.cast("long").alias("rows"), (F.lit(universe) >= headroom * rows).alias("enough"))


def bought_prefix(chunks: Sequence[DataFrame], buy: Callable[[DataFrame], DataFrame], cost: str, target: float) -> tuple[list[DataFrame], float]:
    """Chunks of a frozen order, bought one after the other until their summed cost reaches the target; and that cost.

    For costs that only a purchase tells, so each chunk waits for the one before. ``buy`` labels a chunk and gives back
    rows with their cost, written, so that a second look costs no second purchase. Known costs go to ``affordable``.
    """
    have, total = [], 0.0
    for chunk in chunks:
        if total >= target:
            break
        got = buy(chunk)
        have.append(got)
        total += got.agg(F.sum(cost)).first()[0] or 0.0
    return have, total


def affordable(rows: DataFrame, chunk: str, cost: str, target: Column) -> DataFrame:
    """(chunk, cost, spent): the chunks, in their order, that are bought until their summed cost reaches the target.

    One aggregation by chunk, and a running sum over the chunks alone. ``target`` may use ``total``, the cost of all.
    """
    per = rows.groupBy(chunk).agg(F.coalesce(F.sum(cost), F.lit(0)).alias("cost"))
    run, all_of_it = F.sum("cost").over(Window.orderBy(chunk)), F.sum("cost").over(Window.partitionBy())
    spent = per.select(chunk, "cost", run.alias("spent"), all_of_it.alias("total"))
    return spent.where(F.col("spent") - F.col("cost") < target).select(chunk, "cost", "spent")


def prefix_proof(rows: DataFrame, key: str, cost: str, by: Sequence[str] = ()) -> DataFrame:
    """What two realisations of a prefix must have alike, for each ``by``: rows, distinct ids, the ids' hash and the summed cost.

    Rows of an id are added up first, so what is shuffled is its count and cost and not the hash's sums.
    """
    per = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("__n"), F.sum(cost).alias("__cost"))
    parts = [F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(key).alias("ids"), content_hash(F.col(key).cast("string"), F.col("__n")).alias("ids_hash"), F.sum("__cost").alias("cost")]
    return per.groupBy(*by).agg(*parts)


def _beside(sums: DataFrame, arm: str, reference: str, **columns: str) -> DataFrame:
    """sums with the reference arm's values in every row; null where there is no such arm. It is one row, made by an aggregate."""
    ref = sums.agg(*(F.max(F.when(F.col(arm) == reference, F.col(c))).alias(name) for name, c in columns.items()))
    return sums.crossJoin(F.broadcast(ref))


def ratios(rows: DataFrame, arm: str, cost: str, reference: str) -> DataFrame:
    """(arm, rows, cost, cost_ratio, row_ratio): each arm's rows and cost, and relative to a reference arm; null ratios without it."""
    sums = rows.groupBy(arm).agg(F.count(F.lit(1)).alias("rows"), F.sum(cost).alias("cost"))
    both = _beside(sums, arm, reference, __r="rows", __c="cost")
    return both.select(arm, "rows", "cost", F.bround(F.try_divide("cost", "__c"), 6).alias("cost_ratio"), F.bround(F.try_divide("rows", "__r"), 6).alias("row_ratio"))


def nominal_costs(rows: DataFrame, arm: str, budget: str, reference: str) -> DataFrame:
    """(arm, nominal, ratio): rows times their node budget, and relative to a reference arm; null ratios without it."""
    sums = rows.groupBy(arm).agg(F.sum(budget).cast("double").alias("nominal"))
    both = _beside(sums, arm, reference, __n="nominal")
    return both.select(arm, "nominal", F.bround(F.try_divide("nominal", "__n"), 6).alias("ratio"))


def generalisation_gap(losses: DataFrame, arm: str, split: str, loss: str, train: str, exam: str) -> DataFrame:
    """(arm, gap): the mean training loss less the mean exam loss; null if an arm lacks one."""
    side = lambda s: F.avg(F.when(F.col(split) == s, F.col(loss)))
    return losses.groupBy(arm).agg(F.bround(side(train) - side(exam), 6).alias("gap"))


def parameter_counts(inputs: Column, hidden: Column) -> Column:
    """The parameters of a network with one hidden layer, or of a linear one where hidden is 0: total, and those that inference needs
    of a network whose auxiliary heads (``inputs`` of nothing) are for training alone."""
    return F.when(hidden > 0, inputs * hidden + 2 * hidden + 1).otherwise(inputs + 1)


def parameter_accounting(models: DataFrame, name: str, inputs: str, hidden: str, heads: str) -> DataFrame:
    """(name, total, inference, training_only): each auxiliary head has a weight for each hidden unit and a bias."""
    inference = parameter_counts(F.col(inputs), F.col(hidden))
    extra = F.col(heads) * (F.col(hidden) + 1)
    return models.select(name, (inference + extra).alias("total"), inference.alias("inference"), extra.alias("training_only"))


def loss_per_parameter(runs: DataFrame, name: str, loss: str, parameters: str) -> DataFrame:
    """(name, loss, per_parameter): the mean loss, and that divided by the parameters. A ratio, not a score."""
    per = runs.groupBy(name).agg(F.avg(loss).alias("loss"), F.max(parameters).alias("__p"))
    return per.select(name, F.bround("loss", 6).alias("loss"), F.bround(F.try_divide("loss", "__p"), 9).alias("per_parameter"))


def auxiliary_quality(rows: DataFrame, family: str, target: str, predicted: str) -> DataFrame:
    """(family, n, mse, mae, accuracy): how well auxiliary targets are predicted; accuracy by their rounded values."""
    e = F.col(predicted) - F.col(target)
    right = (F.bround(F.col(predicted), 0) == F.bround(F.col(target), 0)).cast("double")
    per = rows.where(F.col(predicted).isNotNull() & F.col(target).isNotNull()).groupBy(family)
    return per.agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(e * e), 6).alias("mse"), F.bround(F.avg(F.abs(e)), 6).alias("mae"), F.bround(F.avg(right), 6).alias("accuracy"))


def arm_effect(rows: DataFrame, key: str, arm: str, first: str, second: str, value: str) -> DataFrame:
    """(key, a, b, d): each record's mean over seeds in two arms, and the second's less the first's, where both are finite."""
    v = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) < float("inf")), F.col(value).cast("double"))
    per = rows.groupBy(key).agg(F.avg(F.when(F.col(arm) == first, v)).alias("a"), F.avg(F.when(F.col(arm) == second, v)).alias("b"))
    return per.where("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))


def finding(low: Column, high: Column, effect: Column, least: float, direction: str = "lower") -> Column:
    """SUPPORTED if an interval lies on the wanted side of 0 and the effect is at least ``least``; REJECTED if it lies on the other
    side; INVALID without an interval; else INCONCLUSIVE."""
    good, bad = (high < 0, low > 0) if direction == "lower" else (low > 0, high < 0)
    return F.when(low.isNull() | high.isNull(), "INVALID").when(good & (F.abs(effect) >= least), "SUPPORTED").when(bad, "REJECTED").otherwise("INCONCLUSIVE")


def arm_symmetry(settings: DataFrame, arm: str, name: str, value: str, free: Sequence[str]) -> DataFrame:
    """(name, values): the settings that differ between arms though they aren't what the arms are about; absence is a value."""
    arms = settings.select(F.count_distinct(arm).alias("__all"))
    per = settings.where(~F.col(name).isin(*free)).groupBy(name).agg(F.count_distinct(value).alias("values"), F.count_distinct(arm).alias("__have"))
    both = per.crossJoin(F.broadcast(arms))
    return both.where((F.col("values") > 1) | (F.col("__have") < F.col("__all"))).select(name, (F.col("values") + (F.col("__have") < F.col("__all")).cast("int")).alias("values"))


def switch_changes(switches: DataFrame, baseline: DataFrame, run: str, name: str, value: str) -> DataFrame:
    """(run, name, base, value): the switches in which a run differs from the baseline, missing ones included."""
    theirs = baseline.select(name, F.col(value).alias("base"))
    both = switches.select(run, name, value).join(theirs, name, "left")
    return both.where(~F.col(value).eqNullSafe(F.col("base"))).select(run, name, "base", value)


def identity_hash(*parts: Column) -> Column:
    """The identity of a plan, spec or policy: a hash of its parts as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def scaling(runs: DataFrame, metrics: DataFrame, run: str, size: str, name: str, value: str) -> DataFrame:
    """(size, name, runs, mean, least, largest): metrics of runs by the size of their model."""
    return runs.select(run, size).join(metrics, run).groupBy(size, name).agg(F.count_distinct(run).alias("runs"), F.bround(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"))


class GateError(ValueError):
    """Runs that no comparison may be made of."""


def study_gate(runs: DataFrame, design: DataFrame, cell: Sequence[str], run: str, experiment: str, contract: Sequence[str], status: str, replaces: str) -> str:
    """The experiment that all runs belong to; raises unless they are one experiment's whole matrix with every contract kept.

    design: experiment, the cell and the contract columns (what a run of that cell must have been made with), one row a
    cell, small in itself. Refused are: no runs, runs of several experiments or of none, cells beyond the design, contracts
    that differ, and cells without a completed run or with several.
    """
    found = [r[0] for r in runs.select(experiment).distinct().orderBy(experiment).limit(5).collect()]
    if len(found) != 1 or found[0] is None:
        raise GateError(f"runs must be of one experiment: {found}")
    own = design.where(F.col(experiment) == found[0])
    due = own.select(*cell, *(F.col(c).alias(f"__{c}") for c in contract), F.lit(True).alias("__due"))
    both = runs.join(due, list(cell), "left")
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in contract)))
    why = F.when(F.col("__due").isNull(), F.lit("its cell isn't in the design")).when(F.size(wrong) > 0, F.concat(F.lit("it differs in "), F.array_join(wrong, ", ")))
    bad = both.select(run, why.alias("why")).where("why is not null").orderBy(run).limit(20).collect()
    if bad:
        raise GateError("; ".join(f"{r[run]}: {r['why']}" for r in bad))
    states = full_membership(own.select(*cell), runs, cell, status, replaces).where("state <> 'complete'").orderBy(*cell).limit(20).collect()
    if states:
        raise GateError("; ".join(f"{tuple(r[c] for c in cell)} {r['state']}" for r in states))
    return found[0]
