"""Run lattices, their completeness and comparability, matrices, and the provenance map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership(lattice: DataFrame, runs: DataFrame, cell: Sequence[str], status: str, done: str = "COMPLETED") -> DataFrame:
    """For each cell of the lattice or with runs: completed and other runs, and whether it is missing, duplicate or extra.

    lattice must be small in itself (the product of a few dimensions); runs are counted by cell first.
    """
    per = runs.groupBy(*cell).agg(F.count_if(F.col(status) == done).alias("completed"), F.count_if(F.col(status) != done).alias("other"))
    both = lattice.withColumn("__e", F.lit(True)).join(per.withColumn("__h", F.lit(True)), list(cell), "full")
    n = F.coalesce("completed", F.lit(0))
    state = F.when(F.col("__e").isNull(), "extra").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("complete")
    return both.select(*cell, n.alias("completed"), F.coalesce("other", F.lit(0)).alias("other"), state.alias("state"))


def incomparable(runs: DataFrame, cell: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Cells whose runs don't share one identity (protocol, dataset, spec ...)."""
    return runs.groupBy(*cell).agg(F.countDistinct(F.struct(*identity)).alias("identities")).where("identities > 1")


def matrix(runs: DataFrame, row: str, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """A row for each ``row`` with the mean measure and the count of runs in each of the given columns."""
    aggs = [c for v in values for c in (F.bround(F.avg(F.when(F.col(column) == v, F.col(measure))), 6).alias(f"mean_{v}"), F.count_if(F.col(column) == v).alias(f"runs_{v}"))]
    return runs.groupBy(row).agg(*aggs)


def slices(rows: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    """Mean measure by each slice, in long form."""
    pairs = F.array(*(F.struct(F.lit(b).alias("slice"), F.col(b).cast("string").alias("key")) for b in by))
    return rows.select(F.inline(pairs), measure).groupBy("slice", "key").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(measure), 6).alias("mean"))


def edges(relations: Mapping[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(kind, src, dst): the provenance map as one list of distinct edges."""
    parts = [df.select(F.lit(kind).alias("kind"), a.cast("string").alias("src"), b.cast("string").alias("dst")) for kind, (df, a, b) in relations.items()]
    return reduce(lambda x, y: x.unionByName(y), parts).where("src is not null and dst is not null").distinct()


def masked(vector: Column, lost: Sequence[int]) -> Column:
    """A vector with some entries set to 0."""
    gone = F.array(*(F.lit(i) for i in lost))
    return F.transform(vector, lambda x, i: F.when(F.array_contains(gone, i), F.lit(0.0)).otherwise(x.cast("double")))


def linear(vector: Column, weights: Sequence[float]) -> Column:
    """The dot product of a vector and fixed weights."""
    return F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def first_reaching(rows: DataFrame, by: Sequence[str], rung: str, holds: Column) -> DataFrame:
    """(by, rung): the cheapest rung on which a condition holds; null if on none."""
    return rows.groupBy(*by).agg(F.min(F.when(holds, F.col(rung))).alias(rung))


def best_rung(rows: DataFrame, by: Sequence[str], rung: str, measure: str) -> DataFrame:
    """(by, rung): the rung of least mean measure, the smaller of equal ones."""
    means = rows.groupBy(*by, rung).agg(F.avg(measure).alias("m"))
    return means.groupBy(*by).agg(F.min_by(rung, F.struct("m", rung)).alias(rung))
