"""Sessions and order-dependent selections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import Scratch, range_partitions


def _numbered(rows: DataFrame, source: str, order: Sequence[str], value: Column, begins: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with ``__number``: in its source's order, how many rows so far begin a session, as ``begins`` tells from a row's
    value and the one before it. A source's first row always does.

    A source of any size is spread over range partitions, which are written first, since bounds are sampled and come out
    differently when a plan is run twice. What goes on from one partition to the next is its last row, and the sums of
    the sources that cross its bounds.
    """
    spark = rows.sparkSession
    n = range_partitions(spark)
    place = F.struct(source, *order)
    held = rows.withColumn("__v", value).repartitionByRange(n, source, *order).withColumn("__p", F.spark_partition_id())
    held = Scratch(spark).table(held, "ranges")
    ends = held.groupBy("__p").agg(F.max_by(F.struct(F.col(source).alias("s"), F.col("__v").alias("v")), place).alias("last"), F.min(source).alias("__first"), F.max(source).alias("__last"))
    ends = ends.withColumn("__before", F.lag("last").over(Window.orderBy("__p"))).drop("last")
    within = Window.partitionBy("__p", source).orderBy(*order)
    marked = held.join(F.broadcast(ends), "__p").withColumn("__k", F.row_number().over(within))
    goes_on = F.col("__before.s").eqNullSafe(F.col(source)) & F.col("__before").isNotNull()
    starts = F.when(F.col("__k") > 1, begins(F.col("__v"), F.lag("__v").over(within))).when(goes_on, begins(F.col("__v"), F.col("__before.v"))).otherwise(True)
    marked = marked.withColumn("__start", F.coalesce(starts, F.lit(True)).cast("int"))
    crossing = marked.where(F.col(source).eqNullSafe(F.col("__first")) | F.col(source).eqNullSafe(F.col("__last"))).groupBy("__p", source).agg(F.sum("__start").alias("sum"))
    # At most two rows a partition.
    earlier = F.sum("sum").over(Window.partitionBy(source).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    carried = crossing.select("__p", F.col(source).alias("__s"), F.coalesce(earlier, F.lit(0)).alias("__carried"))
    out = marked.join(F.broadcast(carried), (marked["__p"] == carried["__p"]) & marked[source].eqNullSafe(carried["__s"]), "left").drop(carried["__p"])
    number = F.coalesce("__carried", F.lit(0)) + F.sum("__start").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("__number", number).select(*rows.columns, "__number")


def sessions_by_counter(rows: DataFrame, source: str, order: Sequence[str], counter: str, explicit: str | None = None) -> DataFrame:
    """rows with a session: the explicit one where given, else a new one whenever the counter doesn't advance.

    Explicit rows don't move the counter.
    """
    unnamed = rows.where(F.col(explicit).isNull()) if explicit else rows
    found = _numbered(unnamed, source, order, F.col(counter), lambda v, before: v <= before)
    found = found.withColumn("session", F.format_string("g%06d", "__number")).drop("__number")
    return found.unionByName(rows.where(F.col(explicit).isNotNull()).withColumn("session", F.col(explicit))) if explicit else found


def sessions_by_gap(rows: DataFrame, source: str, time: str, seconds: int, tie: str) -> DataFrame:
    """rows with a session number of their source; a longer gap than ``seconds`` starts one."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return _numbered(rows, source, [time, tie], micros, lambda v, before: v - before > seconds * 1_000_000).withColumnRenamed("__number", "session")


def universe_order(old: DataFrame, new: DataFrame, key: str, position: str, order: Column) -> DataFrame:
    """(key, segment, position, order): the old rows that survive in their order, then the new ones by hash order.

    The order is given as sortable columns, which range-partitioning can use, rather than as row numbers.
    """
    kept = old.join(new.select(key), key, "left_semi").select(key, F.lit(0).alias("segment"), F.col(position).cast("long").alias("position"), F.lit("").alias("order"))
    fresh = new.select(key).join(old.select(key), key, "left_anti").select(key, F.lit(1).alias("segment"), F.lit(0).cast("long").alias("position"), order.alias("order"))
    return kept.unionByName(fresh)


def monotone(rows: DataFrame, within: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is smaller than the one before it; none if sizes nest."""
    before = F.lag(value).over(Window.partitionBy(*within).orderBy(order))
    return rows.withColumn("previous", before).where(F.col(value) < F.col("previous"))
