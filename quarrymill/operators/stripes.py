"""A map over rows dealt out in stripes, whose results come back in the rows' order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import Scratch, range_partitions

PLACE = "__place"


def striped_map(rows: DataFrame, order: Sequence[str], work: Callable[[DataFrame], DataFrame], stripes: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """work(rows), with partitions, and rows within them, in the order of ``order``.

    Rows are cut into range partitions once, which are written with each row's place. Then they are dealt out in turn
    to stripes, so that neighbours, which may be alike in cost, are worked on by different tasks. ``work`` gives one
    row for each row and keeps the column ``__place``. Results go back to the partition that their place names, and
    only partitions are sorted. Fails if a place is missing or there twice: work must neither drop nor repeat rows.
    Rows that are equal in ``order`` stay in the order that the written table has. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch, n = scratch or Scratch(spark), range_partitions(spark)
    ranges = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    held = scratch.table(ranges.withColumn(PLACE, place), "ranges")
    stripes = stripes or n
    # Within a partition places are numbered one by one.
    dealt = held.repartitionById(stripes, F.pmod(F.col(f"{PLACE}.at"), F.lit(stripes)).cast("int"))
    done = scratch.table(work(dealt), "worked")
    if PLACE not in done.columns:
        raise ValueError(f"work must keep the column {PLACE}")
    counts = done.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(PLACE).alias("places"), F.count(PLACE).alias("known")).first()
    given = held.count()
    if set(counts) != {given}:
        raise ValueError(f"{given} rows were given, and {counts['rows']} came back with {counts['places']} places")
    return done.repartitionById(n, F.col(f"{PLACE}.part")).sortWithinPartitions(f"{PLACE}.at").drop(PLACE)
