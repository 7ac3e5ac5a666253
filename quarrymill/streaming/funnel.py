"""Staged labelling that resumes where it stopped, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.sequences import sessions_by_counter

#: A store of streaming state whose cost for a batch follows the keys that the batch touches, not those seen before.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def done_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """What a stage has written so far; None before its first rows. Any other fault of reading is an error."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.exists(at) and any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at))
    return spark.read.parquet(path) if done else None


def pending_rows(rows: DataFrame, done: DataFrame | None, key: str = "id") -> DataFrame:
    """One row of each key that has no result yet."""
    first = rows.dropDuplicates([key])
    return first if done is None else first.join(done.select(key), key, "left_anti")


def run_stage(rows: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "id") -> None:
    """Appends work(rows) for the keys that have no result yet, each once. Running it again does nothing more."""
    work(pending_rows(rows, done_rows(rows.sparkSession, path), key)).write.mode("append").parquet(path)


def stream_stage(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "id"):
    """Appends work(rows) for each key of a stream once, however often it comes.

    Which keys have been seen is keyed state in the checkpoint, and a batch looks up its own keys only; the results that
    are there already are never read. The file sink keeps a log of batches, so a batch that is run again adds nothing.
    ``work`` must be one that a stream allows: row by row, without aggregations of its own. Results belong to the
    checkpoint: a stage is run as a stream or in batch, not both.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        return work(stream.dropDuplicates([key])).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def stream_sessions(stream: DataFrame, path: str, checkpoint: str, source: str = "source", row: str = "row", counter: str = "counter"):
    """Game sessions of a stream: ``sessions_by_counter`` over all micro-batches, with late rows told apart.

    Rows of a source come in the order of their row numbers, in any batches. What goes on from a batch to the next is
    one row a source: its last row number, its last counter and its number of sessions. It is kept under
    ``checkpoint/sources`` by batch, and results under ``path/batch=N``, both overwritten when a batch is run again,
    so a replay gives the same rows. A row whose number isn't above its source's last one of earlier batches, or is
    null, is late: it is kept with a null session and moves nothing. A batch reads its rows and that state, never the
    results; within it a source of any size is spread over range partitions. A null counter begins a session, as does
    the row after it; null sources are one source.
    """
    spark, state = stream.sparkSession, f"{checkpoint}/sources"

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(source, row, counter)
        # Batches are numbered without gaps, so a missing state of the one before is a fault and no first batch.
        before = spark.read.parquet(f"{state}/batch={number - 1}") if number else None
        if before is None:
            before = spark.createDataFrame([], rows.select(source, F.col(row).alias("__row"), F.col(counter).alias("__counter"), F.lit(0).cast("long").alias("__sessions")).schema)
        before = before.withColumnsRenamed({source: "__source"})
        joined = rows.join(before, rows[source].eqNullSafe(before["__source"]), "left")
        late = F.col(row).isNull() | F.coalesce(F.col(row) <= F.col("__row"), F.lit(False))
        # The last row of before stands in front of a source's new ones, as the one whose session goes on.
        fresh = joined.where(~late).select(source, row, counter, F.lit(False).alias("__old"))
        last = before.select(F.col("__source").alias(source), F.col("__row").alias(row), F.col("__counter").alias(counter), F.lit(True).alias("__old"))
        found = sessions_by_counter(last.unionByName(fresh), source, [row], counter).withColumn("__n", F.substring("session", 2, 20).cast("long"))
        again = found.join(before.select(F.col("__source"), "__sessions"), found[source].eqNullSafe(F.col("__source")), "left")
        total = F.col("__n") + F.coalesce(F.col("__sessions") - 1, F.lit(0))
        out = again.where("not __old").select(source, row, counter, F.format_string("g%06d", total).alias("session"))
        out = out.unionByName(joined.where(late).select(source, row, counter, F.lit(None).cast("string").alias("session")))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        now = again.groupBy(source).agg(F.max(row).alias("__row"), F.max_by(counter, row).alias("__counter"), F.max(total).alias("__sessions"))
        now.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts by event-time window and key; rows later than ``lateness`` are left out."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


class IdentityError(ValueError):
    """A run's folder that belongs to another identity, or to none."""


def pin_identity(spark: SparkSession, path: str, identity: Mapping[str, object], stages: Sequence[str] = ("tier0", "tier1", "triage", "tier3", "tier4")) -> bool:
    """Writes a run's identity into its folder before its first stage, or holds it against the one that is there; True if it was written.

    Any differing field is refused, named, so that evidence of two policies never mixes; so is a folder that has results
    of stages and no identity. Values are compared as JSON.
    """
    files = spark._jvm.org.apache.hadoop.fs
    at = files.Path(f"{path}/identity")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    now = {k: json.loads(json.dumps(v)) for k, v in identity.items()}
    if fs.exists(at):
        then = json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])
        if differing := sorted(k for k in {*then, *now} if then.get(k) != now.get(k)):
            raise IdentityError(f"the run's identity differs in {', '.join(differing)}")
        return False
    results = [s for s in stages if any(fs.exists(files.Path(f"{path}/{s}{end}")) for end in ("", ".jsonl"))]
    if results:
        raise IdentityError(f"the folder has results of {', '.join(results)} and no identity")
    out = fs.create(at, False)
    try:
        out.write(bytearray(json.dumps(now, sort_keys=True).encode()))
    finally:
        out.close()
    return True


def input_rows(spark: SparkSession, paths: Sequence[str]) -> int:
    """How many rows the pool's files have, counted again from the files, so that a run that resumes knows it too."""
    return spark.read.text(list(paths)).where(F.trim("value") != "").count() if paths else 0
