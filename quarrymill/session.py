"""Session defaults, and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "quarrymill") -> SparkSession:
    """A local session with the settings that the engine expects (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_partitions(spark: SparkSession) -> int:
    """How many range partitions an order is cut into: as many as shuffles have, which a cluster sets by its data."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get(PARTITIONS)))


#: Spark's setting for deleting the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting for the number of shuffle partitions, and how many rows one of them should have at most where rows are known.
PARTITIONS = "spark.sql.shuffle.partitions"
ROWS_A_TASK = 500_000
#: Spark's setting for putting small shuffle partitions together, which goes by bytes and knows no rows.
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


class Scratch:
    """Parquet tables in the folder that the driver and all executors share.

    A written table cuts the lineage and outlives its writers, so that a lost executor costs the rereading of
    files and nothing more. The folder is the session's ``spark.checkpoint.dir``; only where that is unset (local
    runs and tests) a temporary folder is used, which a cluster must not do.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="quarrymill-")
        self.spark, self.root = spark, f"{base}/quarrymill-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, rows: int = 0) -> DataFrame:
        """``df`` written and read back. Names must be new within one Scratch.

        ``rows``, how many go into its shuffles, cuts these finer than the session does if a task had over ROWS_A_TASK.
        """
        path = f"{self.root}/{name}"
        # The shuffles that made the table go with the write; no one reads them again.
        settings = {CLEANUP: "true"}
        if rows // ROWS_A_TASK > int(self.spark.conf.get(PARTITIONS)):
            settings |= {PARTITIONS: str(rows // ROWS_A_TASK), COALESCE: "false"}
        before = {k: self.spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)
