"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine's results or plans rely on. Sizes (partitions, memory) are
# the cluster's business: AQE coalesces from its spark.sql.shuffle.partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode. Wide stages that
    # would exceed it run operator by operator instead, in small compiled methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Spark 4.1 takes a union of bucketed scans for grouped by the bucket column and
    # leaves out the exchange that would group it: wrong rows above stored state.
    "spark.sql.unionOutputPartitioning": "false",
    # Rows that come sorted by the group are folded as they come: once, without a hash table, a fallback to a sort and a second pass.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # In a reply that names a field twice the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only a new session can take.
BUILD_SETTINGS = {
    # Call sites of thousands of column expressions cost seconds per plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# What a run lands and what the state stores is text for the most part: a third smaller than with Spark's default.
PARQUET_CODEC = "zstd"

_PLANNED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to a session that someone else built.

    The session's limit for broadcasts holds for sizes that a shuffle has measured. Planned sizes
    are those of the files read, which say nothing of rows that an explode or a JSON text makes of them.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(_MEASURED, None) is None:
        spark.conf.set(_MEASURED, spark.conf.get(_PLANNED))
    spark.conf.set(_PLANNED, "-1")
    return spark


def fits_broadcast(spark: SparkSession, size: int) -> bool:
    """Whether so many bytes, counted and not estimated, are within the session's limit for broadcasts."""
    limit = spark.conf.get(_MEASURED, None) or spark.conf.get(_PLANNED)
    # a limit below zero is none to be broadcast, and no size that can be read
    return not limit.startswith("-") and size <= spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelshelf")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **BUILD_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors can reach.

    The cluster names the parent in spark.checkpoint.dir. Only a local session
    without that setting gets a machine-local one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="reelshelf-")
    return f"{base.rstrip('/')}/reelshelf/{purpose}-{uuid.uuid4().hex}"


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the scratch folder and read back, for what several plans use."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", PARQUET_CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
