"""A Spark session with the settings that this library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Bytes that a task reads of files and of shuffles at most, and bytes of input for each partition that a shuffle begins with.
SPLIT, ADVISORY, BEGINS = 16 << 20, 8 << 20, 4 << 20


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "spindle") -> SparkSession:
    """A local session for tests and benchmarks; a cluster sets these values itself."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPINDLE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stored_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of the files and folders that are there, in any store that Spark reads."""
    total = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return total


def sized(spark: SparkSession, stored: int) -> SparkSession:
    """A session beside the given one, which stays as it is: its shuffles have partitions in proportion to the stored bytes,
    so that a task's memory doesn't grow with the input, and it broadcasts what was measured as small, not what files make
    seem small: columns of few values, keys in order and names made from them are a hundred times larger in memory.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    conf = own._jsparkSession.sessionState().conf()
    measured = conf.autoBroadcastJoinThreshold()
    if own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(measured))
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(conf.numShufflePartitions(), -(-stored // BEGINS))))
    for name, most in (("spark.sql.files.maxPartitionBytes", SPLIT), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISORY)):
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own.conf.get(name)) > most:
            own.conf.set(name, str(most))
    return own
