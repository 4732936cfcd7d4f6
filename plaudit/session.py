"""Session settings for large inputs. A session that the cluster hands over is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A join side that Spark estimates below this is broadcast, rather than shuffling whole texts.
BROADCAST_BYTES = 128 * 1024 * 1024

# Bytes of shuffled data that one task should get.
TASK_BYTES = 512 * 1024 * 1024

# Bytes in memory for one stored byte of dictionary-coded text, for the plan's size estimates.
COMPRESSION = 4.0


def settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job whose largest shuffle moves about ``shuffle_bytes``.

    Shuffles start with one partition per ``TASK_BYTES``; adaptive execution merges what turns out
    small, and splits the partitions of a hot join key even where that costs one more shuffle.
    """
    partitions = max(cores, -(-shuffle_bytes // TASK_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
        "spark.sql.sources.fileCompressionFactor": str(COMPRESSION),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Long texts: keep the Arrow batches of the stemmer small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.session.timeZone": "UTC",
    }


def build_session(shuffle_bytes: int, cores: int, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("plaudit")
    if master is not None:
        builder = builder.master(master)
    for key, value in {**settings(shuffle_bytes, cores), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
