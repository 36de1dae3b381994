"""SparkSession construction with the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings the semantics depend on: zone-less timestamps, UTC, ANSI errors.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, and turn sort-merge joins into broadcast joins only
    # when the measured shuffle output of one side is below the threshold.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# Sizing for the 100 TB / ~1000-executor target (applied with profile="cluster").
# Input splits of 256 MB give ~400k scan tasks; the largest shuffle (order
# items, tens of TB) starts at 32768 partitions and AQE coalesces toward 256 MB
# per partition, splitting partitions above 5x the median (and 1 GB) on joins.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.shuffle.partitions": "32768",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1GB",
    "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.shuffle.service.enabled": "true",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "agora", profile: str = "local") -> SparkSession:
    """Build (or fetch) a session with the core settings applied.

    ``master``/``shuffle_partitions`` are only for local runs and tests; on a
    cluster the submitter decides both and this function leaves them alone.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("AGORA_DRIVER_MEMORY", "16g"))
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Small local shuffles: keep at least one partition per core after AQE
        # coalescing, since per-row work (hashing, JSON) is CPU-bound here.
        builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(shuffle_partitions))
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    if profile == "cluster":
        for k, v in CLUSTER_CONF.items():
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_core_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Set the runtime-modifiable core settings on an existing session."""
    for k, v in CORE_CONF.items():
        if k.startswith("spark.sql.streaming.stateStore") and spark.conf.get(k, None):
            continue
        try:
            spark.conf.set(k, v)
        except AnalysisException as e:
            # Only settings that a running session can't change may stay as they are.
            if e.getCondition() not in ("CANNOT_MODIFY_CONFIG", "CANNOT_MODIFY_STATIC_CONFIG"):
                raise


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster names it; only when it is
    unset in local mode (tests) a fresh local folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="agora-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
