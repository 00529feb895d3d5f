"""SparkSession construction with the settings every analysis relies on."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

# Settings the semantics depend on (UTC dates, ANSI arithmetic) plus the
# runtime re-planning the plans assume at scale (AQE: partition coalescing,
# skew-join splitting). Broadcasts never rest on planner estimates: the
# static threshold is off, so a side is broadcast only when AQE has measured
# it below 10 MB at runtime.
BASE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "loanlens", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with ``BASE_CONF`` applied.

    On a cluster call it without ``master``; the launcher decides. Locally
    (tests, bench) pass ``local[N]`` and a shuffle-partition count near N.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; that value is always
    used. Only on a local master (tests) a fresh scratch folder is created
    when it is unset; on a cluster each node would write its own folder, so
    there the setting is required.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="loanlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
               min_partitions: int = 8) -> dict:
    """Scan and shuffle sizing for an input of ``input_bytes``.

    Scan splits of ``target_partition_bytes``; enough shuffle partitions that
    the largest shuffle (at most about the input volume) gives each reducer
    one target-sized slice, so no task needs more than a few hundred MB of
    memory (anything beyond spills). AQE then merges small partitions
    towards half the target and splits skewed ones. For 100 TB this gives
    409,600 initial shuffle partitions.

    Pass the result as ``get_session(..., extra=scale_conf(n))``.
    """
    parts = max(min_partitions, math.ceil(input_bytes / target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }
