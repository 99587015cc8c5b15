"""Spark session settings for the invoice workflow.

The settings are the ones that matter at cluster scale: adaptive execution
(partition coalescing, skew-join splitting, runtime broadcast decisions),
UTC session time, no UI. ``spark.checkpoint.dir`` is read from the session;
only when the cluster does not name one (local runs, tests) do we set a
scratch folder.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings applied to every session we build. Shuffle partitions are sized
# by the caller (cores locally, data volume on a cluster); AQE coalesces
# small ones at runtime anyway.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Spark broadcasts a join side only below this measured size.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def shuffle_partitions_for(shuffle_bytes: int, target_bytes: int = 256 * 1024**2,
                           lowest: int = 200) -> int:
    """Shuffle partitions so each holds about ``target_bytes`` of the largest shuffle.

    AQE then coalesces small partitions and splits skewed ones at runtime, so
    this is the starting point, sized from the largest expected shuffle (for
    the invoice lines: rows × about 40 bytes of projected columns).
    Example: 6e11 lines × 40 B = 24 TB → about 90,000 partitions of 256 MB.
    """
    wanted = -(-shuffle_bytes // target_bytes)
    return int(max(lowest, wanted))


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tillroll",
    extra: dict[str, str] | None = None,
    shuffle_bytes: int | None = None,
) -> SparkSession:
    """Session with the base settings; partitions from ``shuffle_partitions``,
    else sized from ``shuffle_bytes`` (see :func:`shuffle_partitions_for`)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if not shuffle_partitions and shuffle_bytes:
        shuffle_partitions = shuffle_partitions_for(shuffle_bytes)
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "256m"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> str:
    """Hand this package to the session's executors, as ``spark-submit --py-files`` does; returns the zip's name.

    Tasks that run Python import the package by name. The zip is made on the
    driver and distributed by Spark.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tillroll-ship-")
    package = shutil.make_archive(os.path.join(folder, "tillroll"), "zip", root, "tillroll")
    spark.sparkContext.addPyFile(package)
    return package


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    A folder that is set already is returned as it is: Spark adds a new
    sub-folder at each ``setCheckpointDir``, so setting it again would nest.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store) and is used as is. A machine-local folder is only made for local
    sessions such as tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir() or named
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for the cluster"
        )
    local = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder under the checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more (any Hadoop file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
