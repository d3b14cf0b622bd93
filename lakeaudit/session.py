"""Session helpers: one place for the configuration the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Keys under this prefix tune the library; all have defaults.
CONF_PREFIX = "spark.lakeaudit."

DEFAULTS = {
    # rows a side may have to be broadcast (rules, roots, requested hashes)
    "broadcastMaxRows": 100_000,
    # bytes of text such a side may have
    "broadcastMaxBytes": 32 << 20,
    # 64-bit keys that may be broadcast (8 bytes each before hashing)
    "broadcastMaxKeys": 2_000_000,
    # bits of the largest key set that is broadcast as a bitmap (128 MB)
    "keySetMaxBits": 1 << 30,
    # bytes of a manifest file that one task decodes
    "manifestRangeBytes": 16 << 20,
    # buckets of a manifest at least, and rows a bucket is meant to hold
    "storeBuckets": 16,
    "storeBucketRows": 2_000_000,
    # bytes of file content one hashing task is meant to read
    "hashTaskBytes": 256 << 20,
    # salt buckets for joins whose big side is keyed by a possibly hot key
    # (hash of a duplicate bag, directory of a manifest)
    "saltBuckets": 16,
    # a key with at least this many big-side rows is hot (spread and replicated);
    # there are at most rows / hotKeyRows hot keys, so their set is small
    "hotKeyRows": 100_000,
}


def conf_int(spark: SparkSession, key: str) -> int:
    """Library setting ``spark.lakeaudit.<key>`` as int, with its default."""
    raw = spark.conf.get(CONF_PREFIX + key, None)
    return int(raw) if raw is not None else int(DEFAULTS[key])


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lakeaudit") -> SparkSession:
    """Session for tests, bench and local runs.

    On a cluster the session comes from the launcher; the settings below are
    the ones the plans assume (AQE with skew-join splitting, UTC clock).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAKEAUDIT_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark context.

    Needed by the operators that run Python in tasks when the workers do not
    have the package on their path already."""
    sc = spark.sparkContext
    if getattr(sc, "_lakeaudit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="lakeaudit-zip-"), "lakeaudit")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._lakeaudit_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Taken from ``spark.checkpoint.dir`` as the cluster names it; only when it
    is unset (local tests) a fresh folder is made and registered.  With a
    Spark Connect session the server's setting is used as is.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no driver-side context
        return path or ""
    path = path or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lakeaudit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
