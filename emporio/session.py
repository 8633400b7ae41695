"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_ROOT = None


def get_spark(master: str | None = None, app: str = "emporio",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    UTC session time zone (dates must not shift against the oracle), AQE
    with partition coalescing and skew-join splitting, UI off.  On a
    cluster ``master`` stays None and the submitter's settings win.
    """
    from pyspark import SparkConf

    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    given = SparkConf()   # what spark-submit has passed on
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
              "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
              "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    if (master or given.get("spark.master", "local")).startswith("local"):
        # sizes for one machine only; a cluster keeps its own
        parts = shuffle_partitions or int(os.environ.get("EMPORIO_SHUFFLE_PARTITIONS", "8"))
        wanted |= {"spark.sql.shuffle.partitions": str(parts), "spark.ui.enabled": "false",
                   "spark.driver.memory": os.environ.get("EMPORIO_DRIVER_MEMORY", "16g")}
    for key, value in wanted.items():
        if not given.contains(key):
            b = b.config(key, value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets it to shared storage and it is used
    as-is.  Only when it is unset (local tests) a scratch folder is made.
    """
    global _LOCAL_CHECKPOINT_ROOT
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _LOCAL_CHECKPOINT_ROOT is None:
            _LOCAL_CHECKPOINT_ROOT = tempfile.mkdtemp(prefix="emporio-ckpt-")
        conf_dir = _LOCAL_CHECKPOINT_ROOT
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
