"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at cluster scale as well as in local tests.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # file texts compress well: a shuffle of few bytes may still be much work
    # for the expressions behind it, so small ones keep all cores busy
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # files are up to 10 MB each; keep Arrow batches small so a Python
    # worker holds at most 64 files (<= 640 MB) at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "codegrid") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CODEGRID_DRIVER_MEM", "16g"))
    for kv in filter(None, os.environ.get("CODEGRID_CONF", "").split(";")):  # ad-hoc overrides
        k, v = kv.split("=", 1)
        builder = builder.config(k.strip(), v.strip())
    if os.environ.get("CODEGRID_EVENT_LOG"):  # stage / task timings for profiling
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", os.environ["CODEGRID_EVENT_LOG"]))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system folder and is used
    as is. Only when it is unset (local tests) a fresh scratch folder is
    created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        # a folder of this machine would be another one on each executor
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="codegrid-ckpt-", suffix="-d", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local
