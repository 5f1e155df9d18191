"""Session helpers: one place for the configs the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tidetrace") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, pass nothing: the cluster's own master, shuffle partitions and
    checkpoint dir are kept. Local tests pass ``master='local[8]'``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value is
    always used. Only a local master (local runs, tests) with nothing
    configured gets a fresh folder under the system temp dir; a cluster
    without the setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "that every executor can reach")
        conf_dir = tempfile.mkdtemp(prefix="tidetrace-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a DataFrame whose scan yields fewer partitions than cores.

    A cluster scan of large inputs already has many splits, so this is a no-op
    there; it matters for single-file inputs (one parquet row group = one task)
    ahead of CPU-heavy per-row work such as tokenising whole texts.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def partitions_for(spark: SparkSession, amount: int, task_amount: int) -> int:
    """Partitions of about ``task_amount`` each, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(amount) // task_amount))
