"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and benches; on a cluster the submitter owns these settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assayer")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, as the cluster names it.

    A folder of our own is made only in local mode: elsewhere a machine-local path
    would be lost with its executor.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="assayer-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named
