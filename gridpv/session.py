"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "gridpv",
                checkpoint: str | None = None) -> SparkSession:
    """A session configured the way the library expects: UTC, AQE on, no UI; ``checkpoint`` is a
    folder that all executors share."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: ``spark.checkpoint.dir`` of the session.

    The deployment names a folder there that all executors share (Spark then also points the
    context's checkpoint directory at it).  Without it this is an error: tests and benches set a
    folder of their own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this job")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
