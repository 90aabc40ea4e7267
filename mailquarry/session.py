"""Session settings used by tests and bench; on a cluster the given session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", memory: str = "8g", name: str = "mailquarry") -> SparkSession:
    """A local session for tests and bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites of column expressions cost several round trips each; plans here have thousands
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in tests, it lies in
    the warehouse of the session, which Spark resolves through the Hadoop file system and all
    executors share; never in a folder of one machine's own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
        made = spark.sparkContext.getCheckpointDir()
    return made
