"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "memlake", partitions: int = 8, **conf: str) -> SparkSession:
    """A ``local[cpus]`` session with the settings the engine expects (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, which is only right
    in local mode; on a cluster an absent setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="memlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut; survives lost executors.

    The files go with the table where the cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark 4.1 loses rows where both sides of a union read the same reused exchange and the union keeps its partitioning.
GUARDS = {"spark.sql.unionOutputPartitioning": "false"}
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session's executors, and applies GUARDS."""
    context = spark.sparkContext
    for key, value in GUARDS.items():
        spark.conf.set(key, value)
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="memlake-"), "memlake_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
