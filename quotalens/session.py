"""Session settings that the queries rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers on this host import the package; on a cluster it is installed or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def prepare(spark: SparkSession) -> None:
    """Timestamps are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_code(spark)


def work_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local one only where it is unset and Spark runs on
    one host (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quotalens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: its lineage ends here, and a lost executor changes no row."""
    work_dir(df.sparkSession)
    return df.checkpoint()
