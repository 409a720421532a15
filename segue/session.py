"""Session settings the plans rely on; used where no session exists yet."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, cores: int | None = None, app: str = "segue") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if cores:  # a single machine: as many shuffle partitions as threads
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
        builder = builder.config("spark.driver.memory", "12g")
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder.

    Only a session on one machine that names none, as in tests, gets a local one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        folder = tempfile.mkdtemp(prefix="segue-")
        spark.conf.set("spark.checkpoint.dir", folder)
    # one folder per application, so it can be removed as a whole afterwards
    return f"{folder.rstrip('/')}/segue-{spark.sparkContext.applicationId}"


def remove_shared_folder(spark: SparkSession) -> None:
    """Remove everything this application wrote with ``materialise``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, *by: str, dense: bool = False) -> DataFrame:
    """Write a frame that several branches read to the shared folder, and read it back.

    Costly columns are computed once, each branch reads only the columns it needs,
    and a lost executor costs a re-read.  ``by`` names columns of few values that branches
    select by; each value gets a folder.  ``dense`` spends more on packing, for tables of long texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    written = df.write.option("compression", "zstd") if dense else df.write
    (written.partitionBy(*by) if by else written).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast when counting shows at most so many rows.

    For a written table; a larger one meets the other side by a shuffle.
    """
    return F.broadcast(df) if df.count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_segue_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="segue-package-"), "segue.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                packed.write(path, os.path.join("segue", os.path.relpath(path, home)))
    context.addPyFile(archive)
    context._segue_shipped = True
