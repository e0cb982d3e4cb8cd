"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only in local mode without that setting a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("linkloom.shared.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("linkloom.shared.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM has gone before the interpreter
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that later plans only scan: a short lineage, kept when executors are lost.

    The application's tables are removed when the interpreter ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/linkloom-steps-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
