"""Lineage cuts: write an intermediate table to the shared folder and read it back.

The folder is the one named by ``spark.checkpoint.dir``.  Only where that is
unset (single-machine tests) a temporary folder is made and remembered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get(_CONF, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="drawlog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table, removed when the session ends."""
    path = f"{shared_dir(spark)}/drawlog-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table.

    Used between running passes: each pass reads its input twice (block rows
    and block totals), so without a cut a chain of passes doubles per step.
    The columnar copy keeps column pruning and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
