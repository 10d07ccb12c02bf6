"""Written tables in the cluster's shared folder: the only lineage cut of this package.

A written table survives lost executors, keeps column pruning and gives the
optimizer real sizes.  Files are removed when the session ends, or earlier
with ``drop`` once nothing reads them any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a single-machine session without it."""
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="drawlog-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """One job's folder of written tables."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)
        self._n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def clear(self) -> None:
        """Remove all written tables, once nothing reads them any more."""
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
