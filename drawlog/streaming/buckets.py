"""Keyed state tables for micro-batch jobs: buckets of a key's hash, each a base and deltas.

A micro-batch reads the buckets its keys fall into and writes one delta to each
bucket it changes; nothing else is touched.  A bucket with many deltas is
rewritten as a new base.  Everything is named by the number of the micro-batch
that wrote it, and a micro-batch reads only what earlier ones wrote, so a
retry finds the same state and leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlog.sources.staging import stage

_AT = "_epoch"


class Buckets:
    """``keys`` name a row, ``by`` (some of them) its bucket.

    ``buckets`` and ``by`` must stay the same for the life of a table.  A
    bucket is rewritten when it has more than ``deltas`` deltas, so a read
    opens at most ``deltas + 1`` folders per bucket, however long the stream
    has run, and every row is rewritten once per ``deltas`` changes of its
    bucket.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str | T.StructType, keys: list[str], by: list[str] | None = None, buckets: int = 64, deltas: int = 8):
        self.spark, self.path, self.keys, self.by = spark, f"{root}/{name}", keys, by or keys
        self.schema = spark.createDataFrame([], schema).schema
        self._stored = T.StructType([*self.schema.fields, T.StructField(_AT, T.LongType())])
        self._buckets, self._deltas = buckets, deltas
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _number(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self._buckets)).cast("int")

    def numbers(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows; at most ``buckets`` numbers."""
        return [r["b"] for r in rows.select(self._number().alias("b")).distinct().collect()]

    def _folders(self, bucket: int, epoch: int | None) -> tuple[int, dict[int, str]]:
        """The base and the deltas after it that a micro-batch may read: ``(base's number or -1, {number: folder})``."""
        top = self._hadoop(f"{self.path}/bucket={bucket}")
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        at = lambda kind: sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))
        seen = lambda e: epoch is None or e < epoch
        whole = [e for e in at("base") if seen(e) and self._fs.exists(self._hadoop(f"{self.path}/bucket={bucket}/base={e}/_SUCCESS"))]
        base = whole[-1] if whole else -1
        found = {base: f"{self.path}/bucket={bucket}/base={base}"} if whole else {}
        return base, found | {e: f"{self.path}/bucket={bucket}/epoch={e}" for e in at("epoch") if e > base and seen(e)}

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(*paths) if paths else self.spark.createDataFrame([], self._stored)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.fieldNames() if c not in self.keys]
        values = [F.max_by(F.struct(*rest), F.col(_AT)).alias("_r")] if rest else []
        newest = rows.groupBy(*self.keys).agg(F.max(_AT).alias(_AT), *values)
        return newest.select(*self.keys, *(["_r.*"] if rest else []), _AT).select(*self._stored.fieldNames())

    def read(self, touched: DataFrame | None = None, epoch: int | None = None) -> DataFrame:
        """Rows as they were before ``epoch``: those that agree with ``touched`` in ``by``, or all."""
        numbers = range(self._buckets) if touched is None else self.numbers(touched)
        rows = self._rows([p for b in numbers for p in self._folders(b, epoch)[1].values()])
        if touched is not None:
            rows = rows.join(touched.select(*self.by).distinct(), self.by, "left_semi")
        return self._newest(rows).drop(_AT)

    def put(self, changed: DataFrame, epoch: int) -> None:
        """Write the rows that ``epoch`` made or changed, each key once; then rewrite those of its buckets that have many deltas."""
        rows = changed.select(*self.schema.fieldNames()).withColumns({_AT: F.lit(epoch).cast("long"), "bucket": self._number(), "epoch": F.lit(epoch)})
        rows = stage(rows, "delta")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(self.path)
        for bucket in touched:
            base, folders = self._folders(bucket, epoch)
            if len(folders) - (base >= 0) > self._deltas:
                # Up to the micro-batch before: a retry of this one still finds what it read.
                upto = max(folders)
                self._newest(self._rows(list(folders.values()))).write.mode("overwrite").parquet(f"{self.path}/bucket={bucket}/base={upto}")
                for path in folders.values():
                    self._fs.delete(self._hadoop(path), True)
