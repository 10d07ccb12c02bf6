"""Micro-batch jobs that keep tables up to date.

Every micro-batch writes its own folder, named by the batch number and
overwritten on a retry, so a repeated micro-batch leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from drawlog import schema as S
from drawlog.operators.assets import ASSET, asset_revisions
from drawlog.operators.catalog import canvas_catalog
from drawlog.operators.feed import device_admission
from drawlog.operators.ingest import accepted_prefix, batch_gate, with_defaults
from drawlog.sources.staging import stage
from drawlog.streaming.buckets import Buckets


def _put(df: DataFrame, root: str, table: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/epoch={epoch:012d}")


def read_table(spark: SparkSession, root: str, table: str, schema, before: int | None = None) -> DataFrame:
    """All epochs of a table (those before ``before``); empty when there are none."""
    path = f"{root}/{table}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0))
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    rows = rows.withColumn("epoch", F.col("epoch").cast("int")) if "epoch" in rows.columns else rows
    return rows if before is None else rows.where(F.col("epoch") < before)


_COUNTS = "session_id string, events bigint"
_STATE = "session_id string, frame_id string, last bigint"
_REFUSED = "batch_id string, session_id string, arrival bigint, events bigint, new_events bigint, reason string"


def stream_quarantine(log: DataFrame, path: str, sessions: DataFrame | None = None, buckets: int = 64, **limits) -> DataStreamWriter:
    """Write refused batches with their reason to ``path``/refused.

    ``path``/frames and ``path``/counts are keyed state: the last accepted
    sequence of each frame and the events of each session.  A micro-batch
    reads and writes those of the sessions it brings, so the result does not
    depend on how the input was cut, and old input is never read again.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        frames = Buckets(spark, path, "frames", _STATE, S.FRAME, ["session_id"], buckets)
        counts = Buckets(spark, path, "counts", _COUNTS, ["session_id"], None, buckets)
        batch = with_defaults(batch)
        touched = stage(batch.select("session_id").distinct(), "touched")
        state, used = stage(frames.read(touched, epoch), "state"), stage(counts.read(touched, epoch), "used")
        verdict = stage(batch_gate(batch, sessions, state=state, used=used, **limits), "verdict")
        good = batch.join(verdict.where("reason IS NULL").select("batch_id"), "batch_id", "left_semi")
        # Only frames that have come further are written.
        reached = good.groupBy(*S.FRAME).agg(F.max("sequence").alias("last"))
        old = state.withColumnRenamed("last", "_old")
        frames.put(reached.join(old, S.FRAME, "left").where("_old IS NULL OR last > _old").drop("_old"), epoch)
        more = verdict.groupBy("session_id").agg(F.sum("new_events").alias("_new")).where("_new > 0")
        counts.put(more.join(used, "session_id", "left").select("session_id", (F.coalesce("events", F.lit(0)) + F.col("_new")).alias("events")), epoch)
        _put(verdict.where("reason IS NOT NULL"), path, "refused", epoch)

    return log.writeStream.foreachBatch(take)


def refused(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "refused", _REFUSED).drop("epoch")


_BUCKETS = 64


def stream_catalog(log: DataFrame, sink: str, every: str = "500 milliseconds") -> DataStreamWriter:
    """Keep the catalog of every session current, at most one update per ``every``.

    A micro-batch adds its events to ``sink``/log, by bucket of the session, and
    writes the catalog of the sessions it touched to ``sink``/catalog; the
    newest epoch of a session is its current one.  Only the buckets of touched
    sessions are read again.
    """
    bucket = F.pmod(F.hash("session_id"), F.lit(_BUCKETS))
    schema = log.select(*S.EVENT.fieldNames()).schema

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*S.EVENT.fieldNames(), bucket.alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/log/epoch={epoch:012d}")
        touched = stage(rows.select("session_id", "bucket").distinct(), "touched")
        own = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most _BUCKETS numbers
        if not own:
            return
        touched = touched.drop("bucket")
        whole = read_table(spark, sink, "log", schema, epoch + 1)
        whole = whole.where(F.col("bucket").isin(own)).drop("epoch", "bucket")
        mine = stage(accepted_prefix(whole.join(touched, "session_id", "left_semi")), "accepted")
        catalog = canvas_catalog(mine)
        # A session without a listed document still replaces its older rows.
        _put(touched.join(catalog, "session_id", "left"), sink, "catalog", epoch)

    return log.writeStream.foreachBatch(take).trigger(processingTime=every)


_CATALOG = (
    "session_id string, canvas_id string, width double, height double, revision bigint, shapes bigint, "
    "gap_fillers bigint, errors bigint, state string"
)


def current_catalog(spark: SparkSession, sink: str) -> DataFrame:
    rows = read_table(spark, sink, "catalog", _CATALOG)
    newest = rows.groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["session_id", "epoch"], "left_semi").where("canvas_id IS NOT NULL").drop("epoch")


def stored_asset_schema(updates: T.StructType) -> T.StructType:
    return T.StructType([*updates.fields, T.StructField("revision", T.LongType())])


def stream_assets(updates: DataFrame, sink: str, buckets: int = 64) -> DataStreamWriter:
    """Upsert captured assets; ``sink``/changes gets one row per real change.

    ``sink``/newest is keyed state, the newest version of each asset; a
    micro-batch reads and writes those it brings, and no older change.
    """
    stored_schema = stored_asset_schema(updates.schema)

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = Buckets(spark, sink, "newest", stored_schema, ASSET, None, buckets)
        stored = stage(newest.read(batch, epoch), "stored")
        base = stored.select(*ASSET, F.col("revision").alias("_base"))
        fresh = batch.join(base, ASSET, "left_anti")
        known = batch.join(base, ASSET, "left_semi").unionByName(stored.select(*updates.columns))
        new_rows = asset_revisions(fresh).where("changed").drop("changed").select(*stored_schema.fieldNames())
        # The stored version comes first and counts as revision 1 of the rest.
        more = (
            asset_revisions(known)
            .where("changed AND revision > 1")
            .join(base, ASSET)
            .withColumn("revision", F.col("revision") + F.col("_base") - 1)
            .select(*stored_schema.fieldNames())
        )
        _put(new_rows.unionByName(more), sink, "changes", epoch)
        changes = spark.read.schema(stored_schema).parquet(f"{sink}/changes/epoch={epoch:012d}")
        rest = [c for c in stored_schema.fieldNames() if c not in ASSET]
        last = changes.groupBy(*ASSET).agg(F.max_by(F.struct(*rest), F.col("revision")).alias("_r"))
        newest.put(last.select(*ASSET, "_r.*"), epoch)

    return updates.writeStream.foreachBatch(take)


def current_assets(spark: SparkSession, sink: str, updates: T.StructType, buckets: int = 64) -> DataFrame:
    """The newest version of each asset, from the keyed state."""
    return Buckets(spark, sink, "newest", stored_asset_schema(updates), ASSET, None, buckets).read()


_ADMITTED = "license_key {key}, device_id {device}"


def stream_admission(uses: DataFrame, sink: str, max_devices: int = 1, buckets: int = 64) -> DataStreamWriter:
    """Admit the first devices of every license as they come.

    ``sink``/devices is keyed state, the admitted devices, at most
    ``max_devices`` per license; ``sink``/uses holds the decisions.  A
    micro-batch reads the devices of its licenses and ranks its new ones
    behind them, so a busy license is aggregated before it is shuffled.
    """
    types = dict(uses.dtypes)
    schema = _ADMITTED.format(key=types["license_key"], device=types["device_id"])

    def take(batch: DataFrame, epoch: int) -> None:
        names = ["license_key", "device_id", "ts", "event_id"]
        devices = Buckets(batch.sparkSession, sink, "devices", schema, ["license_key", "device_id"], ["license_key"], buckets)
        # Devices already in come before every new use.
        floor = batch.agg(F.min("ts").alias("ts"), (F.min("event_id") - 1).alias("event_id"))
        start = floor.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 SECOND")).first()
        if start is None or start["ts"] is None:
            return
        old = stage(devices.read(batch, epoch), "devices")
        known = old.select("license_key", "device_id", F.lit(start["ts"]).cast(types["ts"]).alias("ts"), F.lit(start["event_id"]).cast("bigint").alias("event_id"))
        decided = device_admission(batch.select(*names).unionByName(known), max_devices)
        fresh = stage(decided.where(F.col("event_id") > start["event_id"]), "decided")
        _put(fresh.select("event_id", "license_key", "device_id", "admitted"), sink, "uses", epoch)
        admitted = fresh.where("admitted").select("license_key", "device_id").distinct()
        devices.put(admitted.join(old, ["license_key", "device_id"], "left_anti"), epoch)

    return uses.writeStream.foreachBatch(take)


def admissions(spark: SparkSession, sink: str, uses: T.StructType) -> DataFrame:
    kept = [uses[c] for c in ("event_id", "license_key", "device_id")]
    schema = T.StructType([*kept, T.StructField("admitted", T.BooleanType())])
    return read_table(spark, sink, "uses", schema).drop("epoch")
