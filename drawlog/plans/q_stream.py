"""Streaming queries, run to the end of their input.

The input is written as three deliveries and read as a stream of files, one per
micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog.plans import fixtures as fx
from drawlog.plans import q_assets, q_catalog, q_ingest
from drawlog.plans.compose import check_sql
from drawlog.sources.staging import stage, stage_path
from drawlog.streaming import ingest, tables

_PARTS = 3


def _deliveries(df: DataFrame, order: str) -> DataFrame:
    """A stream of the table in ``_PARTS`` deliveries of rising ``order``, each of as many files."""
    spark = df.sparkSession
    df = stage(df, "delivered")
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) // _PARTS + 1
    path = stage_path(spark, "stream")
    sizes = df.groupBy(F.floor((F.col(order) - low) / width).alias("i")).count().collect()
    # Every delivery gets so many files, and every file some rows.
    files = max(1, min(spark.sparkContext.defaultParallelism, min(r["count"] for r in sizes) // 200))
    for i in range(_PARTS):
        part = df.where(f"{order} >= {low + i * width} AND {order} < {low + (i + 1) * width}")
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _finish(writer, spark, name: str) -> None:
    query = (
        writer.option("checkpointLocation", stage_path(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _append(stream: DataFrame, spark, name: str) -> DataFrame:
    out = stage_path(spark, name)
    _finish(stream.writeStream.format("parquet").option("path", out).outputMode("append"), spark, name)
    return spark.read.parquet(out)


def stream_ingest(spark, sf_dir):
    log = _deliveries(fx.rec_batches(spark, sf_dir), "arrival")
    out = _append(ingest.stream_ingest(log), spark, "ingest")
    return out.where("status = 'accepted'").select(
        "session_id", "frame_id", "sequence", F.get_json_object("event", "$.type").alias("type")
    )


def stream_admission(spark, sf_dir):
    uses = _deliveries(fx.view(spark, sf_dir, "device_log"), "event_id")
    out = stage_path(spark, "admission")
    _finish(tables.stream_admission(uses, out, max_devices=2), spark, "admission")
    return tables.admissions(spark, out, uses.schema)


def stream_quarantine(spark, sf_dir):
    log = _deliveries(fx.as_events(fx.rec_batches(spark, sf_dir), keep=("batch_id", "arrival")), "arrival")
    out = stage_path(spark, "quarantine")
    _finish(tables.stream_quarantine(log, out, max_events=q_ingest.MAX_EVENTS, event_limit=q_ingest.LIMIT), spark, "quarantine")
    return tables.refused(spark, out)


def stream_catalog(spark, sf_dir):
    log = _deliveries(fx.draw_log(spark, sf_dir, keep=("event_id",)), "event_id")
    out = stage_path(spark, "live-catalog")
    _finish(tables.stream_catalog(log, out), spark, "catalog")
    return tables.current_catalog(spark, out)


def stream_assets(spark, sf_dir):
    updates = _deliveries(fx.view(spark, sf_dir, "svg_asset_updates"), "arrival")
    out = stage_path(spark, "live-assets")
    _finish(tables.stream_assets(updates, out), spark, "assets")
    return tables.current_assets(spark, out, updates.schema)


QUERIES = {
    f.__name__: f for f in (stream_ingest, stream_admission, stream_quarantine, stream_catalog, stream_assets)
}

ORACLE = {
    "stream_ingest": check_sql(
        "SELECT session_id, frame_id, sequence, type FROM d WHERE sequence = rn",
        ["rec_batches"],
        [
            ("u", "SELECT DISTINCT session_id, frame_id, sequence, type FROM rec_batches"),
            ("d", "SELECT *, row_number() OVER (PARTITION BY session_id, frame_id ORDER BY sequence) AS rn FROM u"),
        ],
    ),
    "stream_admission": q_assets.ORACLE["device_admission"],
    "stream_quarantine": check_sql(
        "SELECT batch_id, session_id, arrival, events, CAST(0 AS BIGINT) AS new_events, reason FROM st WHERE reason IS NOT NULL",
        ["rec_batches"],
        q_ingest._GATE_STEPS,
        recursive=True,
    ),
    "stream_catalog": q_catalog.ORACLE["canvas_catalog"],
    "stream_assets": q_assets.ORACLE["vector_catalog"],
}
