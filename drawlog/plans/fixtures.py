"""Draw-log views derived from the test tables.

The SQL texts run unchanged in Spark and in the check engine; ``{events}`` and
the like stand for the tables.  Spark numbers the frames of ``rec_log`` with
the blocked running count instead of one window per user, so a user holding a
large share of the events does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlog.operators.running import BLOCK_ROWS, block_of, row_numbers

TABLES = ["events", "documents", "part", "orders", "lineitem", "pages"]

_REC_ROWS = """
WITH e AS (
  SELECT event_id, user_id, ts, event_type, value, CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS k FROM {events}
), b AS (
  SELECT event_id, user_id, ts, 1 AS pri, k,
    'frame-' || CAST(user_id AS VARCHAR(20)) || '-canvas-' || CAST(1 + k % 2 AS VARCHAR(20)) AS canvas_id,
    CASE WHEN event_type='view' THEN 'fill_rect'
         WHEN event_type='click' THEN 'stroke_rect'
         WHEN event_type='purchase' THEN CASE k % 4 WHEN 0 THEN 'save' WHEN 1 THEN 'clip' WHEN 2 THEN 'restore' ELSE 'fill' END
         WHEN event_type='signup' THEN CASE k % 3 WHEN 0 THEN 'canvas_visibility' ELSE 'path_command' END
         ELSE CASE WHEN k % 10 = 0 THEN 'canvas_resized' WHEN k % 10 <= 4 THEN 'clear_rect' ELSE 'path_command' END END AS type,
    CASE WHEN event_type='signup' THEN CASE WHEN k % 3 = 1 THEN 'begin_path' ELSE 'move_to' END ELSE 'line_to' END AS cmd
  FROM e
), c AS (
  SELECT min(event_id) AS event_id, user_id, min(ts) AS ts, 0 AS pri, CAST(0 AS BIGINT) AS k, canvas_id, 'canvas_created' AS type, CAST(NULL AS VARCHAR(20)) AS cmd
  FROM b GROUP BY user_id, canvas_id
)
SELECT event_id, user_id, ts, pri, k, canvas_id, type, cmd FROM b
UNION ALL SELECT event_id, user_id, ts, pri, k, canvas_id, type, cmd FROM c
"""

_REC_SHAPE = """
SELECT 'rec-' || CAST(user_id % 15 AS VARCHAR(20)) AS session_id, 'frame-' || CAST(user_id AS VARCHAR(20)) AS frame_id,
  CASE WHEN type='path_command' THEN NULL ELSE canvas_id END AS canvas_id,
  CAST(sequence AS BIGINT) AS sequence, type,
  CASE WHEN type IN ('canvas_created','canvas_resized') THEN CAST(100 + k * 10 AS DOUBLE) END AS width,
  CASE WHEN type IN ('canvas_created','canvas_resized') THEN CAST(100 AS DOUBLE) END AS height,
  CASE WHEN type IN ('path_command','fill','clip') THEN 'path-' || CAST(user_id AS VARCHAR(20)) || '-' || CAST(k % 3 AS VARCHAR(20)) END AS path_id,
  CASE WHEN type='path_command' THEN cmd END AS cmd, k, event_id
FROM {numbered}
"""

VIEWS: dict[str, str] = {
    "rec_log": _REC_SHAPE.replace(
        "{numbered}",
        "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, pri, canvas_id, event_id) AS sequence FROM ("
        + _REC_ROWS
        + ") r) n",
    ),
    "path_text": """
SELECT l_orderkey * 100000 + l_partkey AS shape_id, l_orderkey AS asset_id, l_linenumber AS z,
  CASE l_orderkey % 4
    WHEN 0 THEN 'M ' || CAST(l_linenumber AS VARCHAR(20)) || ' 0 h ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || ' v 10 Z'
    WHEN 1 THEN 'M0 0 L' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || ',20 L0 20'
    WHEN 2 THEN 'M 0 0 C 10 0 20 10 ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || ' 30 Q 5 5 0 0 Z'
    ELSE 'M 5 5 X 1' END AS d
FROM {lineitem}
""",
    "artboard_jobs": """
SELECT p_partkey AS asset_id, CAST(16 + p_size * 40 AS DOUBLE) AS width, CAST(16 + (p_partkey % 50) * 30 AS DOUBLE) AS height,
  CASE p_partkey % 9 WHEN 0 THEN 'source' WHEN 1 THEN '1:1' WHEN 2 THEN '4:5' WHEN 3 THEN '14:10' WHEN 4 THEN '16:9' WHEN 5 THEN '0:5' WHEN 6 THEN 'bad' WHEN 7 THEN '3:2' ELSE '4:3' END AS ratio,
  CAST(15000000 AS DOUBLE) AS min_pixels, CAST(CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 65000000 END AS DOUBLE) AS max_pixels FROM {part}
""",
    "paint_samples": """
SELECT p_partkey AS asset_id, CASE p_partkey % 8
    WHEN 0 THEN '#' || lpad(lower(hex(p_partkey * 7919 % 16777216)), 6, '0')
    WHEN 1 THEN 'rgb(' || CAST(p_size * 5 AS VARCHAR(10)) || ', 0, 255)'
    WHEN 2 THEN 'none' WHEN 3 THEN 'White' WHEN 4 THEN '#f0a' WHEN 5 THEN 'url(#grad)'
    WHEN 6 THEN 'rgba(10%, 20%, 30%, 0.5)' ELSE 'rebeccapurple' END AS paint FROM {part}
""",
    "tile_canvases": """
SELECT session_id, canvas_id, CAST(1024 AS DOUBLE) AS width, CAST(1024 AS DOUBLE) AS height,
  'M 0 0 L 1500 0 L 1500 1500 Z' AS first_d, CASE WHEN idx % 5 = 4 THEN '#000' ELSE '#fff' END AS first_fill, 'nonzero' AS first_rule,
  CAST(-1024 * (idx % 3) AS DOUBLE) + CASE WHEN o_orderkey % 11 = 0 THEN 10.5 ELSE 0.0 END AS tx,
  CAST(-1024 * ((idx - idx % 3) / 3) AS DOUBLE) AS ty, CAST(1 + o_orderkey % 4 AS BIGINT) AS n_paints
FROM (SELECT o_orderkey, o_custkey, 'rec-' || CAST(o_custkey % 15 AS VARCHAR(20)) AS session_id,
        rn - 1 AS idx,
        'frame-' || CAST(o_custkey AS VARCHAR(20)) || '-canvas-' || CAST(rn AS VARCHAR(20)) AS canvas_id
      FROM {numbered_orders}) t
""",
    "svg_asset_updates": """
SELECT 'rec-1' AS session_id, source || '-' || lang AS svg_id, doc_id AS arrival, CAST(100 AS DOUBLE) AS width, CAST(50 AS DOUBLE) AS height,
  n_chars % 10 AS shapes, source || '.svg' AS filename,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE '<svg>' END || CAST(n_chars % 3 AS VARCHAR(10)) || '</svg>' AS markup FROM {documents}
""",
    "feed_items": """
SELECT 'n' || CAST(doc_id % 200 AS VARCHAR(10)) AS id, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE source END AS title, doc_id AS position,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 17 END AS sort_order,
  '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR(4)), 2, '0') AS created_at,
  CASE doc_id % 3 WHEN 0 THEN 'https://example.com/' || CAST(doc_id AS VARCHAR(10)) WHEN 1 THEN 'http://example.com/' END AS link FROM {documents}
""",
    "device_log": """
SELECT event_id, ts, user_id AS license_key, 'd' || CAST(CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) % 4 AS VARCHAR(4)) AS device_id FROM {events}
""",
    "svg_candidates": """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'outputsvg' WHEN page_id % 4 = 1 THEN '' ELSE 'g' || CAST(page_id AS VARCHAR(10)) END AS dom_id,
  length(url) % 20 AS shapes, CAST(page_id % 64 AS DOUBLE) AS box_w, CAST(length(url) AS DOUBLE) AS box_h FROM {pages}
""",
}
# Deliveries of rec_log in batches of one frame: a batch holds the events of a
# span of event ids; 1 event in 101 is lost and 1 in 7 arrives again with the
# next batch.
BATCH_SPAN = 1500
_DELIVERY = """
SELECT *, session_id || '/' || frame_id || '/' || CAST(arrival AS VARCHAR(20)) AS batch_id FROM (
  SELECT *, CAST(floor(event_id / {span}) AS BIGINT) AS arrival FROM {rec_log} WHERE event_id % 101 <> 0
  UNION ALL
  SELECT *, CAST(floor(event_id / {span}) AS BIGINT) + 1 AS arrival FROM {rec_log} WHERE event_id % 7 = 0 AND event_id % 101 <> 0
) d
""".replace("{span}", str(BATCH_SPAN))
_ORDERS_SQL = "(SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)"


def check_views() -> dict[str, str]:
    """View name to SQL over the bare table names, for the check engine."""
    names = {t: t for t in TABLES}
    views = {n: sql.replace("{numbered_orders}", _ORDERS_SQL + " o").format(**names) for n, sql in VIEWS.items()}
    views["rec_batches"] = _DELIVERY.replace("{rec_log}", "rec_log")
    views["path_refs"] = """
SELECT session_id, frame_id, sequence, CASE WHEN n % 3 = 0 THEN 'path_append' ELSE 'path_created' END AS type,
  'copy-' || frame_id || '-' || CAST(n AS VARCHAR(20)) AS path_id,
  CASE WHEN n % 4 = 1 THEN 'path-' || substr(frame_id, 7) || '-0' ELSE 'copy-' || frame_id || '-' || CAST(n - 1 AS VARCHAR(20)) END AS source_path_id
FROM (SELECT session_id, frame_id, sequence, row_number() OVER (PARTITION BY frame_id ORDER BY sequence) AS n
      FROM rec_log WHERE type = 'canvas_visibility') t
"""
    return views


def _table(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir.rstrip('/')}/{name}.parquet`"


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.format(**{t: _table(sf_dir, t) for t in TABLES}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "rec_log":
        return rec_log(spark, sf_dir)
    if name == "tile_canvases":
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        block = block_of(orders, ["o_custkey"], F.floor(F.col("o_orderkey") / 1_000_000))
        numbered = row_numbers(orders, ["o_custkey"], ["o_orderkey"], block, "rn")
        return spark.sql(VIEWS[name].replace("{numbered_orders}", "{o}"), o=numbered)
    return _sql(spark, sf_dir, VIEWS[name])


def rec_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, _REC_ROWS)
    # A user has at most one creation for each event.
    users = table(spark, sf_dir, "events").select("user_id")
    block = block_of(users, ["user_id"], F.date_trunc("day", F.col("ts")), BLOCK_ROWS // 2)
    numbered = row_numbers(rows, ["user_id"], ["ts", "pri", "canvas_id", "event_id"], block, "sequence")
    return spark.sql(_REC_SHAPE.replace("{numbered}", "{n}"), n=numbered)


def draw_log(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rec_log`` in the event schema, with the argument rules of the test views."""
    return as_events(rec_log(spark, sf_dir), keep)


def as_events(rec: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    d = lambda c: c.cast("double")
    k, eid = F.col("k"), F.col("event_id")
    rect = F.array(d(k), d(eid % 100), d(10 + k % 40), d(10 + eid % 30))
    full = F.array(*[F.lit(v) for v in (0.0, 0.0, 2000.0, 100.0)])
    part = F.array(d(k), F.lit(0.0), F.lit(20.0), F.lit(100.0))
    fills = ["#f00", "#00ff00", "rgb(0, 0, 255)", "none", "white", "url(#g)"]
    fill = F.element_at(F.array(*[F.lit(f) for f in fills]), (k % 6 + 1).cast("int"))
    kind = F.col("type")
    paint = kind.isin("fill", "fill_rect", "stroke_rect")
    return rec.select(
        "session_id",
        "frame_id",
        "canvas_id",
        "sequence",
        "type",
        "width",
        "height",
        "path_id",
        F.when(
            F.col("cmd").isNotNull(),
            F.struct(
                F.col("cmd").alias("type"),
                F.when(F.col("cmd") == "begin_path", F.array().cast("array<double>"))
                .otherwise(F.array(d(k), d(eid % 100)))
                .alias("args"),
            ),
        ).alias("command"),
        F.when(kind.isin("fill_rect", "stroke_rect"), rect)
        .when((kind == "clear_rect") & (k % 10 == 1), full)
        .when(kind == "clear_rect", part)
        .alias("args"),
        F.when(
            paint | kind.isin("clip", "clear_rect"),
            F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]),
        ).alias("transform"),
        F.when(paint, fill).alias("fill_style"),
        F.when(paint, F.lit("#000")).alias("stroke_style"),
        F.when(paint, d(k % 5)).alias("line_width"),
        F.when(kind == "fill", F.lit("nonzero")).alias("fill_rule"),
        F.when(kind == "canvas_visibility", (k % 2 == 0).cast("string")).alias("value"),
        *keep,
    )


def rec_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as the check view, with the second delivery as an exploded number."""
    rec = rec_log(spark, sf_dir).where("event_id % 101 <> 0")
    first = f"CAST(floor(event_id / {BATCH_SPAN}) AS BIGINT)"
    twice = F.expr(f"explode(CASE WHEN event_id % 7 = 0 THEN array({first}, {first} + 1) ELSE array({first}) END)")
    return rec.select("*", twice.alias("arrival")).withColumn(
        "batch_id", F.expr("session_id || '/' || frame_id || '/' || CAST(arrival AS STRING)")
    )


def path_refs(rec: DataFrame) -> DataFrame:
    """Copies and appends that take the place of the visibility events."""
    from drawlog.operators.running import seq_block

    vis = rec.where("type = 'canvas_visibility'").select("session_id", "frame_id", "sequence")
    n = row_numbers(vis, ["session_id", "frame_id"], ["sequence"], seq_block(), "n")
    copy = lambda i: F.concat(F.lit("copy-"), "frame_id", F.lit("-"), i.cast("string"))
    return n.select(
        "session_id",
        "frame_id",
        "sequence",
        F.when(F.col("n") % 3 == 0, "path_append").otherwise("path_created").alias("type"),
        copy(F.col("n")).alias("path_id"),
        F.when(F.col("n") % 4 == 1, F.concat(F.lit("path-"), F.expr("substr(frame_id, 7)"), F.lit("-0")))
        .otherwise(copy(F.col("n") - 1))
        .alias("source_path_id"),
    )


def lineage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_log`` with its visibility events replaced by copies and appends."""
    from drawlog.sources.staging import stage

    rec = stage(rec_log(spark, sf_dir), "rec")
    refs = path_refs(rec)
    base = as_events(rec.where("type <> 'canvas_visibility'"))
    none = lambda t: F.lit(None).cast(t)
    ref_rows = refs.select(
        "session_id",
        "frame_id",
        none("string").alias("canvas_id"),
        "sequence",
        "type",
        none("double").alias("width"),
        none("double").alias("height"),
        "path_id",
        none(base.schema["command"].dataType).alias("command"),
        none("array<double>").alias("args"),
        F.when(
            F.col("type") == "path_append",
            F.array(*[F.lit(v) for v in (0.0, 1.0, -1.0, 0.0, 100.0, 200.0)]),
        ).alias("transform"),
        none("string").alias("fill_style"),
        none("string").alias("stroke_style"),
        none("double").alias("line_width"),
        none("string").alias("fill_rule"),
        F.to_json(F.struct("source_path_id")).alias("value"),
    )
    return base.unionByName(ref_rows)
