"""Tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.operators import tiles
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.sources.staging import stage

# Paints of a tile: the first shape, a shared one, one of the tile alone, the
# shared one again.
PAINTS = """
SELECT session_id, canvas_id, i AS order_no, CASE WHEN i = 3 THEN 'stroke' ELSE 'shape' END AS kind,
  CASE i WHEN 1 THEN first_d WHEN 3 THEN 'M 1 1 L 9 ' || CAST(n_paints AS VARCHAR(10)) ELSE 'M 0 0 L 5 5 L 5 0 Z' END AS d,
  CASE WHEN i = 1 THEN first_fill WHEN i = 3 THEN canvas_id ELSE '#f00' END AS paint, tx, ty
FROM {tile_canvases} c JOIN (VALUES (1), (2), (3), (4)) n(i) ON n.i <= c.n_paints
"""


def _canvases(spark, sf_dir):
    return fx.view(spark, sf_dir, "tile_canvases")


def _grouped(c):
    c = stage(c, "canvases")
    return c, tiles.tile_groups(c).join(c, ["session_id", "canvas_id"])


def paint_rows(spark, c):
    rows = spark.sql(PAINTS, tile_canvases=c)
    one = lambda v: F.lit(v)
    return rows.select(
        "session_id", "canvas_id", F.col("order_no").cast("bigint").alias("order_no"), "kind", "d", "paint",
        F.when(F.col("kind") == "shape", "nonzero").alias("fill_rule"),
        F.when(F.col("kind") == "stroke", 2.0).alias("line_width"),
        F.array(one(1.0), one(0.0), one(0.0), one(1.0), "tx", "ty").alias("transform"),
        F.lit(None).cast("string").alias("clip_d"),
        F.lit(None).cast("array<double>").alias("clip_transform"),
    )


def tile_candidates(spark, sf_dir):
    return tiles.tile_candidates(_canvases(spark, sf_dir))


def tile_groups(spark, sf_dir):
    return tiles.tile_groups(stage(_canvases(spark, sf_dir), "canvases"))


def tile_representative(spark, sf_dir):
    return tiles.tile_representative(_grouped(_canvases(spark, sf_dir))[1])


def tile_merge_summary(spark, sf_dir):
    g = _grouped(_canvases(spark, sf_dir))[1]
    return tiles.tile_merge_summary(g.withColumn("errors", F.col("n_paints") % 3))


def lookup_by_member(spark, sf_dir):
    g = stage(_grouped(_canvases(spark, sf_dir))[1], "groups")
    ids = g.where("n_paints = 4").select("session_id", "canvas_id")
    return tiles.lookup_by_member(g, ids).select("session_id", "canvas_id", "leader")


def tile_paint_union(spark, sf_dir):
    c, g = _grouped(_canvases(spark, sf_dir))
    u = tiles.tile_paint_union(paint_rows(spark, c), stage(g, "groups"))
    return u.select(
        "session_id", "leader", "kind", "d", "paint", "nth", "tiles",
        F.get("transform", F.lit(4)).alias("tx"), F.get("transform", F.lit(5)).alias("ty"),
    )


def tile_paint_order(spark, sf_dir):
    c, g = _grouped(_canvases(spark, sf_dir))
    return tiles.tile_paint_order(paint_rows(spark, c), stage(g, "groups"))


QUERIES = {
    f.__name__: f
    for f in (
        tile_candidates, tile_groups, tile_representative, tile_merge_summary, lookup_by_member, tile_paint_union,
        tile_paint_order,
    )
}

_STEPS = [
    ("v", "SELECT *, reverse(substr(reverse(canvas_id), strpos(reverse(canvas_id), '-savnac-') + 8)) AS prefix FROM tile_canvases"),
    ("p", "SELECT session_id, prefix, width, height, first_d, first_fill, first_rule, tx, ty, min(canvas_id) AS place, count(*) AS n FROM v GROUP BY ALL"),
]
# On these tables every canvas of a frame with the same fill and the same
# raster is within reach of all others, so a group is that set.
_GROUPS = _STEPS + [
    ("g", "SELECT v.*, min(canvas_id) OVER (PARTITION BY session_id, prefix, first_fill, tx - 1024 * floor(tx / 1024)) AS leader FROM v")
]

ORACLE = {
    "tile_candidates": check_sql(
        """SELECT a.session_id, a.place AS a, b.place AS b, a.n AS n_a, b.n AS n_b FROM p a JOIN p b ON a.session_id = b.session_id AND a.prefix = b.prefix AND a.width = b.width AND a.height = b.height
  AND a.first_d = b.first_d AND a.first_fill = b.first_fill AND a.first_rule = b.first_rule AND a.place < b.place
WHERE (abs((a.tx - b.tx) / a.width) > 1e-6 OR abs((a.ty - b.ty) / a.height) > 1e-6) AND abs((a.tx - b.tx) / a.width - round((a.tx - b.tx) / a.width)) < 1e-6
  AND abs((a.ty - b.ty) / a.height - round((a.ty - b.ty) / a.height)) < 1e-6 AND abs((a.tx - b.tx) / a.width) <= 16 AND abs((a.ty - b.ty) / a.height) <= 16""",
        ["tile_canvases"],
        _STEPS,
    ),
    "tile_groups": check_sql("SELECT session_id, canvas_id, leader FROM g", ["tile_canvases"], _GROUPS),
    "tile_representative": check_sql(
        "SELECT session_id, leader, arg_max(canvas_id, (n_paints, tx, ty, canvas_id)) AS representative FROM g GROUP BY session_id, leader", ["tile_canvases"], _GROUPS
    ),
    "tile_merge_summary": check_sql(
        """SELECT session_id, leader, arg_max(canvas_id, (n_paints, tx, ty, canvas_id)) AS representative, count(*) AS tiles, max(tx) AS ref_x, max(ty) AS ref_y,
  ceil(max(tx) - min(tx) + 1024.0) AS tile_width, ceil(max(ty) - min(ty) + 1024.0) AS tile_height, CAST(sum(n_paints % 3) AS BIGINT) AS errors FROM g GROUP BY session_id, leader""",
        ["tile_canvases"],
        _GROUPS,
    ),
    "lookup_by_member": check_sql(
        "SELECT session_id, canvas_id, leader FROM g WHERE (session_id, leader) IN (SELECT (session_id, leader) FROM g WHERE n_paints = 4)", ["tile_canvases"], _GROUPS
    ),
    "tile_paint_union": check_sql(
        """SELECT session_id, leader, kind, d, paint, nth, count(*) AS tiles, rx AS tx, ry AS ty
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, canvas_id, kind, d, paint ORDER BY order_no) AS nth FROM t) u GROUP BY ALL""",
        ["tile_canvases"],
        _GROUPS
        + [
            ("r", PAINTS.format(tile_canvases="tile_canvases")),
            ("x", "SELECT *, max(tx) OVER (PARTITION BY session_id, leader) AS rx, max(ty) OVER (PARTITION BY session_id, leader) AS ry FROM g"),
            ("t", "SELECT r.*, x.leader, x.rx, x.ry FROM r JOIN x ON x.session_id = r.session_id AND x.canvas_id = r.canvas_id"),
        ],
    ),
}
