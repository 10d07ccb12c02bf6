"""Canvas state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.operators import paint as pt
from drawlog.operators import paths, surface
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.sources.staging import stage

CAP = 3


def _surface(spark, sf_dir):
    # The passes over the log read it many times.
    return surface.surface_log(stage(fx.draw_log(spark, sf_dir), "log"))


def _paint_table(spark, sf_dir, cap=5000):
    """The numbered canvas events, and the current paint rows without path text."""
    numbered = surface.numbered_log(_surface(spark, sf_dir))
    return numbered, surface.current_paints(numbered, cap)


def _styled(table):
    kind = F.col("kind")
    return table.withColumn(
        "paint",
        F.when(kind == "shape", F.coalesce("fill_style", F.lit("#000"))).when(
            kind == "stroke", F.coalesce("stroke_style", F.lit("#000"))
        ),
    )


def surface_state(spark, sf_dir):
    s = surface.surface_state(fx.draw_log(spark, sf_dir))
    return s.select("session_id", "canvas_id", "created_at", "width", "height", "visible", "revision", "ended")


def stack_depth(spark, sf_dir):
    return surface.stack_depth(fx.draw_log(spark, sf_dir)).select("canvas_id", "sequence", "type", "depth", "resizes")


def active_clip(spark, sf_dir):
    return surface.active_clip(_surface(spark, sf_dir)).drop("session_id", "frame_id")


def paint_epochs(spark, sf_dir):
    return surface.paint_epochs(_surface(spark, sf_dir)).drop("session_id", "frame_id")


def path_epochs(spark, sf_dir):
    return paths.path_epochs(fx.draw_log(spark, sf_dir)).select("path_id", "sequence", "type", "path_epoch")


def path_asof_snapshot(spark, sf_dir):
    return paths.path_asof_snapshot(fx.draw_log(spark, sf_dir)).drop("session_id", "frame_id")


def paint_order(spark, sf_dir):
    p = surface.paint_order(_surface(spark, sf_dir))
    return p.select("canvas_id", "epoch", "sequence", "kind", "kind_index", "order_no")


def shape_cap(spark, sf_dir):
    p = surface.shape_cap(surface.counted(_surface(spark, sf_dir)), CAP)
    return p.select("canvas_id", "epoch", "sequence", "type", "shape_no", "stroke_no")


def error_count(spark, sf_dir):
    return surface.error_count(surface.numbered_log(_surface(spark, sf_dir)), CAP).drop("frame_id")


def clear_over_paint(spark, sf_dir):
    p = surface.paint_order(_surface(spark, sf_dir))
    out = pt.clear_over_paint(p).where("kind <> 'clear'")
    return out.select("canvas_id", "epoch", "sequence", "kind", "first_clear", "clears", "later_clears")


def stock_validation(spark, sf_dir):
    s, p = _paint_table(spark, sf_dir)
    errors = surface.error_count(s)
    styled = _styled(p).withColumn("line_width", F.when(F.col("kind") == "stroke", F.coalesce("line_width", F.lit(1.0))))
    return pt.stock_validation(styled, errors).drop("frame_id")


def palette(spark, sf_dir):
    _, p = _paint_table(spark, sf_dir)
    out = pt.palette(_styled(p), ["canvas_id"])
    return out.select("canvas_id", F.array_join("colors", ",").alias("colors"))


def drop_elements(spark, sf_dir):
    s, p = _paint_table(spark, sf_dir)
    ids = surface.last_epochs(s).select(
        "canvas_id", F.explode(F.array(F.lit("shape-2"), F.lit("gap-filler-1"))).alias("element_id")
    )
    return pt.drop_elements(p, ids).select("canvas_id", "sequence", "kind", "kind_index")


def drop_colors(spark, sf_dir):
    p = fx.view(spark, sf_dir, "paint_samples")
    chosen = p.where("asset_id % 97 = 8 OR asset_id % 89 = 1").select(F.col("paint").alias("color")).distinct()
    return pt.drop_colors(p, chosen)


def nearest_color(spark, sf_dir):
    p = fx.view(spark, sf_dir, "paint_samples").withColumn("group_id", F.col("asset_id") % 40)
    pal = pt.palette(p, ["group_id"]).select("group_id", F.explode("colors").alias("color"))
    samples = p.select(
        "group_id", F.concat(F.lit("#"), F.lpad(F.hex(F.col("asset_id") * 104729 % 16777216), 6, "0")).alias("sample")
    )
    return pt.nearest_color(pal, samples, ["group_id"])


QUERIES = {
    f.__name__: f
    for f in (
        surface_state, stack_depth, active_clip, paint_epochs, path_epochs, path_asof_snapshot, paint_order,
        shape_cap, error_count, clear_over_paint, stock_validation, palette, drop_elements, drop_colors, nearest_color,
    )
}

# ---------------------------------------------------------------- check SQL

_FILLS = ["#f00", "#00ff00", "rgb(0, 0, 255)", "none", "white", "url(#g)"]
_FILL = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FILLS)) + " END"

PATH_STEPS = [
    (
        "pw",
        """SELECT *, sum(CASE WHEN cmd = 'begin_path' THEN 1 ELSE 0 END) OVER w AS p_epoch,
  sum(CASE WHEN type = 'path_command' THEN 1 ELSE 0 END) OVER w > 0 AS p_known,
  coalesce(max(CASE WHEN cmd <> 'begin_path' THEN sequence END) OVER w, 0) > coalesce(max(CASE WHEN cmd = 'begin_path' THEN sequence END) OVER w, 0) AS p_filled
FROM rec_log WHERE path_id IS NOT NULL WINDOW w AS (PARTITION BY path_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)""",
    )
]
SURFACE_STEPS = PATH_STEPS + [
    (
        "c0",
        """SELECT r.*, coalesce(p.p_known, FALSE) AS p_known, coalesce(p.p_filled, FALSE) AS p_filled, p.p_epoch,
  last_value(r.width IGNORE NULLS) OVER w AS now_width,
  sum(CASE WHEN r.type = 'canvas_resized' THEN 1 ELSE 0 END) OVER w AS resizes
FROM rec_log r LEFT JOIN pw p ON p.frame_id = r.frame_id AND p.sequence = r.sequence WHERE r.canvas_id IS NOT NULL
WINDOW w AS (PARTITION BY r.canvas_id ORDER BY r.sequence ROWS UNBOUNDED PRECEDING)""",
    ),
    (
        "c1",
        """SELECT *, sum(CASE type WHEN 'save' THEN 1 WHEN 'restore' THEN -1 ELSE 0 END) OVER (PARTITION BY canvas_id, resizes ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS s FROM c0""",
    ),
    (
        "c2",
        "SELECT *, CAST(s - least(min(s) OVER (PARTITION BY canvas_id, resizes ORDER BY sequence ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS depth FROM c1",
    ),
]
CLIP_STEPS = SURFACE_STEPS + [
    (
        "cl",
        """SELECT c.canvas_id, c.resizes, c.sequence AS cs, c.p_known, min(x.sequence) AS until FROM c2 c
LEFT JOIN c2 x ON x.canvas_id = c.canvas_id AND x.resizes = c.resizes AND x.sequence > c.sequence AND x.depth < c.depth
WHERE c.type = 'clip' GROUP BY ALL""",
    ),
    (
        "ac",
        """SELECT e.canvas_id, e.sequence, max(cs) AS cs, arg_max(cl.p_known, cs) AS real_clip FROM c2 e JOIN cl ON cl.canvas_id = e.canvas_id AND cl.resizes = e.resizes
AND cs <= e.sequence AND (until IS NULL OR e.sequence < until) GROUP BY ALL""",
    ),
    ("c3", "SELECT c2.*, CASE WHEN real_clip THEN cs END AS clip_seq FROM c2 LEFT JOIN ac USING (canvas_id, sequence)"),
    (
        "c4",
        """SELECT *, type = 'canvas_resized' OR (type = 'clear_rect' AND k % 10 = 1 AND clip_seq IS NULL) AS is_reset,
  type = 'clear_rect' AND NOT (k % 10 = 1 AND clip_seq IS NULL) AND (k <> 0 OR k % 10 <> 1) AS is_clear FROM c3""",
    ),
    (
        "c5",
        "SELECT *, CAST(sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (PARTITION BY canvas_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM c4",
    ),
    (
        "c6",
        """SELECT *, type = 'fill_rect' OR (type = 'fill' AND p_filled) AS is_shape, type = 'stroke_rect' AS is_stroke, max(epoch) OVER (PARTITION BY canvas_id) AS last_epoch FROM c5""",
    ),
    (
        "c7",
        """SELECT *, CAST(sum(CASE WHEN is_shape THEN 1 ELSE 0 END) OVER w AS BIGINT) AS shape_no, CAST(sum(CASE WHEN is_stroke THEN 1 ELSE 0 END) OVER w AS BIGINT) AS stroke_no
FROM c6 WINDOW w AS (PARTITION BY canvas_id, epoch ORDER BY sequence ROWS UNBOUNDED PRECEDING)""",
    ),
]
PAINT_STEPS = CLIP_STEPS + [
    (
        "pn",
        """SELECT *, CASE WHEN is_shape THEN 'shape' WHEN is_stroke THEN 'stroke' ELSE 'clear' END AS kind,
  CASE WHEN is_shape THEN shape_no WHEN is_stroke THEN stroke_no END AS kind_index,
  row_number() OVER (PARTITION BY canvas_id, epoch ORDER BY sequence) AS order_no
FROM c7 WHERE is_shape OR is_stroke OR (is_clear AND shape_no + stroke_no > 0)""",
    ),
    ("cur", f"SELECT *, CASE kind WHEN 'shape' THEN {_FILL} WHEN 'stroke' THEN '#000' END AS paint FROM pn WHERE epoch = last_epoch"),
]
ERRORS = lambda cap: (
    "er",
    f"""SELECT session_id, canvas_id, count(CASE WHEN epoch = last_epoch AND type = 'fill' AND NOT p_known AND shape_no < {cap} THEN 1 END) AS errors
FROM c7 GROUP BY session_id, canvas_id""",
)


def _q(select, steps, views=("rec_log",)):
    return check_sql(select, list(views), steps)


_hex = lambda c: f"('#' || {c})"
_HEXOF = {"#f00": "#FF0000", "#00ff00": "#00FF00", "rgb(0, 0, 255)": "#0000FF", "white": "#FFFFFF", "#000": "#000000"}
_HEX = "CASE paint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HEXOF.items()) + " END"
_RGB = [
    (
        "x1",
        """SELECT asset_id, paint, lower(trim(paint)) AS s FROM paint_samples""",
    ),
]


def _chan(col: str, i: int) -> str:
    """Channel i (0..255) of a paint_samples text."""
    h = f"substr({col}, 2)"
    dig = lambda j: f"(strpos('0123456789abcdef', substr({h}, {j}, 1)) - 1)"
    fixed = {"white": (255, 255, 255), "rebeccapurple": (0, 0, 0)}
    pct = (10, 20, 30)[i]
    return f"""CASE WHEN {col} IN ('none') OR {col} LIKE 'url%' AND FALSE THEN NULL WHEN {col} LIKE '#%' AND length({col}) = 4 THEN {dig(i + 1)} * 17.0 WHEN {col} LIKE '#%' THEN {dig(2 * i + 1)} * 16.0 + {dig(2 * i + 2)}
 WHEN {col} LIKE 'rgba%' THEN {pct} * 2.55 WHEN {col} LIKE 'rgb(%' THEN TRY_CAST(trim(string_split(replace(replace({col}, 'rgb(', ''), ')', ''), ',')[{i + 1}]) AS DOUBLE)
 WHEN {col} = 'white' THEN {fixed['white'][i]} ELSE 0 END / 255.0"""


_xd = lambda c, j: f"(strpos('0123456789ABCDEF', substr({c}, {j}, 1)) - 1)"
_byte = lambda c, i: f"({_xd(c, 2 * i + 2)} * 16 + {_xd(c, 2 * i + 3)})"

ORACLE = {
    "surface_state": _q(
        """SELECT session_id, canvas_id, min(sequence) AS created_at, arg_max(width, CASE WHEN width IS NOT NULL THEN sequence END) AS width, CAST(100 AS DOUBLE) AS height,
  coalesce(arg_max(k % 2 = 0, CASE WHEN type = 'canvas_visibility' THEN sequence END), TRUE) AS visible, count(*) AS revision, FALSE AS ended
FROM rec_log WHERE canvas_id IS NOT NULL GROUP BY session_id, canvas_id""",
        [],
    ),
    "stack_depth": _q("SELECT canvas_id, sequence, type, depth, CAST(resizes AS BIGINT) AS resizes FROM c2", SURFACE_STEPS),
    "active_clip": _q("SELECT canvas_id, sequence, type, depth, clip_seq FROM c3", CLIP_STEPS),
    "paint_epochs": _q("SELECT canvas_id, sequence, type, is_reset, epoch FROM c5", CLIP_STEPS),
    "path_epochs": _q("SELECT path_id, sequence, type, CAST(p_epoch AS BIGINT) AS path_epoch FROM pw", PATH_STEPS),
    "path_asof_snapshot": _q(
        """SELECT u.canvas_id, u.sequence, u.type, u.path_id, CASE WHEN u.p_known THEN coalesce(string_agg((CASE c.cmd WHEN 'move_to' THEN 'M ' ELSE 'L ' END) || c.k || ' ' || (c.event_id % 100), ' ' ORDER BY c.sequence), '') END AS d
FROM pw u LEFT JOIN pw c ON c.path_id = u.path_id AND c.p_epoch = u.p_epoch AND c.sequence < u.sequence AND c.cmd <> 'begin_path'
WHERE u.type IN ('fill', 'clip') GROUP BY u.canvas_id, u.sequence, u.type, u.path_id, u.p_known""",
        PATH_STEPS,
    ),
    "paint_order": _q("SELECT canvas_id, epoch, sequence, kind, kind_index, order_no FROM pn", PAINT_STEPS),
    "shape_cap": _q(
        f"""SELECT canvas_id, epoch, sequence, type, shape_no, stroke_no FROM c7
WHERE (is_shape AND shape_no <= {CAP}) OR (is_stroke AND stroke_no <= {CAP}) OR (is_clear AND shape_no + stroke_no > 0)""",
        CLIP_STEPS,
    ),
    "error_count": _q("SELECT session_id, canvas_id, errors FROM er", CLIP_STEPS + [ERRORS(CAP)]),
    "clear_over_paint": _q(
        """SELECT p.canvas_id, p.epoch, p.sequence, p.kind, CASE WHEN n.later > 0 THEN n.total - n.later + 1 END AS first_clear, n.total AS clears, n.later AS later_clears FROM pn p JOIN n USING (canvas_id, epoch, sequence)""",
        PAINT_STEPS
        + [
            (
                "n",
                """SELECT p.canvas_id, p.epoch, p.sequence, count(c.sequence) AS total, count(CASE WHEN c.sequence > p.sequence THEN 1 END) AS later FROM pn p
LEFT JOIN pn c ON c.canvas_id = p.canvas_id AND c.epoch = p.epoch AND c.kind = 'clear' WHERE p.kind <> 'clear' GROUP BY ALL""",
            )
        ],
    ),
    "stock_validation": _q(
        """SELECT session_id, canvas_id, errors, shapes, strokes, uf AS unsupported_fills, us AS unsupported_strokes, strokes > 0 AS has_strokes, shapes > 0 AND errors = 0 AND uf = 0 AND us = 0 AS valid
FROM (SELECT er.session_id, er.canvas_id, er.errors, count(CASE WHEN kind = 'shape' THEN 1 END) AS shapes, count(CASE WHEN kind = 'stroke' THEN 1 END) AS strokes,
  count(CASE WHEN kind = 'shape' AND k % 6 = 5 THEN 1 END) AS uf, count(CASE WHEN kind = 'stroke' AND k % 5 = 0 THEN 1 END) AS us FROM er LEFT JOIN cur ON cur.canvas_id = er.canvas_id GROUP BY ALL) t""",
        PAINT_STEPS + [ERRORS(5000)],
    ),
    "palette": _q(
        f"SELECT canvas_id, string_agg(DISTINCT {_HEX}, ',' ORDER BY {_HEX}) AS colors FROM cur WHERE {_HEX} IS NOT NULL GROUP BY canvas_id", PAINT_STEPS
    ),
    "drop_elements": _q(
        "SELECT canvas_id, sequence, kind, kind_index FROM cur WHERE NOT coalesce((kind = 'shape' AND kind_index = 2) OR (kind = 'stroke' AND kind_index = 1), FALSE)", PAINT_STEPS
    ),
    "drop_colors": check_sql(
        """SELECT asset_id, paint FROM y p WHERE NOT EXISTS (SELECT 1 FROM y c WHERE (c.asset_id % 97 = 8 OR c.asset_id % 89 = 1)
  AND (c.s = p.s OR (abs(c.r - p.r) < 0.002 AND abs(c.g - p.g) < 0.002 AND abs(c.b - p.b) < 0.002)))""",
        ["paint_samples"],
        _RGB + [("y", f"SELECT *, {_chan('s', 0)} AS r, {_chan('s', 1)} AS g, {_chan('s', 2)} AS b FROM x1")],
    ),
    "nearest_color": check_sql(
        """SELECT group_id, sample, arg_min(color, (distance, color)) AS color, min(distance) AS distance FROM d WHERE distance <= 2304 GROUP BY group_id, sample""",
        ["paint_samples"],
        _RGB
        + [
            ("y", f"SELECT *, asset_id % 40 AS group_id, {_chan('s', 0)} * 255 AS r, {_chan('s', 1)} * 255 AS g, {_chan('s', 2)} * 255 AS b FROM x1 WHERE s <> 'none' AND s NOT LIKE 'url%'"),
            (
                "pal",
                "SELECT DISTINCT group_id, CASE WHEN s = 'rebeccapurple' THEN '#663399' ELSE '#' || " + " || ".join(f"lpad(hex(CAST(floor({c} + 0.5 + 1e-9) AS BIGINT)), 2, '0')" for c in "rgb") + " END AS color FROM y",
            ),
            ("smp", "SELECT DISTINCT asset_id % 40 AS group_id, '#' || lpad(hex(asset_id * 104729 % 16777216), 6, '0') AS sample FROM paint_samples"),
            (
                "d",
                "SELECT group_id, sample, color, CAST(" + " + ".join(f"({_byte('color', i)} - {_byte('sample', i)}) * ({_byte('color', i)} - {_byte('sample', i)})" for i in range(3)) + " AS BIGINT) AS distance FROM smp JOIN pal USING (group_id)",
            ),
        ],
    ),
}
