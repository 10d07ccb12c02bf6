"""Segment and bounds queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.operators import segments as sg
from drawlog.operators import surface
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.plans.q_export import DRAWING_STEPS
from drawlog.sources.staging import stage

_ROW = ["shape_id", "z", "d"]


def explode_path_segments(spark, sf_dir):
    return sg.explode_path_segments(fx.view(spark, sf_dir, "path_text")).select(
        *_ROW, "asset_id", "seg_no", "letter", "x", "y", "c1x", "c2y"
    )


def path_bounds(spark, sf_dir):
    p = fx.view(spark, sf_dir, "path_text")
    m = F.expr("CASE WHEN z % 2 = 0 THEN array(2D, 0D, 0D, -1D, 5D, 7D) END")
    b = sg.path_bounds(p.withColumn("transform", m))
    return b.select(*_ROW, *[F.col(f"bounds.{c}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def flatten_arcs(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(
            F.lit("M 0 0 A "), (F.col("p_size") % 7).cast("string"), F.lit(" 5 "), (F.col("p_size") * 3).cast("string"),
            F.when(F.col("p_partkey") % 2 == 0, " 1 ").otherwise(" 0 "),
            F.when(F.col("p_partkey") % 3 == 0, "0 ").otherwise("1 "),
            (F.col("p_partkey") % 11).cast("string"), F.lit(" 4 Q 1 2 3 4 T 9 9 S 1 1 2 2 Z"),
        ).alias("d"),
    )
    flat = sg.flatten_arcs(sg.explode_path_segments(p))
    return flat.select("p_partkey", "seg_no", "piece_no", "letter", *[F.round(c, 6).alias(c) for c in ("px", "py", "c1x", "c1y", "c2x", "c2y", "x", "y")])


def _paints(spark, sf_dir):
    """Current paints with their path text and size."""
    log = stage(fx.draw_log(spark, sf_dir), "log")
    numbered = surface.numbered_log(surface.surface_log(log, written=False))
    return numbered, surface.paints(log, numbered)


def artwork_bounds(spark, sf_dir):
    _, p = _paints(spark, sf_dir)
    return sg.artwork_bounds(p, ["canvas_id"])


def document_size(spark, sf_dir):
    _, p = _paints(spark, sf_dir)
    return sg.document_size(p, ["canvas_id"])


def clear_mask_bounds(spark, sf_dir):
    s, p = _paints(spark, sf_dir)
    sizes = surface.state_of(s).select("canvas_id", "width", "height")
    return sg.clear_mask_bounds(p, sizes, ["canvas_id"])


QUERIES = {
    f.__name__: f
    for f in (explode_path_segments, path_bounds, flatten_arcs, artwork_bounds, document_size, clear_mask_bounds)
}

_X = "CASE WHEN form = 0 THEN CASE WHEN seg_no IN (1, 4) THEN n ELSE n + q END WHEN form = 1 THEN CASE seg_no WHEN 2 THEN q ELSE 0 END ELSE CASE seg_no WHEN 2 THEN q ELSE 0 END END"
_Y = "CASE WHEN form = 0 THEN CASE WHEN seg_no = 3 THEN 10 ELSE 0 END WHEN form = 1 THEN CASE seg_no WHEN 1 THEN 0 ELSE 20 END ELSE CASE seg_no WHEN 2 THEN 30 ELSE 0 END END"

_BOXES = [step for step in DRAWING_STEPS if step[0] != "kept"]
_REACH = _BOXES + [
    ("sm", "SELECT canvas_id, max(x1) AS mx, max(y1) AS my FROM tb WHERE kind = 'shape' GROUP BY canvas_id"),
    ("so", "SELECT canvas_id, bool_and(type <> 'fill' OR d = '' OR starts_with(d, 'M')) AS ok FROM pt WHERE kind = 'shape' GROUP BY canvas_id"),
]

ORACLE = {
    "explode_path_segments": check_sql(
        f"""SELECT shape_id, z, d, asset_id, CAST(seg_no AS BIGINT) AS seg_no, letter, CAST({_X} AS DOUBLE) AS x, CAST({_Y} AS DOUBLE) AS y,
  CASE WHEN form = 2 AND seg_no = 2 THEN 10::DOUBLE WHEN form = 2 AND seg_no = 3 THEN 5::DOUBLE END AS c1x, CASE WHEN form = 2 AND seg_no = 2 THEN 10::DOUBLE END AS c2y
FROM f JOIN (VALUES (0,1,'M'),(0,2,'H'),(0,3,'V'),(0,4,'Z'),(1,1,'M'),(1,2,'L'),(1,3,'L'),(2,1,'M'),(2,2,'C'),(2,3,'Q'),(2,4,'Z')) s(form, seg_no, letter) USING (form)""",
        ["path_text"],
        [
            (
                "f",
                "SELECT *, CAST(asset_id % 4 AS INT) AS form, CAST(z AS DOUBLE) AS n, CAST(CASE asset_id % 4 WHEN 0 THEN regexp_extract(d, 'h ([0-9]+)', 1) WHEN 1 THEN regexp_extract(d, 'L([0-9]+),', 1) WHEN 2 THEN regexp_extract(d, '([0-9]+) 30 Q', 1) ELSE '0' END AS DOUBLE) AS q FROM path_text",
            )
        ],
    ),
    "path_bounds": check_sql(
        """SELECT shape_id, z, d, CASE WHEN form < 3 THEN least(a * x0 + e, a * x1 + e) END AS min_x, CASE WHEN form < 3 THEN least(b * y0 + g, b * y1 + g) END AS min_y,
  CASE WHEN form < 3 THEN greatest(a * x0 + e, a * x1 + e) END AS max_x, CASE WHEN form < 3 THEN greatest(b * y0 + g, b * y1 + g) END AS max_y
FROM (SELECT *, CASE WHEN z % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS a, CASE WHEN z % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0 END AS b, CASE WHEN z % 2 = 0 THEN 5.0::DOUBLE ELSE 0.0 END AS e, CASE WHEN z % 2 = 0 THEN 7.0::DOUBLE ELSE 0.0 END AS g,
   CASE WHEN form = 0 THEN n ELSE 0.0 END AS x0, CASE WHEN form = 0 THEN n + q WHEN form = 1 THEN q ELSE greatest(q, 20.0) END AS x1, 0.0::DOUBLE AS y0, CASE form WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 20.0 ELSE 30.0 END AS y1 FROM f) t""",
        ["path_text"],
        [
            (
                "f",
                "SELECT *, CAST(asset_id % 4 AS INT) AS form, CAST(z AS DOUBLE) AS n, CAST(CASE asset_id % 4 WHEN 0 THEN regexp_extract(d, 'h ([0-9]+)', 1) WHEN 1 THEN regexp_extract(d, 'L([0-9]+),', 1) WHEN 2 THEN regexp_extract(d, '([0-9]+) 30 Q', 1) ELSE '0' END AS DOUBLE) AS q FROM path_text",
            )
        ],
    ),
    "artwork_bounds": check_sql(
        """SELECT b.canvas_id, coalesce(min(CASE WHEN b.kind = 'shape' THEN x0 END), min(x0)) AS min_x, coalesce(min(CASE WHEN b.kind = 'shape' THEN y0 END), min(y0)) AS min_y,
  coalesce(max(CASE WHEN b.kind = 'shape' THEN x1 END), max(x1)) AS max_x, coalesce(max(CASE WHEN b.kind = 'shape' THEN y1 END), max(y1)) AS max_y
FROM bx b JOIN pt k ON k.canvas_id = b.canvas_id AND k.sequence = b.sequence WHERE b.kind = 'shape' OR k.clip_seq IS NULL GROUP BY b.canvas_id""",
        ["rec_log"],
        _BOXES,
    ),
    "document_size": check_sql(
        """SELECT canvas_id, CASE WHEN ok AND mx > 0 AND my > 0 THEN ceil(mx) END AS doc_width, CASE WHEN ok AND mx > 0 AND my > 0 THEN ceil(my) END AS doc_height
FROM so LEFT JOIN sm USING (canvas_id)""",
        ["rec_log"],
        _REACH,
    ),
    "clear_mask_bounds": check_sql(
        """SELECT sz.canvas_id, least(0.0, min(x0 - g)) - 1 AS mask_x0, least(0.0, min(y0 - g)) - 1 AS mask_y0, greatest(any_value(w), max(x1 + g)) + 1 AS mask_x1, greatest(100.0, max(y1 + g)) + 1 AS mask_y1
FROM sz LEFT JOIN (SELECT b.canvas_id, x0, x1, y0, y1, CASE WHEN b.kind = 'stroke' THEN (pt.k % 5) * 8.0::DOUBLE ELSE 0.0 END AS g FROM tb b JOIN pt ON pt.canvas_id = b.canvas_id AND pt.sequence = b.sequence) z ON z.canvas_id = sz.canvas_id GROUP BY sz.canvas_id""",
        ["rec_log"],
        _BOXES + [("sz", "SELECT canvas_id, arg_max(now_width, sequence) AS w FROM c0 GROUP BY canvas_id")],
    ),
}
