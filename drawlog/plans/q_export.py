"""Document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.functions.text import safe_filename
from drawlog.operators import assets as av
from drawlog.operators import export as ex
from drawlog.operators import surface as sf
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.plans.q_assets import _REV, markup_assets
from drawlog.plans.q_functions import d_fmt4
from drawlog.plans.q_surface import ERRORS, PAINT_STEPS
from drawlog.schema import SURFACE
from drawlog.sources import readers, sinks
from drawlog.sources.staging import stage, stage_path


def _drawings(spark, sf_dir):
    """Paints of all canvases and their documents with settings."""
    log = stage(fx.draw_log(spark, sf_dir), "log")
    numbered = sf.numbered_log(sf.surface_log(log, written=False))
    table = sf.paints(log, numbered)
    docs = sf.state_of(numbered).select(*SURFACE, "width", "height").join(sf.error_count(numbered).hint("merge"), SURFACE)
    settings = readers.load_export_settings(
        docs.withColumns(
            {
                "ratio": F.expr("CASE WHEN canvas_id LIKE '%-1' THEN '4:3' END"),
                "transparent_background": F.expr("length(canvas_id) % 2 = 0"),
                "filename": F.concat("canvas_id", F.lit(".eps")),
            }
        )
    )
    return table, stage(settings.drop("removed_colors", "removed_elements"), "docs")


def _removals(docs):
    ids = docs.select("canvas_id", F.lit("shape-2").alias("element_id"))
    colors = docs.where("canvas_id LIKE '%-2'").select("canvas_id", F.lit("#FF0000").alias("color"))
    return ids, colors


def svg_documents(spark, sf_dir):
    table, docs = _drawings(spark, sf_dir)
    ids, colors = _removals(docs)
    out = ex.svg_documents(table, docs, SURFACE, ids, colors)
    return out.select("canvas_id", "svg", "art_width", "art_height", "art_ratio")


def eps_documents(spark, sf_dir):
    table, docs = _drawings(spark, sf_dir)
    ids, colors = _removals(docs)
    out = ex.eps_documents(table, docs, SURFACE, ids, colors)
    return out.select("canvas_id", "eps", "art_width", "art_height", "art_ratio")


def document_stats(spark, sf_dir):
    table, docs = _drawings(spark, sf_dir)
    ids, _ = _removals(docs)
    out = ex.document_stats(table, docs, SURFACE, ids)
    return out.select(
        "canvas_id", "shapes", "gap_fillers", "errors", "artboard.width", "artboard.height", "artboard.pixels",
        "artboard.ratio", "stock_validation.valid", "stock_validation.unsupported_fills",
        "stock_validation.unsupported_strokes", "stock_validation.has_strokes", "error",
    )


def _wrapped(spark, sf_dir, fmt):
    a = readers.load_export_settings(markup_assets(spark, sf_dir)).drop("removed_colors", "removed_elements")
    return ex.wrapped_vector_documents(a, fmt=fmt)


def wrapped_vector_documents(spark, sf_dir):
    svg = _wrapped(spark, sf_dir, "svg").withColumn("fmt", F.lit("svg"))
    eps = _wrapped(spark, sf_dir, "eps").withColumn("fmt", F.lit("eps"))
    return svg.unionByName(eps).select("svg_id", "fmt", "text", "art_width", "art_height", "art_ratio")


def write_documents(spark, sf_dir):
    key = ["session_id", "svg_id"]
    catalog = av.vector_catalog(fx.view(spark, sf_dir, "svg_asset_updates"))
    catalog = catalog.withColumn("filename", safe_filename(F.col("filename"), "svg"))
    none = spark.createDataFrame([], "filename string")
    asked = catalog.select(F.col("arrival").alias("row_no"), "filename", *key)
    named = av.allocate_unique_filenames(asked, none).select(*key, "stored_name")
    settings = readers.load_export_settings(catalog).drop("removed_colors", "removed_elements")
    docs = stage(ex.wrapped_vector_documents(settings, key).join(named, key).select("svg_id", "stored_name", "text"), "named")
    path = stage_path(spark, "documents")
    sinks.write_documents(docs, path, "svg")
    files = sinks.read_documents(spark, path, "svg")
    return files.join(docs.select("svg_id", F.col("stored_name").alias("filename")), "filename").select(
        "svg_id", "filename", F.lit("svg").alias("fmt"), F.sha2("document", 256).alias("text_sha256")
    )


QUERIES = {f.__name__: f for f in (svg_documents, eps_documents, document_stats, wrapped_vector_documents, write_documents)}

_SIZE = [
    ("sz", "SELECT canvas_id, arg_max(now_width, sequence) AS width, 100.0::DOUBLE AS height FROM c0 GROUP BY canvas_id"),
    (
        "ab",
        """SELECT *, CASE WHEN canvas_id LIKE '%-1' THEN 4 ELSE width::BIGINT // gcd(width::BIGINT, 100) END AS rw, CASE WHEN canvas_id LIKE '%-1' THEN 3 ELSE 100 // gcd(width::BIGINT, 100) END AS rh,
  CASE WHEN canvas_id LIKE '%-1' THEN '4:3' ELSE 'source' END AS ratio, greatest(width * height, 15000000.0) AS target FROM sz""",
    ),
    ("ab2", "SELECT *, greatest(sqrt(target / (rw * rh)), 1.0) AS raw FROM ab"),
    (
        "ab3",
        """SELECT *, CAST(CASE WHEN rw * rh * floor(raw) * floor(raw) < 15000000 THEN ceil(raw) WHEN abs(rw * rh * ceil(raw) * ceil(raw) - target) < abs(rw * rh * floor(raw) * floor(raw) - target) THEN ceil(raw) ELSE floor(raw) END AS BIGINT) AS m FROM ab2""",
    ),
]

_ESC = "replace(replace(replace(replace(d, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_BOX = f"'M 0 0 h ' || {d_fmt4('now_width')} || ' v 100 h ' || {d_fmt4('-now_width')} || ' Z'"
_I = "matrix(1 0 0 1 0 0)"

# Paints with their path text, the kept ones, and the boxes of all.
DRAWING_STEPS = (
    PAINT_STEPS
    + [
        (
            "pd",
            """SELECT p.canvas_id, p.sequence, string_agg((CASE c.cmd WHEN 'move_to' THEN 'M ' ELSE 'L ' END) || c.k || ' ' || (c.event_id % 100), ' ' ORDER BY c.sequence) AS raw
FROM pw p JOIN pw c ON c.path_id = p.path_id AND c.p_epoch = p.p_epoch AND c.sequence < p.sequence AND c.cmd <> 'begin_path' WHERE p.type IN ('fill', 'clip') GROUP BY p.canvas_id, p.sequence""",
        ),
        (
            "px",
            """SELECT *, array_to_string(list_transform(string_split(raw, ' M '), lambda s: s || ' Z'), ' M ') AS d FROM pd""",
        ),
        (
            "pt",
            """SELECT cur.*, CASE WHEN cur.type = 'fill' THEN px.d WHEN kind = 'clear' THEN CASE WHEN k % 10 = 1 THEN 'M 0 0 h 2000 v 100 h -2000 Z' ELSE 'M ' || k || ' 0 h 20 v 100 h -20 Z' END
   ELSE 'M ' || k || ' ' || (event_id % 100) || ' h ' || (10 + k % 40) || ' v ' || (10 + event_id % 30) || ' h -' || (10 + k % 40) || ' Z' END AS d,
  cl.d AS clip_d, count(CASE WHEN kind = 'clear' THEN 1 END) OVER (PARTITION BY cur.canvas_id ORDER BY cur.sequence ROWS UNBOUNDED PRECEDING) AS clear_no
FROM cur LEFT JOIN px ON px.canvas_id = cur.canvas_id AND px.sequence = cur.sequence LEFT JOIN (SELECT canvas_id, sequence, coalesce(d, '') AS d FROM c7 LEFT JOIN px USING (canvas_id, sequence) WHERE type = 'clip') cl ON cl.canvas_id = cur.canvas_id AND cl.sequence = cur.clip_seq""",
        ),
        (
            "kept",
            "SELECT * FROM pt WHERE kind <> 'clear' AND NOT (kind = 'shape' AND kind_index = 2) AND NOT (canvas_id LIKE '%-2' AND paint = '#f00')",
        ),
        # Boxes of the fill paths from their points.
        (
            "pp",
            """SELECT k.canvas_id, k.sequence, k.kind, min(c.k) AS x0, max(c.k) AS x1, min(c.event_id % 100) AS y0, max(c.event_id % 100) AS y1, count(CASE WHEN c.cmd = 'line_to' THEN 1 END) AS n
FROM pt k JOIN pw p ON p.frame_id = k.frame_id AND p.sequence = k.sequence JOIN pw c ON c.path_id = p.path_id AND c.p_epoch = p.p_epoch AND c.sequence < p.sequence AND c.cmd <> 'begin_path' WHERE k.type = 'fill' GROUP BY ALL""",
        ),
        (
            "bx",
            """SELECT canvas_id, sequence, kind, x0::DOUBLE AS x0, x1::DOUBLE AS x1, y0::DOUBLE AS y0, y1::DOUBLE AS y1, n FROM pp
UNION ALL SELECT canvas_id, sequence, kind, k, k + 10 + k % 40, event_id % 100, event_id % 100 + 10 + event_id % 30, 1 FROM pt WHERE type IN ('fill_rect', 'stroke_rect')""",
        ),
        # Tight boxes: of a path only the parts with a line, none if it does not start with a move.
        (
            "ti",
            """SELECT canvas_id, sequence, kind, list_transform(regexp_extract_all(part, '[-0-9.]+'), lambda v: v::DOUBLE) AS v FROM (SELECT canvas_id, sequence, kind, unnest(regexp_extract_all(d, 'M [-0-9.]+ [-0-9.]+(?: L [-0-9.]+ [-0-9.]+)+')) AS part
FROM pt WHERE type = 'fill' AND starts_with(d, 'M'))""",
        ),
        (
            "tb",
            """SELECT canvas_id, sequence, kind, min(list_min(list_filter(v, lambda x, i: i % 2 = 1))) AS x0, max(list_max(list_filter(v, lambda x, i: i % 2 = 1))) AS x1,
  min(list_min(list_filter(v, lambda x, i: i % 2 = 0))) AS y0, max(list_max(list_filter(v, lambda x, i: i % 2 = 0))) AS y1 FROM ti GROUP BY ALL
UNION ALL SELECT b.canvas_id, b.sequence, b.kind, x0, x1, y0, y1 FROM bx b JOIN pt USING (canvas_id, sequence) WHERE pt.type <> 'fill'""",
        ),
    ]
)
# The drawing text rebuilt from the same steps: path text, layers, masks.
_SVG = (
    DRAWING_STEPS
    + [
        (
            "ak",
            """SELECT b.canvas_id, coalesce(min(CASE WHEN b.kind = 'shape' THEN x0 END), min(x0)) AS x0, coalesce(max(CASE WHEN b.kind = 'shape' THEN x1 END), max(x1)) AS x1,
  coalesce(min(CASE WHEN b.kind = 'shape' THEN y0 END), min(y0)) AS y0, coalesce(max(CASE WHEN b.kind = 'shape' THEN y1 END), max(y1)) AS y1
FROM bx b JOIN kept k ON k.canvas_id = b.canvas_id AND k.sequence = b.sequence WHERE b.kind = 'shape' OR k.clip_seq IS NULL GROUP BY b.canvas_id""",
        ),
    ]
    + _SIZE
    + [
        ("fa", "SELECT ab3.*, (rw * m)::DOUBLE AS aw, (rh * m)::DOUBLE AS ah FROM ab3"),
        ("fb", "SELECT *, least(aw * 0.9::DOUBLE / greatest(width, 1.0), ah * 0.9::DOUBLE / greatest(height, 1.0)) AS s FROM fa"),
        (
            "fc",
            """SELECT fb.*, coalesce(aw / 2.0 - (x0 + x1) / 2.0 * s, (aw - width * s) / 2.0) AS ox, coalesce(ah / 2.0 - (y0 + y1) / 2.0 * s, (ah - height * s) / 2.0) AS oy FROM fb LEFT JOIN ak USING (canvas_id)""",
        ),
        (
            "ly",
            f"""SELECT canvas_id, sequence AS o, CASE WHEN kind = 'shape' THEN '    <path id="shape-' || kind_index || '" d="' || {_ESC} || '" fill="' || paint || '" fill-rule="nonzero" transform="{_I}"/>' || chr(10)
  ELSE '    <path id="gap-filler-' || kind_index || '" d="' || {_ESC} || '" fill="none" stroke="' || paint || '" stroke-width="' || (k % 5) || '" transform="{_I}"/>' || chr(10) END AS t FROM kept
UNION ALL SELECT canvas_id, sequence, '</g>' || chr(10) FROM pt WHERE kind = 'clear'
UNION ALL SELECT canvas_id, -clear_no, '<g mask="url(#clear-' || clear_no || ')">' || chr(10) FROM pt WHERE kind = 'clear'""",
        ),
        ("lt", "SELECT canvas_id, string_agg(t, '' ORDER BY o) AS layers FROM ly GROUP BY canvas_id"),
        (
            "mb",
            """SELECT sz.canvas_id, sz.width, least(0.0, min(x0 - g)) - 1 AS mx0, least(0.0, min(y0 - g)) - 1 AS my0, greatest(any_value(sz.width), max(x1 + g)) + 1 AS mx1, greatest(100.0, max(y1 + g)) + 1 AS my1
FROM sz LEFT JOIN (SELECT b.canvas_id, x0, x1, y0, y1, CASE WHEN b.kind = 'stroke' THEN (pt.k % 5) * 8.0::DOUBLE ELSE 0.0 END AS g FROM tb b JOIN pt ON pt.canvas_id = b.canvas_id AND pt.sequence = b.sequence) z ON z.canvas_id = sz.canvas_id GROUP BY ALL""",
        ),
        (
            "df",
            f"""SELECT canvas_id, string_agg('<clipPath id="clear-' || clear_no || '-clip-0" clipPathUnits="userSpaceOnUse"><path d="' || {_BOX} || '" transform="{_I}"/></clipPath>' || chr(10)
  || CASE WHEN clip_d IS NOT NULL THEN '<clipPath id="clear-' || clear_no || '-clip-1" clipPathUnits="userSpaceOnUse"><path d="' || clip_d || '" transform="{_I}"/></clipPath>' || chr(10) ELSE '' END
  || '<mask id="clear-' || clear_no || '" maskUnits="userSpaceOnUse" maskContentUnits="userSpaceOnUse" ' || rc || ' style="mask-type:luminance"><rect ' || rc || ' fill="white"/>'
  || CASE WHEN clip_d IS NOT NULL THEN '<g clip-path="url(#clear-' || clear_no || '-clip-1)">' ELSE '' END || '<g clip-path="url(#clear-' || clear_no || '-clip-0)"><path d="' || d || '" transform="{_I}" fill="black"/></g>'
  || CASE WHEN clip_d IS NOT NULL THEN '</g>' ELSE '' END || '</mask>' || chr(10), '' ORDER BY clear_no) AS defs
FROM pt JOIN (SELECT canvas_id, 'x="' || {d_fmt4('mx0')} || '" y="' || {d_fmt4('my0')} || '" width="' || {d_fmt4('mx1 - mx0')} || '" height="' || {d_fmt4('my1 - my0')} || '"' AS rc FROM mb) r USING (canvas_id) WHERE kind = 'clear' GROUP BY canvas_id""",
        ),
    ]
)
_W, _H = "(rw * m)", "(rh * m)"
_SVG_TEXT = f"""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="' || {_W} || '" height="' || {_H} || '" viewBox="0 0 ' || {_W} || ' ' || {_H} || '" color-interpolation="sRGB">' || chr(10) || '  <title>Editable vector artwork</title>' || chr(10)
 || CASE WHEN length(canvas_id) % 2 = 0 THEN '' ELSE '  <g id="background" aria-label="Background">' || chr(10) || '    <rect id="background-color" width="' || {_W} || '" height="' || {_H} || '" fill="#ffffff"/>' || chr(10) || '  </g>' || chr(10) END
 || CASE WHEN defs IS NULL THEN '' ELSE '<defs>' || chr(10) || defs || '</defs>' || chr(10) END
 || '  <g id="artwork-transform" aria-label="Artwork transform" transform="translate(' || {d_fmt4('ox')} || ' ' || {d_fmt4('oy')} || ') scale(' || {d_fmt4('s')} || ')">' || chr(10) || '    <g id="artwork" aria-label="Artwork">' || chr(10)
 || coalesce(layers, '') || chr(10) || '    </g>' || chr(10) || '  </g>' || chr(10) || '</svg>'"""

# An asset of 100 by 50 at the default size: two to one, at least 15 million pixels, nine tenths of it filled.
_WRAPPED = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="5478" height="2739" viewBox="0 0 5478 2739" color-interpolation="sRGB">' || chr(10)
 || '  <title>Imported SVG artwork</title>' || chr(10) || '  <rect id="background-color" width="5478" height="2739" fill="#ffffff"/>' || chr(10)
 || '  <g id="artwork-transform" aria-label="Artwork transform" transform="translate(273.9 136.95) scale(49.302)">' || chr(10) || markup || chr(10) || '  </g>' || chr(10) || '</svg>'"""

ORACLE = {
    "svg_documents": check_sql(
        f"SELECT canvas_id, {_SVG_TEXT} AS svg, rw * m AS art_width, rh * m AS art_height, ratio AS art_ratio FROM fc LEFT JOIN lt USING (canvas_id) LEFT JOIN df USING (canvas_id)",
        ["rec_log"],
        _SVG,
    ),
    "document_stats": check_sql(
        f"""SELECT canvas_id, shapes, gap_fillers, errors, rw * m AS width, rh * m AS height, rw * m * rh * m AS pixels, ratio, valid, uf AS unsupported_fills, us AS unsupported_strokes, gap_fillers > 0 AS has_strokes,
  CASE WHEN NOT valid THEN '{ex.WARNING}' END AS error
FROM (SELECT *, allshapes > 0 AND errors = 0 AND uf = 0 AND us = 0 AS valid FROM (SELECT ab3.canvas_id, rw, rh, m, ratio, errors, count(CASE WHEN kind = 'shape' AND kind_index <> 2 THEN 1 END) AS shapes, count(CASE WHEN kind = 'stroke' THEN 1 END) AS gap_fillers,
   count(CASE WHEN kind = 'shape' AND k % 6 = 5 THEN 1 END) AS uf, count(CASE WHEN kind = 'stroke' AND k % 5 = 0 THEN 1 END) AS us, count(CASE WHEN kind = 'shape' THEN 1 END) AS allshapes
 FROM ab3 JOIN er ON er.canvas_id = ab3.canvas_id LEFT JOIN cur ON cur.canvas_id = ab3.canvas_id GROUP BY ab3.canvas_id, rw, rh, m, ratio, errors) t0) t""",
        ["rec_log"],
        PAINT_STEPS + [ERRORS(5000)] + _SIZE,
    ),
    "write_documents": check_sql(
        f"""SELECT svg_id, CASE WHEN rn = 0 THEN filename ELSE replace(filename, '.svg', '_' || rn || '.svg') END AS filename, 'svg' AS fmt, sha256({_WRAPPED}) AS text_sha256
FROM (SELECT svg_id, filename, row_number() OVER (PARTITION BY filename ORDER BY arrival) - 1 AS rn, markup FROM vl) t""",
        ["svg_asset_updates"],
        _REV,
    ),
}
