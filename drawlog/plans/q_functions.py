"""Column functions applied to whole tables, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.functions import color, geometry, rules, sizing, text
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.sources import readers

# ---------------------------------------------------------------- check-side expressions


def d_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def d_fmt4(x: str) -> str:
    t = rf"regexp_replace(printf('%.4f', round(({x}) * 10000.0) / 10000.0), '\.?0+$', '')"
    return f"(CASE WHEN {t} = '-0' THEN '0' ELSE {t} END)"


def d_hex(h: str, i: int) -> str:
    return f"(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"


def d_finite(x: str) -> str:
    return f"({x} IS NOT NULL AND isfinite({x}))"


# Extra inputs; each text runs unchanged in both engines.
INPUTS = {
    "numbers": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  l_extendedprice * (l_discount - 0.05) / 7.0 AS v, l_quantity AS x, l_tax AS t, l_discount AS dc FROM {lineitem}""",
    "paints": """SELECT asset_id, CASE asset_id % 5 WHEN 1 THEN '  ' || upper(paint) || ' ' WHEN 2 THEN CASE asset_id % 4 WHEN 0 THEN '#12345678' WHEN 1 THEN 'Green' WHEN 2 THEN '#abcd' ELSE '' END ELSE paint END AS paint FROM {paint_samples}""",
    "rects": """SELECT p_partkey AS asset_id, CAST(p_size % 7 - 3 AS DOUBLE) AS x, CAST(0 - p_partkey % 5 AS DOUBLE) AS y, CAST(p_size * 20 - 300 AS DOUBLE) AS w, CAST(p_partkey % 400 AS DOUBLE) AS h,
  CAST(p_partkey % 3 AS DOUBLE) AS a, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE -2 END AS DOUBLE) AS d, CAST(p_partkey % 4 AS DOUBLE) AS e FROM {part}""",
    "candidates": """SELECT page_id, dom_id, CAST(shapes AS BIGINT) AS shapes, box_w, box_h, page_id % 7 = 0 AS hidden,
  CASE WHEN page_id % 5 = 0 THEN 'none' ELSE 'block' END AS display,
  CASE page_id % 9 WHEN 0 THEN 'collapse' WHEN 1 THEN 'hidden' WHEN 2 THEN NULL ELSE 'visible' END AS visibility,
  CASE WHEN page_id % 4 = 3 THEN 0.0E0 ELSE 0.5E0 END AS opacity, page_id % 11 = 0 AS own_control,
  CASE page_id % 5 WHEN 0 THEN '120' WHEN 1 THEN '50px' WHEN 2 THEN '' WHEN 3 THEN '0' END AS attr_width,
  CASE page_id % 4 WHEN 0 THEN '40.5' WHEN 1 THEN 'auto' END AS attr_height,
  CASE page_id % 3 WHEN 0 THEN '0 0 300 200' WHEN 1 THEN '0,0,64' END AS view_box,
  CASE WHEN page_id % 6 = 0 THEN 'art.v2.PNG' WHEN page_id % 6 = 1 THEN '' END AS data_filename,
  CASE WHEN page_id % 2 = 0 THEN '' ELSE 'Title ' || CAST(page_id AS VARCHAR(10)) END AS title FROM {svg_candidates}""",
    "commands": """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'move_to' WHEN 1 THEN 'line_to' WHEN 2 THEN 'bezier_curve_to' WHEN 3 THEN 'quadratic_curve_to' WHEN 4 THEN 'close_path' WHEN 5 THEN 'rect'
    WHEN 6 THEN 'arc' WHEN 7 THEN 'ellipse' WHEN 8 THEN 'begin_path' WHEN 9 THEN 'scribble' WHEN 10 THEN 'arc' ELSE 'line_to' END AS kind,
  CASE WHEN event_id % 12 = 11 THEN 1 ELSE 8 END AS n, value AS v, CAST(user_id % 40 AS DOUBLE) AS u, CAST(event_id % 7 AS DOUBLE) AS q, event_id % 2 = 0 AS has_current FROM {events}""",
    "stored": """SELECT asset_id, CASE asset_id % 10 WHEN 0 THEN 'source' WHEN 1 THEN '1:1' WHEN 2 THEN '14:10' WHEN 3 THEN 'custom' WHEN 4 THEN 'bad' WHEN 5 THEN '0:5' WHEN 6 THEN '20000:3' WHEN 7 THEN '16:9' WHEN 8 THEN NULL ELSE '4:5' END AS ratio,
  CASE asset_id % 4 WHEN 0 THEN '12.6' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE '0' END AS custom_width,
  CASE asset_id % 3 WHEN 0 THEN '99999' WHEN 1 THEN NULL ELSE '7' END AS custom_height,
  CASE asset_id % 6 WHEN 0 THEN '-1' WHEN 1 THEN 'NaN?' WHEN 2 THEN NULL ELSE '4' END AS min_megapixels,
  CASE asset_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '50.5' WHEN 2 THEN NULL ELSE '65' END AS max_megapixels,
  CASE asset_id % 3 WHEN 0 THEN '#A1b2C3' WHEN 1 THEN 'red' ELSE '#fff' END AS background_color,
  CASE asset_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS apply_background,
  CASE asset_id % 5 WHEN 0 THEN '0.1' WHEN 1 THEN '1.2345' WHEN 2 THEN '9' WHEN 3 THEN NULL ELSE '2.5' END AS artwork_scale,
  CASE asset_id % 6 WHEN 0 THEN ' a/b/c?.svg ' WHEN 1 THEN '.' WHEN 2 THEN '' WHEN 3 THEN 'name' WHEN 4 THEN 'X.SVG' END AS filename FROM {artboard_jobs}""",
    "names": """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'dir/' || substr(url, 8) || '.svg' WHEN 2 THEN 'a:b<c>|d.SVG' WHEN 3 THEN '..' WHEN 4 THEN 'x/y/' WHEN 5 THEN '' WHEN 6 THEN 'pic.eps' ELSE 'q' || CAST(page_id AS VARCHAR(10)) || '.svg' END AS name FROM {pages}""",
    "partial_settings": """SELECT asset_id, CASE WHEN asset_id % 2 = 0 THEN ratio END AS ratio, CASE WHEN asset_id % 3 = 0 THEN min_pixels END AS min_pixels, CASE WHEN asset_id % 5 <> 0 THEN max_pixels END AS max_pixels,
  CASE WHEN asset_id % 4 = 0 THEN '#123456' END AS background_color, CASE WHEN asset_id % 7 = 0 THEN TRUE END AS transparent_background, CASE WHEN asset_id % 6 = 0 THEN CAST(2 AS DOUBLE) END AS artwork_scale FROM {artboard_jobs}""",
    "assets_raw": """SELECT svg_id, arrival, width * (CASE WHEN arrival % 31 = 0 THEN 0 ELSE 1 END) AS width, height, shapes * (CASE WHEN arrival % 37 = 0 THEN 99999 ELSE 1 END) AS shapes,
  CASE WHEN arrival % 41 = 0 THEN repeat('n', 256) ELSE filename END AS filename, CASE WHEN arrival % 43 = 0 THEN repeat('i', 257) ELSE svg_id END AS long_id, '  ' || markup AS markup FROM {svg_asset_updates}""",
    "canvas_ids": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'frame-' || CAST(user_id AS VARCHAR(20)) || '-canvas-' || event_type WHEN 1 THEN 'a-canvas-b-canvas-' || CAST(user_id AS VARCHAR(20)) WHEN 2 THEN event_type ELSE '-canvas-' END AS canvas_id FROM {events}""",
}
_VIEW_OF = {
    "paints": "paint_samples",
    "candidates": "svg_candidates",
    "stored": "artboard_jobs",
    "partial_settings": "artboard_jobs",
    "assets_raw": "svg_asset_updates",
}


def load(spark, sf_dir, name):
    source = _VIEW_OF.get(name)
    if source:
        df = fx.view(spark, sf_dir, source)
        return spark.sql(INPUTS[name], **{source: df})
    return spark.sql(INPUTS[name].format(**{t: fx._table(sf_dir, t) for t in fx.TABLES}))


def steps(name):
    source = _VIEW_OF.get(name)
    body = INPUTS[name].format(**{**{t: t for t in fx.TABLES}, **({source: source} if source else {})})
    return ([source] if source else []), [(name, body)]


def on(name, select, extra=()):
    views, s = steps(name)
    return check_sql(select, views, s + list(extra))


# ---------------------------------------------------------------- queries


def q_fmt4(spark, sf_dir):
    n = load(spark, sf_dir, "numbers")
    return n.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.fmt4(F.col("v")).alias("text"))


def _m(*cols):
    return F.array(*[F.lit(c) if isinstance(c, float) else c for c in cols])


def q_affine_apply(spark, sf_dir):
    n = load(spark, sf_dir, "numbers")
    p = geometry.affine_apply(_m(F.col("dc"), 1.0, -1.0, F.col("t"), 100.0, 200.0), F.col("x"), F.col("v"))
    return n.withColumn("p", p).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py")
    )


def q_matrix_text(spark, sf_dir):
    n = load(spark, sf_dir, "numbers")
    m = F.when(F.col("l_linenumber") % 3 != 0, _m(1.0, F.col("dc"), F.col("t") - F.col("t"), 1.0, F.col("x"), F.col("v")))
    return n.withColumn("m", m).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        geometry.matrix_text(F.col("m")).alias("text"),
        geometry.is_identity(F.col("m")).alias("identity"),
        F.round(geometry.determinant(F.col("m")), 6).alias("det"),
    )


def q_parse_paint_rgb(spark, sf_dir):
    p = load(spark, sf_dir, "paints").withColumn("c", color.parse_paint_rgb(F.col("paint")))
    return p.select("asset_id", "paint", *[F.round(f"c.{k}", 6).alias(k) for k in "rgb"])


def q_normalize_paint_hex(spark, sf_dir):
    p = load(spark, sf_dir, "paints")
    return p.select("asset_id", "paint", color.normalize_paint_hex(F.col("paint")).alias("hex_color"))


def q_portable_paint(spark, sf_dir):
    p = load(spark, sf_dir, "paints")
    return p.select("asset_id", "paint", color.portable_paint(F.col("paint")).alias("portable"))


def q_rect_path_text(spark, sf_dir):
    n = load(spark, sf_dir, "numbers")
    args = _m(F.col("x"), F.col("t"), F.col("v"), F.col("dc"))
    return n.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", geometry.rect_path_text(args).alias("d")
    )


def q_render_path_command(spark, sf_dir):
    c = load(spark, sf_dir, "commands")
    # center v,u; radii q+1 (arc), q+1,q+2 (ellipse); angles step with q
    args = F.when(
        F.col("kind") == "arc",
        _m(F.col("v"), F.col("u"), F.col("q") + 1.0, F.col("q"), F.col("q") * 2.0 - 3.0, F.col("q") % 2.0),
    ).otherwise(
        _m(F.col("v"), F.col("u"), F.col("q") + 1.0, F.col("q") + 2.0, F.col("q") * 0.25, F.lit(0.0), F.col("q") * 3.0, F.col("q") % 2.0)
    )
    args = F.slice(args, F.lit(1), F.col("n"))
    return c.select(
        "event_id", "kind", geometry.render_path_command(F.col("kind"), args, F.col("has_current")).alias("d")
    )


def q_close_for_fill(spark, sf_dir):
    p = fx.view(spark, sf_dir, "path_text")
    d = F.concat(F.col("d"), F.when(F.col("z") % 2 == 0, " M 1 1 L 2 2").otherwise(" M 3 3 Z M 4 4"))
    return p.select("shape_id", "z", "d", text.close_for_fill(d).alias("closed"))


def q_reduce_ratio(spark, sf_dir):
    j = fx.view(spark, sf_dir, "artboard_jobs")
    r = sizing.reduce_ratio(F.col("width"), F.col("height"), F.col("ratio"))
    return j.withColumn("r", r).select(
        "asset_id", F.col("r.rw").alias("rw"), F.col("r.rh").alias("rh"), F.col("r.name").alias("name")
    )


def q_artboard_size(spark, sf_dir):
    j = fx.view(spark, sf_dir, "artboard_jobs")
    return sizing.with_artboard(j).select("asset_id", "art_width", "art_height", "art_ratio")


def q_fit_transform(spark, sf_dir):
    j = sizing.with_artboard(fx.view(spark, sf_dir, "artboard_jobs"))
    bounds = F.when(
        F.col("asset_id") % 2 == 0,
        F.struct(
            F.lit(3.0).alias("min_x"), F.lit(-4.0).alias("min_y"),
            (F.col("width") / 2).alias("max_x"), (F.col("height") / 3).alias("max_y"),
        ),
    )
    fit = sizing.fit_transform(
        F.col("width"), F.col("height"), F.col("art_width"), F.col("art_height"), F.col("b"), (F.col("asset_id") % 8) / 2.0
    )
    return j.withColumn("b", bounds).withColumn("f", fit).select(
        "asset_id", *[F.round(f"f.{k}", 6).alias(k) for k in ("ox", "oy", "s")]
    )


def q_rect_covers_surface(spark, sf_dir):
    r = load(spark, sf_dir, "rects")
    args = _m(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    m = _m(F.col("a"), 0.0, 0.0, F.col("d"), F.col("e"), 0.0)
    return r.select(
        "asset_id",
        geometry.rect_covers_surface(args, m, F.lit(100.0), F.lit(50.0)).alias("covers"),
        geometry.rect_covers_surface(args, F.lit(None).cast("array<double>"), F.lit(40.0), F.lit(20.0)).alias("covers_plain"),
    )


def q_xml_escape(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    return p.select("page_id", text.xml_escape(F.concat("html", F.lit("'"), "url")).alias("escaped"))


def q_url_scheme_filter(spark, sf_dir):
    f = fx.view(spark, sf_dir, "feed_items")
    return text.url_scheme_filter(f).select("position", "link", "https_link", "target_url")


def q_visible_surface(spark, sf_dir):
    return rules.visible_surface(load(spark, sf_dir, "candidates")).select("page_id", "visible")


def q_recordable_vector(spark, sf_dir):
    return rules.recordable_vector(load(spark, sf_dir, "candidates")).select("page_id", "recordable")


def q_vector_size_name(spark, sf_dir):
    return rules.vector_size_name(load(spark, sf_dir, "candidates")).select("page_id", "width", "height", "filename")


def q_validate_settings(spark, sf_dir):
    j = fx.view(spark, sf_dir, "artboard_jobs")
    ratio = F.when(F.col("asset_id") % 2 == 0, "custom").otherwise(F.col("ratio"))
    low = F.col("min_pixels") - F.when(F.col("asset_id") % 17 == 0, 15_000_000.0).otherwise(0.0)
    return j.select(
        "asset_id",
        sizing.validate_settings(
            low, F.col("max_pixels"), ratio, F.col("width") - 16.0, F.col("height") / 4.0
        ).alias("reason"),
    )


def q_validate_vector_asset(spark, sf_dir):
    a = load(spark, sf_dir, "assets_raw").drop("svg_id").withColumnRenamed("long_id", "svg_id")
    return rules.validate_vector_asset(a).select("arrival", "reason")


def q_frame_prefix(spark, sf_dir):
    c = load(spark, sf_dir, "canvas_ids")
    return c.select("event_id", text.frame_prefix(F.col("canvas_id")).alias("prefix"))


def q_activation_window(spark, sf_dir):
    d = fx.view(spark, sf_dir, "device_log")
    end = text.activation_window(F.col("ts"), F.col("event_id") % 5 + 1)
    return d.select("event_id", F.unix_seconds(end).alias("expires_epoch"))


def q_normalize_email(spark, sf_dir):
    d = fx.view(spark, sf_dir, "device_log")
    raw = F.concat(F.lit("  User."), F.col("license_key").cast("string"), F.lit("@Example.COM\t"))
    return d.select("event_id", text.normalize_email(raw).alias("email"))


def q_load_export_settings(spark, sf_dir):
    s = readers.load_export_settings(load(spark, sf_dir, "partial_settings"))
    return s.select(
        "asset_id", "profile", "ratio", "min_pixels", "max_pixels", "background_color", "transparent_background",
        "artwork_scale", F.size("removed_colors").cast("bigint").alias("n_removed"),
    )


def q_sanitize_settings(spark, sf_dir):
    return sizing.sanitize_settings(load(spark, sf_dir, "stored"))


def q_safe_filename(spark, sf_dir):
    n = load(spark, sf_dir, "names")
    return n.select(
        "page_id",
        text.safe_filename(F.col("name"), "svg").alias("svg_name"),
        text.safe_filename(F.col("name"), "eps").alias("eps_name"),
        text.safe_filename(F.col("name"), "eps", chosen=True).alias("chosen_name"),
    )


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}

# ---------------------------------------------------------------- check SQL

_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_names_case = lambda i: " ".join(f"WHEN s = '{k}' THEN {v[i]}" for k, v in color.EXPORT_NAMES.items())


def _channel(i: int) -> str:
    h3 = f"({d_hex('h', i + 1)} * 17) / 255.0"
    h6 = f"({d_hex('h', 2 * i + 1)} * 16 + {d_hex('h', 2 * i + 2)}) / 255.0"
    part = f"trim(parts[{i + 1}])"
    return f"""CASE WHEN s IN ('', 'none', 'transparent') THEN NULL
 WHEN s LIKE '#%' THEN CASE WHEN length(h) IN (3, 4) THEN {h3} WHEN length(h) IN (6, 8) THEN {h6} END
 WHEN s LIKE 'rgb%' AND len(parts) >= 3 THEN least(greatest(CASE WHEN {part} LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(replace({part}, '%', '') AS DOUBLE) / 100.0 ELSE TRY_CAST({part} AS DOUBLE) / 255.0 END, 0.0), 1.0)
 {_names_case(i)} ELSE 0.0 END"""


_paint_steps = [
    ("p1", f"SELECT asset_id, paint, lower({d_strip('paint')}) AS s FROM paints"),
    ("p2", "SELECT *, substr(s, 2) AS h, string_split(regexp_replace(regexp_replace(s, '^rgba?\\(', ''), '\\)$', ''), ',') AS parts FROM p1"),
]


def _hexout(x: str) -> str:
    v = f"CAST(floor(least(greatest({x}, 0.0), 255.0) + 0.5) AS BIGINT)"
    return f"lpad(hex({v}), 2, '0')"


def _norm_channel(i: int) -> str:
    part = f"trim(parts[{i + 1}])"
    return _hexout(
        f"CASE WHEN {part} LIKE '%\\%' ESCAPE '\\' THEN TRY_CAST(replace({part}, '%', '') AS DOUBLE) * 255.0 / 100.0 ELSE TRY_CAST({part} AS DOUBLE) END"
    )


_ratio_steps = [
    (
        "rr",
        r"""SELECT *, greatest(round(greatest(width, 1.0)), 1.0)::BIGINT AS sw, greatest(round(greatest(height, 1.0)), 1.0)::BIGINT AS sh,
  ratio IN ('1:1','4:5','4:3','3:2','2:3','16:9') AS preset,
  regexp_matches(ratio, '^[0-9]+:[0-9]+$') AND TRY_CAST(split_part(ratio, ':', 1) AS BIGINT) BETWEEN 1 AND 10000
    AND TRY_CAST(split_part(ratio, ':', 2) AS BIGINT) BETWEEN 1 AND 10000 AS custom FROM artboard_jobs""",
    ),
    (
        "r2",
        "SELECT *, CASE WHEN custom THEN TRY_CAST(split_part(ratio, ':', 1) AS BIGINT) ELSE sw END AS w0, CASE WHEN custom THEN TRY_CAST(split_part(ratio, ':', 2) AS BIGINT) ELSE sh END AS h0 FROM rr",
    ),
    (
        "r3",
        "SELECT *, w0 // gcd(w0, h0) AS rw, h0 // gcd(w0, h0) AS rh, CASE WHEN preset THEN ratio WHEN custom THEN (w0 // gcd(w0, h0)) || ':' || (h0 // gcd(w0, h0)) ELSE 'source' END AS name FROM r2",
    ),
]
_art_steps = _ratio_steps + [
    (
        "b1",
        f"""SELECT *, CASE WHEN min_pixels > 0 THEN min_pixels ELSE 15000000.0 END AS lo FROM r3""",
    ),
    ("b2", "SELECT *, CASE WHEN max_pixels > lo THEN max_pixels ELSE greatest(65000000.0, lo) END AS hi FROM b1"),
    ("b3", "SELECT *, least(greatest(greatest(width, 1.0) * greatest(height, 1.0), lo), hi) AS target FROM b2"),
    ("b4", "SELECT *, greatest(sqrt(target / (rw * rh)::DOUBLE), 1.0) AS raw FROM b3"),
    ("b5", "SELECT *, floor(raw) AS m1, ceil(raw) AS m2, (rw * rh) * floor(raw) * floor(raw) AS a1, (rw * rh) * ceil(raw) * ceil(raw) AS a2 FROM b4"),
    (
        "b6",
        """SELECT *, CAST(CASE WHEN a1 BETWEEN lo AND hi AND NOT (a2 BETWEEN lo AND hi) THEN m1
  WHEN a2 BETWEEN lo AND hi AND NOT (a1 BETWEEN lo AND hi) THEN m2
  WHEN abs(a2 - target) < abs(a1 - target) THEN m2 ELSE m1 END AS BIGINT) AS m FROM b5""",
    ),
]


def _cmd_sql() -> str:
    f = d_fmt4
    x = lambda r1, r2, rot, ang: f"v + {r1} * cos({ang}) * cos({rot}) - {r2} * sin({ang}) * sin({rot})"
    y = lambda r1, r2, rot, ang: f"u + {r1} * cos({ang}) * sin({rot}) + {r2} * sin({ang}) * cos({rot})"
    pi = "pi()"
    arms = ""
    for kind, r1, r2, rot, a0, a1 in (
        ("arc", "(q + 1.0)", "(q + 1.0)", "0.0", "q", "(q * 2.0 - 3.0)"),
        ("ellipse", "(q + 1.0)", "(q + 2.0)", "(q * 0.25)", "0.0", "(q * 3.0)"),
    ):
        anti = "(q % 2.0 <> 0.0)"
        raw = f"({a1} - {a0})"
        delta = f"(CASE WHEN {anti} AND {raw} > 0 THEN {raw} - 2 * {pi} WHEN NOT {anti} AND {raw} < 0 THEN {raw} + 2 * {pi} ELSE {raw} END)"
        sweep = f"CASE WHEN {anti} THEN '0' ELSE '1' END"
        mid = f"({a0} + CASE WHEN {anti} THEN -{pi} ELSE {pi} END)"
        radii = f"'A ' || {f(r1)} || ' ' || {f(r2)} || ' ' || {f(f'degrees({rot})')}"
        pt = lambda ang: f"{f(x(r1, r2, rot, ang))} || ' ' || {f(y(r1, r2, rot, ang))}"  # noqa: E731, B023
        move = f"CASE WHEN has_current THEN '' ELSE 'M ' || {pt(a0)} || ' ' END"
        whole = f"{radii} || ' 1 ' || {sweep} || ' ' || {pt(mid)} || ' ' || {radii} || ' 1 ' || {sweep} || ' ' || {pt(a1)}"
        part = f"{radii} || ' ' || CASE WHEN abs({delta}) > {pi} THEN '1' ELSE '0' END || ' ' || {sweep} || ' ' || {pt(a1)}"
        arms += f" WHEN kind = '{kind}' THEN {move} || CASE WHEN abs({delta}) >= 2 * {pi} - 1e-7 THEN {whole} ELSE {part} END"
    vals = ["v", "u", "q + 1.0", "q + 2.0", "q * 0.25", "0.0"]
    row = lambda k: " || ' ' || ".join(f(e) for e in vals[:k])
    return f"""SELECT event_id, kind, CASE WHEN kind = 'line_to' AND n < 2 THEN NULL WHEN kind = 'move_to' THEN 'M ' || {row(2)} WHEN kind = 'line_to' THEN 'L ' || {row(2)}
 WHEN kind = 'bezier_curve_to' THEN 'C ' || {row(6)} WHEN kind = 'quadratic_curve_to' THEN 'Q ' || {row(4)} WHEN kind = 'close_path' THEN 'Z'
 WHEN kind = 'rect' THEN 'M ' || {f('v')} || ' ' || {f('u')} || ' h ' || {f('q + 1.0')} || ' v ' || {f('q + 2.0')} || ' h ' || {f('-(q + 1.0)')} || ' Z'
 {arms} WHEN kind = 'begin_path' THEN '' END AS d FROM commands"""


def _covers(m: tuple[str, str, str], w: str, h: str) -> str:
    a, d, e = m
    conds = []
    for px, py in (("0.0", "0.0"), (w, "0.0"), (w, h), ("0.0", h)):
        lx, ly = f"({px} - {e}) / nullif({a}, 0)", f"({py}) / nullif({d}, 0)"
        conds.append(
            f"{lx} BETWEEN least(x, x + w) - 1e-9 AND greatest(x, x + w) + 1e-9 AND {ly} BETWEEN least(y, y + h) - 1e-9 AND greatest(y, y + h) + 1e-9"
        )
    return "coalesce(" + " AND ".join(conds) + ", FALSE)"


def _safe(fmt: str, src: str) -> str:
    default = f"'vectorized-result.{fmt}'"
    base = rf"regexp_extract(regexp_replace({src}, '(/+\.?)+$', ''), '[^/]*$')"
    base = f"(CASE WHEN {base} IN ('', '.', '..') THEN {default} ELSE {base} END)"
    safe = rf"""regexp_replace({base}, '[\x00-\x1f\x7f<>:"/\\|?*]', '_', 'g')"""
    if fmt == "eps":
        safe = rf"regexp_replace({safe}, '\.svg$', '', 'i')"
    return f"CASE WHEN lower({safe}) LIKE '%.{fmt}' THEN {safe} ELSE {safe} || '.{fmt}' END"


_esc = "html || '''' || url"
for _raw, _rep in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
    _esc = f"replace({_esc}, '{_raw}', '{_rep}')"

_num = lambda c: f"TRY_CAST({d_strip(c)} AS DOUBLE)"
_pos = lambda c: f"CASE WHEN {_num(c)} <> 0 THEN {_num(c)} END"
_cust = r"(coalesce(ratio, 'source') = 'custom' OR regexp_matches(coalesce(ratio, 'source'), '^[0-9]+:[0-9]+$'))"
_side = lambda c, i: (
    f"CAST(least(greatest(floor(coalesce({_pos(c)}, CASE WHEN TRY_CAST(split_part(ratio, ':', {i}) AS DOUBLE) <> 0 THEN TRY_CAST(split_part(ratio, ':', {i}) AS DOUBLE) END, 1.0) + 0.5), 1), 10000) AS BIGINT)"
)
_last = d_strip(rf"regexp_extract({d_strip('filename')}, '[^\\/]*$')")
_fsafe = rf"""regexp_replace({_last}, '[\x00-\x1f<>:"/\\|?*]', '_', 'g')"""
_size = lambda attr, i, b: (
    f"greatest(coalesce({_pos(attr)}, CASE WHEN len(vb) = 4 AND TRY_CAST(vb[{i}] AS DOUBLE) <> 0 THEN TRY_CAST(vb[{i}] AS DOUBLE) END, CASE WHEN {b} <> 0 THEN {b} END, 1.0), 1.0)"
)

ORACLE = {
    "fmt4": on("numbers", f"SELECT {_KEYS}, {d_fmt4('v')} AS text FROM numbers"),
    "affine_apply": on(
        "numbers",
        f"SELECT {_KEYS}, round(dc * x - v + 100.0, 6) AS px, round(x + t * v + 200.0, 6) AS py FROM numbers",
    ),
    "matrix_text": on(
        "numbers",
        f"""SELECT {_KEYS}, CASE WHEN l_linenumber % 3 = 0 THEN 'matrix(1 0 0 1 0 0)' ELSE 'matrix(1 ' || {d_fmt4('dc')} || ' 0 1 ' || {d_fmt4('x')} || ' ' || {d_fmt4('v')} || ')' END AS text,
  l_linenumber % 3 = 0 OR (abs(dc) < 1e-6 AND abs(x) < 1e-6 AND abs(v) < 1e-6) AS identity, 1.0::DOUBLE AS det FROM numbers""",
    ),
    "parse_paint_rgb": on(
        "paints", f"SELECT asset_id, paint, round({_channel(0)}, 6) AS r, round({_channel(1)}, 6) AS g, round({_channel(2)}, 6) AS b FROM p2", _paint_steps
    ),
    "normalize_paint_hex": on(
        "paints",
        f"""SELECT asset_id, paint, CASE WHEN s LIKE '#%' THEN '#' || upper(CASE WHEN length(h) IN (3, 4) THEN substr(h,1,1)||substr(h,1,1)||substr(h,2,1)||substr(h,2,1)||substr(h,3,1)||substr(h,3,1) ELSE substr(h, 1, 6) END)
 WHEN s LIKE 'rgb%' THEN '#' || {_norm_channel(0)} || {_norm_channel(1)} || {_norm_channel(2)}
 WHEN s = 'white' THEN '#FFFFFF' WHEN s = 'green' THEN '#008000' WHEN s = 'rebeccapurple' THEN '#663399' END AS hex_color FROM p2""",
        _paint_steps,
    ),
    "portable_paint": on(
        "paints",
        f"SELECT asset_id, paint, {d_strip('paint')} <> '' AND strpos(paint, '[object Canvas') = 0 AND lower(paint) NOT LIKE '%url(%' AS portable FROM paints",
    ),
    "rect_path_text": on(
        "numbers",
        f"SELECT {_KEYS}, 'M ' || {d_fmt4('x')} || ' ' || {d_fmt4('t')} || ' h ' || {d_fmt4('v')} || ' v ' || {d_fmt4('dc')} || ' h ' || {d_fmt4('-v')} || ' Z' AS d FROM numbers",
    ),
    "render_path_command": on("commands", _cmd_sql()),
    "close_for_fill": check_sql(
        """SELECT shape_id, z, d, array_to_string(list_transform(string_split(x, ' M '), lambda p: CASE WHEN rtrim(p) LIKE '%Z' OR trim(p) = '' THEN p ELSE p || ' Z' END), ' M ') AS closed FROM e""",
        ["path_text"],
        [("e", "SELECT *, d || CASE WHEN z % 2 = 0 THEN ' M 1 1 L 2 2' ELSE ' M 3 3 Z M 4 4' END AS x FROM path_text")],
    ),
    "reduce_ratio": check_sql("SELECT asset_id, rw, rh, name FROM r3", ["artboard_jobs"], _ratio_steps),
    "artboard_size": check_sql(
        "SELECT asset_id, rw * m AS art_width, rh * m AS art_height, name AS art_ratio FROM b6", ["artboard_jobs"], _art_steps
    ),
    "fit_transform": check_sql(
        """SELECT asset_id, round(CASE WHEN asset_id % 2 = 0 THEN aw / 2.0 - (3.0 + width / 2) / 2.0 * s ELSE (aw - width * s) / 2.0 END, 6) AS ox,
  round(CASE WHEN asset_id % 2 = 0 THEN ah / 2.0 - (-4.0 + height / 3) / 2.0 * s ELSE (ah - height * s) / 2.0 END, 6) AS oy, round(s, 6) AS s FROM f2""",
        ["artboard_jobs"],
        _art_steps
        + [
            ("f1", "SELECT *, (rw * m)::DOUBLE AS aw, (rh * m)::DOUBLE AS ah FROM b6"),
            ("f2", "SELECT *, least(aw * 0.9::DOUBLE / width, ah * 0.9::DOUBLE / height) * least(greatest((asset_id % 8) / 2.0, 0.5), 3.0) AS s FROM f1"),
        ],
    ),
    "rect_covers_surface": on(
        "rects",
        f"SELECT asset_id, {_covers(('a', 'd', 'e'), '100.0', '50.0')} AS covers, {_covers(('1.0', '1.0', '0.0'), '40.0', '20.0')} AS covers_plain FROM rects",
    ),
    "xml_escape": f"SELECT page_id, {_esc} AS escaped FROM pages",
    "url_scheme_filter": check_sql(
        "SELECT position, link, CASE WHEN link LIKE 'https://%' THEN link END AS https_link, link AS target_url FROM feed_items", ["feed_items"]
    ),
    "visible_surface": on(
        "candidates",
        "SELECT page_id, NOT hidden AND box_w >= 1 AND box_h >= 1 AND display <> 'none' AND coalesce(visibility, '') NOT IN ('hidden', 'collapse') AND opacity <> 0 AS visible FROM candidates",
    ),
    "recordable_vector": on(
        "candidates",
        "SELECT page_id, NOT own_control AND shapes > 0 AND (dom_id = 'outputsvg' OR (dom_id <> '' AND shapes >= 8 AND box_w * box_h >= 1024)) AS recordable FROM candidates",
    ),
    "vector_size_name": on(
        "candidates",
        rf"""SELECT page_id, {_size('attr_width', 3, 'box_w')} AS width, {_size('attr_height', 4, 'box_h')} AS height,
  regexp_replace(coalesce(nullif(data_filename, ''), nullif(dom_id, ''), nullif(title, ''), 'captured-vector'), '\.[a-z0-9]+$', '', 'i') || '.svg' AS filename FROM c2""",
        [("c2", "SELECT *, string_split_regex(trim(coalesce(view_box, '')), '[ ,]+') AS vb FROM candidates")],
    ),
    "validate_settings": check_sql(
        """SELECT asset_id, CASE WHEN lo <= 0 THEN 'min_pixels' WHEN max_pixels <= 0 THEN 'max_pixels' WHEN max_pixels <= lo THEN 'pixel_range'
 WHEN asset_id % 2 <> 0 THEN NULL WHEN NOT (w = floor(w) AND w BETWEEN 1 AND 10000) THEN 'ratio_width' WHEN NOT (h = floor(h) AND h BETWEEN 1 AND 10000) THEN 'ratio_height' END AS reason FROM v""",
        ["artboard_jobs"],
        [("v", "SELECT *, min_pixels - CASE WHEN asset_id % 17 = 0 THEN 15000000.0 ELSE 0 END AS lo, width - 16.0 AS w, height / 4.0 AS h FROM artboard_jobs")],
    ),
    "validate_vector_asset": on(
        "assets_raw",
        r"""SELECT arrival, CASE WHEN NOT (strlen(long_id) BETWEEN 1 AND 256 AND strlen(filename) <= 255) THEN 'id'
 WHEN NOT (width > 0 AND height > 0) THEN 'dimensions' WHEN NOT (shapes <= 100000 AND strlen(markup) <= 2000000 AND ltrim(markup) LIKE '<svg%') THEN 'payload' END AS reason FROM assets_raw""",
    ),
    "frame_prefix": on(
        "canvas_ids",
        "SELECT event_id, CASE WHEN strpos(canvas_id, '-canvas-') > 0 THEN reverse(substr(reverse(canvas_id), strpos(reverse(canvas_id), '-savnac-') + 8)) END AS prefix FROM canvas_ids",
    ),
    "activation_window": "SELECT event_id, CAST(epoch(date_trunc('day', ts + INTERVAL 7 HOUR)) AS BIGINT) - 25200 + (event_id % 5 + 2) * 86400 AS expires_epoch FROM events",
    "normalize_email": "SELECT event_id, 'user.' || CAST(user_id AS VARCHAR) || '@example.com' AS email FROM events",
    "load_export_settings": on(
        "partial_settings",
        """SELECT asset_id, 'adobe-stock' AS profile, coalesce(ratio, 'source') AS ratio, coalesce(min_pixels, 15000000.0)::DOUBLE AS min_pixels, coalesce(max_pixels, 65000000.0)::DOUBLE AS max_pixels,
  coalesce(background_color, '#ffffff') AS background_color, coalesce(transparent_background, FALSE) AS transparent_background, coalesce(artwork_scale, 1.0)::DOUBLE AS artwork_scale, CAST(0 AS BIGINT) AS n_removed FROM partial_settings""",
    ),
    "sanitize_settings": on(
        "stored",
        rf"""SELECT asset_id, CASE WHEN {_cust} THEN {_side('custom_width', 1)} || ':' || {_side('custom_height', 2)} WHEN ratio IN ('source','1:1','4:5','4:3','3:2','2:3','16:9') THEN ratio ELSE 'source' END AS ratio,
  coalesce(CASE WHEN {_num('min_megapixels')} > 0 THEN {_num('min_megapixels')} * 1000000 END, 15000000.0)::DOUBLE AS min_pixels,
  coalesce(CASE WHEN {_num('max_megapixels')} > 0 THEN {_num('max_megapixels')} * 1000000 END, 65000000.0)::DOUBLE AS max_pixels,
  CASE WHEN regexp_matches(background_color, '^#[0-9a-fA-F]{{6}}$') THEN background_color ELSE '#ffffff' END AS background_color,
  coalesce(apply_background = 'false', FALSE) AS transparent_background,
  CASE WHEN {_num('artwork_scale')} IS NULL THEN 1.0::DOUBLE ELSE floor(least(greatest({_num('artwork_scale')}, 0.5), 3.0) * 100.0 + 0.5) / 100.0 END AS artwork_scale,
  CASE WHEN {_fsafe} IN ('', '.') THEN NULL WHEN lower({_fsafe}) LIKE '%.svg' THEN {_fsafe} ELSE {_fsafe} || '.svg' END AS filename FROM stored""",
    ),
    "safe_filename": on(
        "names",
        rf"""SELECT page_id, {_safe('svg', 'name')} AS svg_name, {_safe('eps', 'name')} AS eps_name, {_safe('eps', "(regexp_replace(name, '[.](svg|eps)$', '', 'i') || '.eps')")} AS chosen_name FROM names""",
    ),
}
