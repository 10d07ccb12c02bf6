"""Path text to segments, boxes and PostScript operators.

Only the reading of the path text is Python (the position of a command depends
on all commands before it in the same text); matrices, extrema, arcs and
aggregates are native expressions on the segment columns.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlog.functions.text import fmt4

_TOKEN = re.compile(r"[ \t\n\r\f,]+|([A-Za-z])|([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
# How many numbers follow each path letter.
_COUNTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def _tokens(d: str) -> list | None:
    out, pos = [], 0
    while pos < len(d):
        m = _TOKEN.match(d, pos)
        if m is None:
            return None
        pos = m.end()
        if m.group(1):
            out.append(m.group(1))
        elif m.group(2):
            out.append(float(m.group(2)))
    return out


def _segments(d: str | None) -> list[list[float]] | None:
    """Segments as number lists: letter code, start, two control points, end, arc data.

    None for text that cannot be read as a whole.
    """
    tokens = None if d is None else _tokens(d)
    if tokens is None:
        return None
    out: list[list[float]] = []
    at, n = 0, len(tokens)
    x = y = sx = sy = 0.0
    letter = None
    cubic = quad = None
    while at < n:
        if isinstance(tokens[at], str):
            letter = tokens[at]
            at += 1
        if letter is None or letter.upper() not in _COUNTS:
            return None
        kind = letter.upper()
        count = _COUNTS[kind]
        v = tokens[at : at + count]
        if len(v) < count or any(isinstance(t, str) for t in v):
            return None
        at += count
        ox, oy = (x, y) if letter.islower() else (0.0, 0.0)
        px, py, c1x, c1y, c2x, c2y, arc = x, y, None, None, None, None, [None] * 5
        next_cubic = next_quad = None
        if kind == "Z":
            x, y = sx, sy
            letter = None
        elif kind == "H":
            x = ox + v[0]
        elif kind == "V":
            y = oy + v[0]
        else:
            pts = v[5:] if kind == "A" else v
            pairs = [(ox + pts[i], oy + pts[i + 1]) for i in range(0, len(pts), 2)]
            x, y = pairs[-1]
            if kind == "M":
                sx, sy = x, y
                letter = "l" if letter == "m" else "L"
            elif kind == "C":
                (c1x, c1y), (c2x, c2y) = pairs[:2]
                next_cubic = pairs[1]
            elif kind == "S":
                c1x, c1y = (2 * px - cubic[0], 2 * py - cubic[1]) if cubic else (px, py)
                c2x, c2y = pairs[0]
                next_cubic = pairs[0]
            elif kind == "Q":
                c1x, c1y = pairs[0]
                next_quad = pairs[0]
            elif kind == "T":
                c1x, c1y = (2 * px - quad[0], 2 * py - quad[1]) if quad else (px, py)
                next_quad = (c1x, c1y)
            elif kind == "A":
                arc = [v[0], v[1], v[2], float(v[3] != 0.0), float(v[4] != 0.0)]
        cubic, quad = next_cubic, next_quad
        out.append([float(ord(kind)), px, py, c1x, c1y, c2x, c2y, x, y, *arc])
    return out


_NUMBER_LISTS = pa.list_(pa.list_(pa.float64()))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _read_paths(d: pa.Array) -> pa.Array:
    # One drawing repeats few texts; read each text of the batch once.
    coded = d.dictionary_encode()
    parsed = pa.array([_segments(t) for t in coded.dictionary.to_pylist()], _NUMBER_LISTS)
    return parsed.take(coded.indices)


NAMES = ["px", "py", "c1x", "c1y", "c2x", "c2y", "x", "y", "rx", "ry", "rot", "large", "sweep"]


def with_segments(df: DataFrame, d: str = "d") -> DataFrame:
    """Add ``segments``, one number list per absolute segment; null for malformed text."""
    return df.withColumn("segments", _read_paths(F.col(d)))


def starts_with_move(segments: Column) -> Column:
    """Of a read path: it is empty or begins with a move."""
    return (F.size(segments) == 0) | (F.get(F.get(segments, F.lit(0)), F.lit(0)) == float(ord("M")))


def explode_path_segments(df: DataFrame, d: str = "d") -> DataFrame:
    """One row per absolute segment: letter, start, controls, end, arc data, seg_no from 1.

    Relative commands are resolved and smooth control points reflected.  Rows
    with malformed text give nothing.
    """
    rows = with_segments(df, d).select(*df.columns, F.posexplode("segments").alias("_p", "_s"))
    return rows.select(
        *df.columns,
        (F.col("_p") + 1).cast("bigint").alias("seg_no"),
        F.chr(F.get("_s", F.lit(0)).cast("bigint")).alias("letter"),
        *[F.get("_s", F.lit(i + 1)).alias(n) for i, n in enumerate(NAMES)],
    )


def path_bounds(df: DataFrame, d: str = "d", transform: str = "transform") -> DataFrame:
    """Add ``bounds`` of the transformed path from end and given control points.

    Curves count with their control points, arcs with their end point only,
    reflected control points and closings not at all.  Null for malformed text
    or when no point is finite.
    """
    # Letter codes: A 65, C 67, Q 81, S 83, Z 90.
    points = """flatten(transform(segments, s -> CASE cast(s[0] AS INT)
        WHEN 90 THEN array()
        WHEN 67 THEN array(array(s[3], s[4]), array(s[5], s[6]), array(s[7], s[8]))
        WHEN 83 THEN array(array(s[5], s[6]), array(s[7], s[8]))
        WHEN 81 THEN array(array(s[3], s[4]), array(s[7], s[8]))
        ELSE array(array(s[7], s[8])) END))"""
    moved = "transform(_points, p -> array(_m[0] * p[0] + _m[2] * p[1] + _m[4], _m[1] * p[0] + _m[3] * p[1] + _m[5]))"
    finite = "filter(_moved, p -> abs(p[0]) < double('Infinity') AND abs(p[1]) < double('Infinity'))"
    pick = lambda fn, i: F.expr(f"{fn}(transform(_fine, p -> p[{i}]))")
    identity = F.expr("array(1D, 0D, 0D, 1D, 0D, 0D)")
    return (
        with_segments(df, d)
        .withColumn("_m", F.coalesce(F.col(transform), identity) if transform in df.columns else identity)
        .withColumn("_points", F.expr(points))
        .withColumn("_moved", F.expr(moved))
        .withColumn("_fine", F.expr(finite))
        .withColumn(
            "bounds",
            F.when(
                F.size("_fine") > 0,
                F.struct(
                    pick("array_min", 0).alias("min_x"),
                    pick("array_min", 1).alias("min_y"),
                    pick("array_max", 0).alias("max_x"),
                    pick("array_max", 1).alias("max_y"),
                ),
            ),
        )
        .drop("segments", "_m", "_points", "_moved", "_fine")
    )


def artwork_bounds(table: DataFrame, keys: list[str]) -> DataFrame:
    """Per drawing: union of the bounds of its shapes; without any, of its unclipped strokes."""
    b = path_bounds(
        table.where("kind = 'shape' OR (kind = 'stroke' AND clip_d IS NULL)").select(*keys, "kind", "d", "transform")
    )
    edges = {"min_x": F.min, "min_y": F.min, "max_x": F.max, "max_y": F.max}
    both = b.groupBy(*keys).agg(
        *[
            fn(F.when(F.col("kind") == k, F.col(f"bounds.{e}"))).alias(f"_{k}_{e}")
            for k in ("shape", "stroke")
            for e, fn in edges.items()
        ]
    )
    return both.select(*keys, *[F.coalesce(f"_shape_{e}", f"_stroke_{e}").alias(e) for e in edges])


def _apply(m: str, x: str, y: str) -> tuple[Column, Column]:
    return (
        F.expr(f"{m}[0] * {x} + {m}[2] * {y} + {m}[4]"),
        F.expr(f"{m}[1] * {x} + {m}[3] * {y} + {m}[5]"),
    )


def flatten_arcs(segments: DataFrame) -> DataFrame:
    """Curves as cubics: quadratics raised, arcs cut into pieces of at most 90 degrees.

    Radii too small for their end points are enlarged; an arc without a radius
    becomes one piece with its controls on start and end.  Adds piece_no; lines
    and closings pass through.
    """
    base = [c for c in segments.columns if c not in (*NAMES, "letter")]
    s = segments
    pi = math.pi
    arc = F.col("letter") == "A"
    s = s.withColumns(
        {
            "_arx": F.abs("rx"),
            "_ary": F.abs("ry"),
            "_cp": F.cos(F.radians("rot")),
            "_sp": F.sin(F.radians("rot")),
        }
    )
    s = s.withColumn("_flat", arc & ((F.col("_arx") < 1e-6) | (F.col("_ary") < 1e-6)))
    s = s.withColumn("_arc", arc & ~F.col("_flat"))
    s = s.withColumns(
        {
            "_ux": F.expr("CASE WHEN _arc THEN _cp * (px - x) / 2 + _sp * (py - y) / 2 END"),
            "_uy": F.expr("CASE WHEN _arc THEN -_sp * (px - x) / 2 + _cp * (py - y) / 2 END"),
        }
    )
    s = s.withColumn("_grow", F.expr("greatest(1D, sqrt((_ux * _ux) / (_arx * _arx) + (_uy * _uy) / (_ary * _ary)))"))
    s = s.withColumns({"_arx": F.expr("_arx * _grow"), "_ary": F.expr("_ary * _grow")})
    s = s.withColumns(
        {
            "_num": F.expr(
                "greatest(0D, _arx * _arx * _ary * _ary - _arx * _arx * _uy * _uy - _ary * _ary * _ux * _ux)"
            ),
            "_den": F.expr("_arx * _arx * _uy * _uy + _ary * _ary * _ux * _ux"),
        }
    )
    s = s.withColumn(
        "_q",
        F.expr("CASE WHEN _den > 1e-9 THEN sqrt(_num / _den) ELSE 0D END * CASE WHEN large = sweep THEN -1 ELSE 1 END"),
    )
    s = s.withColumns({"_kx": F.expr("_q * _arx * _uy / _ary"), "_ky": F.expr("-_q * _ary * _ux / _arx")})
    s = s.withColumns(
        {
            "_cx": F.expr("_cp * _kx - _sp * _ky + (px + x) / 2"),
            "_cy": F.expr("_sp * _kx + _cp * _ky + (py + y) / 2"),
            "_ax": F.expr("(_ux - _kx) / _arx"),
            "_ay": F.expr("(_uy - _ky) / _ary"),
            "_bx": F.expr("(-_ux - _kx) / _arx"),
            "_by": F.expr("(-_uy - _ky) / _ary"),
        }
    )
    s = s.withColumns(
        {
            "_t0": F.expr("CASE WHEN _ay < 0 THEN -1 ELSE 1 END * acos(greatest(-1D, least(1D, _ax)))"),
            "_turn": F.expr(
                "CASE WHEN _ax * _by - _ay * _bx < 0 THEN -1 ELSE 1 END * acos(greatest(-1D, least(1D, _ax * _bx + _ay * _by)))"
            ),
        }
    )
    s = s.withColumn(
        "_turn",
        F.expr(f"CASE WHEN sweep = 0 AND _turn > 0 THEN _turn - {2 * pi}D WHEN sweep <> 0 AND _turn < 0 THEN _turn + {2 * pi}D ELSE _turn END"),
    )
    s = s.withColumn("_n", F.expr(f"CASE WHEN _arc THEN greatest(1, CAST(ceil(abs(_turn) / {pi / 2}D) AS INT)) ELSE 1 END"))
    s = s.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    s = s.withColumn("_step", F.expr("_turn / _n"))
    s = s.withColumn("_a", F.expr("_t0 + _step * (piece_no - 1)"))
    s = s.withColumn("_k", F.expr("tan(_step / 4) * 4 / 3"))
    s = s.withColumns(
        {
            "_c1": F.expr("array(cos(_a) - _k * sin(_a), sin(_a) + _k * cos(_a))"),
            "_c2": F.expr("array(cos(_a + _step) + _k * sin(_a + _step), sin(_a + _step) - _k * cos(_a + _step))"),
            "_e": F.expr("array(cos(_a + _step), sin(_a + _step))"),
            "_s": F.expr("array(cos(_a), sin(_a))"),
        }
    )
    ring_x = lambda p: f"_cp * {p}[0] * _arx - _sp * {p}[1] * _ary + _cx"
    ring_y = lambda p: f"_sp * {p}[0] * _arx + _cp * {p}[1] * _ary + _cy"
    quad = "letter IN ('Q', 'T')"
    raise_ = lambda a, c: f"{a} + 2D / 3 * ({c} - {a})"

    def pick(on_arc: str, on_quad: str, on_flat: str, given: str) -> Column:
        return F.expr(f"CASE WHEN _arc THEN {on_arc} WHEN _flat THEN {on_flat} WHEN {quad} THEN {on_quad} ELSE {given} END")

    return s.select(
        *base,
        F.col("piece_no").cast("bigint").alias("piece_no"),
        F.expr(f"CASE WHEN letter IN ('A', 'S') OR {quad} THEN 'C' WHEN letter IN ('H', 'V') THEN 'L' ELSE letter END").alias("letter"),
        F.expr(f"CASE WHEN _arc AND piece_no > 1 THEN {ring_x('_s')} ELSE px END").alias("px"),
        F.expr(f"CASE WHEN _arc AND piece_no > 1 THEN {ring_y('_s')} ELSE py END").alias("py"),
        pick(ring_x("_c1"), raise_("px", "c1x"), "px", "c1x").alias("c1x"),
        pick(ring_y("_c1"), raise_("py", "c1y"), "py", "c1y").alias("c1y"),
        pick(ring_x("_c2"), raise_("x", "c1x"), "x", "c2x").alias("c2x"),
        pick(ring_y("_c2"), raise_("y", "c1y"), "y", "c2y").alias("c2y"),
        pick(ring_x("_e"), "x", "x", "x").alias("x"),
        pick(ring_y("_e"), "y", "y", "y").alias("y"),
    )


def _extreme(p0: str, p1: str, p2: str, p3: str) -> str:
    """Array of the curve values where its derivative is zero inside the piece."""
    a, b, c = f"({p3} - 3 * {p2} + 3 * {p1} - {p0})", f"(2 * ({p0} - 2 * {p1} + {p2}))", f"({p1} - {p0})"
    root = f"sqrt({b} * {b} - 4 * {a} * {c})"
    ts = f"array(CASE WHEN abs({a}) > 1e-12 THEN (-{b} + {root}) / (2 * {a}) WHEN abs({b}) > 1e-12 THEN -{c} / {b} END, CASE WHEN abs({a}) > 1e-12 THEN (-{b} - {root}) / (2 * {a}) END)"
    value = f"(1-t)*(1-t)*(1-t)*{p0} + 3*(1-t)*(1-t)*t*{p1} + 3*(1-t)*t*t*{p2} + t*t*t*{p3}"
    return f"transform(filter({ts}, t -> t > 0 AND t < 1), t -> {value})"


def tight_boxes(df: DataFrame, keys: list[str], d: str = "d", transform: str = "transform") -> DataFrame:
    """One row per key with the tight box of the transformed path and ``readable``.

    Curves count with their extrema; a move that draws nothing does not count.
    A path that does not start with a move is not readable here.
    ``keys`` must identify the rows.
    """
    ident = F.expr("array(1D, 0D, 0D, 1D, 0D, 0D)")
    rows = df.select(*keys, d, F.coalesce(F.col(transform), ident).alias("_m"))
    drawn = with_segments(rows, d).withColumn("segments", F.when(starts_with_move(F.col("segments")), F.col("segments")))
    read = drawn.select(*keys, "_m", F.col("segments").isNotNull().alias("readable"), "segments")
    exploded = read.select(*keys, "_m", "readable", F.posexplode_outer("segments").alias("_p", "_s")).select(
        *keys,
        "_m",
        "readable",
        F.coalesce(F.col("_p") + 1, F.lit(0)).cast("bigint").alias("seg_no"),
        F.chr(F.get("_s", F.lit(0)).cast("bigint")).alias("letter"),
        *[F.get("_s", F.lit(i + 1)).alias(n) for i, n in enumerate(NAMES)],
    )
    flat = flatten_arcs(exploded)
    for p in ("p", "c1", "c2", ""):
        nx, ny = _apply("_m", f"{p}x", f"{p}y")
        flat = flat.withColumns({f"_n{p}x": nx, f"_n{p}y": ny})
    draws = "letter IN ('L', 'C') OR (letter = 'Z' AND (px <> x OR py <> y))"
    ends = lambda axis: f"array(_np{axis}, _n{axis})"
    values = lambda axis: F.expr(
        f"CASE WHEN {draws} THEN concat({ends(axis)}, CASE WHEN letter = 'C' THEN {_extreme(f'_np{axis}', f'_nc1{axis}', f'_nc2{axis}', f'_n{axis}')} ELSE array() END) END"
    )
    boxed = flat.withColumns({"_vx": values("x"), "_vy": values("y")})
    return boxed.groupBy(*keys).agg(
        F.min("readable").alias("readable"),
        F.min(F.array_min("_vx")).alias("min_x"),
        F.min(F.array_min("_vy")).alias("min_y"),
        F.max(F.array_max("_vx")).alias("max_x"),
        F.max(F.array_max("_vy")).alias("max_y"),
    )


def document_size(table: DataFrame, keys: list[str], row: str = "kind_index") -> DataFrame:
    """Per drawing: ceiling of the largest tight x and y of its shapes.

    Null when a shape cannot be read or the size is not positive.
    """
    boxes = tight_boxes(table.where("kind = 'shape'"), [*keys, row])
    agg = boxes.groupBy(*keys).agg(
        F.min("readable").alias("_ok"),
        F.greatest(F.max("max_x"), F.lit(0.0)).alias("_x"),
        F.greatest(F.max("max_y"), F.lit(0.0)).alias("_y"),
    )
    inf = F.lit(float("inf"))
    good = F.col("_ok") & (F.col("_x") > 0) & (F.col("_y") > 0) & (F.col("_x") < inf) & (F.col("_y") < inf)
    return agg.select(
        *keys,
        F.when(good, F.ceil("_x").cast("double")).alias("doc_width"),
        F.when(good, F.ceil("_y").cast("double")).alias("doc_height"),
    )


def clear_mask_bounds(table: DataFrame, sizes: DataFrame, keys: list[str], row: str = "order_no") -> DataFrame:
    """Box of the mask of a partial clear: surface, shapes and widened strokes, plus 1 around.

    ``sizes``: keys, width, height.
    """
    paints = table.where("kind IN ('shape', 'stroke')")
    boxes = tight_boxes(paints, [*keys, row]).where("readable AND min_x IS NOT NULL")
    m = lambda i, j: f"hypot(transform[{i}], transform[{j}])"
    margins = paints.select(
        *keys,
        row,
        F.when(F.col("kind") == "stroke", F.expr(f"line_width * ({m(0, 1)} + {m(2, 3)}) * 4")).otherwise(0.0).alias("_g"),
    )
    grown = boxes.join(margins, [*keys, row]).groupBy(*keys).agg(
        F.min(F.col("min_x") - F.col("_g")).alias("_x0"),
        F.min(F.col("min_y") - F.col("_g")).alias("_y0"),
        F.max(F.col("max_x") + F.col("_g")).alias("_x1"),
        F.max(F.col("max_y") + F.col("_g")).alias("_y1"),
    )
    zero = F.lit(0.0)
    return sizes.join(grown, keys, "left").select(
        *keys,
        (F.least("_x0", zero) - 1).alias("mask_x0"),
        (F.least("_y0", zero) - 1).alias("mask_y0"),
        (F.greatest("_x1", F.col("width")) + 1).alias("mask_x1"),
        (F.greatest("_y1", F.col("height")) + 1).alias("mask_y1"),
    )


def postscript_line() -> Column:
    """PostScript operator of one flattened segment row."""
    xy = F.concat_ws(" ", fmt4(F.col("x")), fmt4(F.col("y")))
    return (
        F.when(F.col("letter") == "M", F.concat(xy, F.lit(" moveto\n")))
        .when(F.col("letter") == "L", F.concat(xy, F.lit(" lineto\n")))
        .when(
            F.col("letter") == "C",
            F.concat(
                F.concat_ws(" ", *[fmt4(F.col(c)) for c in ("c1x", "c1y", "c2x", "c2y")], xy), F.lit(" curveto\n")
            ),
        )
        .when(F.col("letter") == "Z", "closepath\n")
    )


def postscript_texts(df: DataFrame, d: str = "d", transform: str | None = None) -> DataFrame:
    """PostScript text per distinct path text (and matrix): columns d[, transform], ps.

    Each distinct path is converted once, however many paints use it.  Malformed
    text has no row; an empty path has the empty text.
    """
    keys = [d] + ([transform] if transform else [])
    distinct = df.select(*keys).where(F.col(d).isNotNull()).distinct()
    read = with_segments(distinct, d).where("segments IS NOT NULL")
    rows = read.select(*keys, F.posexplode_outer("segments").alias("_p", "_s")).select(
        *keys,
        F.coalesce(F.col("_p") + 1, F.lit(0)).cast("bigint").alias("seg_no"),
        F.chr(F.get("_s", F.lit(0)).cast("bigint")).alias("letter"),
        *[F.get("_s", F.lit(i + 1)).alias(n) for i, n in enumerate(NAMES)],
    )
    flat = flatten_arcs(rows)
    if transform:
        for p in ("c1", "c2", ""):
            nx, ny = _apply(transform, f"{p}x", f"{p}y")
            flat = flat.withColumns({f"_n{p}x": nx, f"_n{p}y": ny})
        flat = flat.select(
            *keys, "seg_no", "piece_no", "letter",
            *[F.col(f"_n{p}{a}").alias(f"{p}{a}") for p in ("c1", "c2", "") for a in "xy"],
        )
    lines = flat.select(*keys, "seg_no", "piece_no", postscript_line().alias("_line"))
    return lines.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seg_no", "piece_no", "_line"))),
                lambda r: F.coalesce(r["_line"], F.lit("")),
            ),
            "",
        ).alias("ps")
    )
