"""Matrices, rectangles and single path commands as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawlog.functions.text import fmt4, let

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def matrix(m: Column) -> Column:
    """A six-number matrix; null means identity."""
    return F.coalesce(m, F.array(*[F.lit(v) for v in IDENTITY]))


def _at(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def affine_apply(m: Column, x: Column, y: Column) -> Column:
    """Transformed point, or null when it is not finite."""
    m = matrix(m)
    px = _at(m, 0) * x + _at(m, 2) * y + _at(m, 4)
    py = _at(m, 1) * x + _at(m, 3) * y + _at(m, 5)
    fine = lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(fine(px) & fine(py), F.struct(px.alias("x"), py.alias("y")))


def matrix_text(m: Column) -> Column:
    m = matrix(m)
    return F.concat(F.lit("matrix("), F.concat_ws(" ", *[fmt4(_at(m, i)) for i in range(6)]), F.lit(")"))


def is_identity(m: Column) -> Column:
    m = matrix(m)
    out = F.lit(True)
    for i, v in enumerate(IDENTITY):
        out = out & (F.abs(_at(m, i) - v) < 1e-6)
    return out


def determinant(m: Column) -> Column:
    m = matrix(m)
    return _at(m, 0) * _at(m, 3) - _at(m, 1) * _at(m, 2)


def rect_text(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat_ws(
        " ",
        F.lit("M"),
        fmt4(x),
        fmt4(y),
        F.lit("h"),
        fmt4(w),
        F.lit("v"),
        fmt4(h),
        F.lit("h"),
        fmt4(-w),
        F.lit("Z"),
    )


def rect_path_text(args: Column) -> Column:
    """``M x y h w v h h -w Z``; null with fewer than four numbers."""
    a = [_at(args, i) for i in range(4)]
    return F.when(F.size(args) >= 4, rect_text(*a))


def rect_covers_surface(args: Column, m: Column, w: Column, h: Column) -> Column:
    """Does the transformed rectangle contain the whole surface?"""
    m = matrix(m)
    a, b, c, d, e, f = (_at(m, i) for i in range(6))
    det = a * d - b * c
    safe = F.when(det != 0.0, det)
    x, y, rw, rh = (_at(args, i) for i in range(4))
    lo_x, hi_x = F.least(x, x + rw) - 1e-9, F.greatest(x, x + rw) + 1e-9
    lo_y, hi_y = F.least(y, y + rh) - 1e-9, F.greatest(y, y + rh) + 1e-9
    inside = F.lit(True)
    zero = F.lit(0.0)
    for px, py in ((zero, zero), (w, zero), (w, h), (zero, h)):
        lx = (d * (px - e) - c * (py - f)) / safe
        ly = (-b * (px - e) + a * (py - f)) / safe
        inside = inside & (lx >= lo_x) & (lx <= hi_x) & (ly >= lo_y) & (ly <= hi_y)
    return F.coalesce(inside, F.lit(False))


def _ring(args: Column, ellipse: Column) -> Column:
    """Center, radii, rotation and angles of an arc (5-6 numbers) or ellipse (7-8)."""
    at = lambda arc, oval: F.when(ellipse, _at(args, oval)).otherwise(_at(args, arc))
    return F.struct(
        _at(args, 0).alias("cx"),
        _at(args, 1).alias("cy"),
        _at(args, 2).alias("rx"),
        at(2, 3).alias("ry"),
        F.when(ellipse, _at(args, 4)).otherwise(0.0).alias("rot"),
        at(3, 5).alias("start"),
        at(4, 6).alias("end"),
        (F.coalesce(at(5, 7), F.lit(0.0)) != 0.0).alias("anti"),
    )


def _on_ring(p: Column, angle: Column) -> list[Column]:
    ca, sa, cr, sr = F.cos(angle), F.sin(angle), F.cos(p["rot"]), F.sin(p["rot"])
    return [
        fmt4(p["cx"] + p["rx"] * ca * cr - p["ry"] * sa * sr),
        fmt4(p["cy"] + p["rx"] * ca * sr + p["ry"] * sa * cr),
    ]


def _arc_text(p: Column) -> Column:
    tau = 2 * math.pi
    turn = p["end"] - p["start"]
    delta = F.abs(
        F.when(p["anti"] & (turn > 0), turn - tau).when(~p["anti"] & (turn < 0), turn + tau).otherwise(turn)
    )
    sweep = F.when(p["anti"], "0").otherwise("1")
    radii = [F.lit("A"), fmt4(p["rx"]), fmt4(p["ry"]), fmt4(F.degrees(p["rot"]))]
    middle = _on_ring(p, p["start"] + F.when(p["anti"], -math.pi).otherwise(math.pi))
    last = _on_ring(p, p["end"])
    large = F.when(delta > math.pi, "1").otherwise("0")
    half = F.when(delta >= tau - 1e-7, F.concat_ws(" ", *radii, F.lit("1"), sweep, *middle))
    flag = F.when(delta >= tau - 1e-7, "1").otherwise(large)
    return F.concat_ws(" ", half, *radii, flag, sweep, *last)


def _is_arc(kind: Column, args: Column) -> tuple[Column, Column]:
    n = F.coalesce(F.size(args), F.lit(0))
    ellipse = kind == "ellipse"
    return ((kind == "arc") & (n >= 5)) | (ellipse & (n >= 7)), ellipse


def arc_lead(kind: Column, args: Column) -> Column:
    """The ``M`` an arc starts with when the path has no current point; else null."""
    arc, ellipse = _is_arc(kind, args)
    start = lambda p: F.concat_ws(" ", F.lit("M"), *_on_ring(p, p["start"]))
    return F.when(arc, let(_ring(args, ellipse), start))


def command_text(kind: Column, args: Column) -> Column:
    """One path command as text for a path that has a current point.

    Null when unknown or short of arguments; ``begin_path`` gives the empty text.
    """
    n = F.coalesce(F.size(args), F.lit(0))
    numbers = lambda k: F.array_join(F.transform(F.slice(args, 1, k), fmt4), " ")
    # Letter and number count of the plain commands.
    plain = {"move_to": ("M", 2), "line_to": ("L", 2), "bezier_curve_to": ("C", 6), "quadratic_curve_to": ("Q", 4)}
    letters = F.create_map(*[F.lit(x) for k, (letter, _) in plain.items() for x in (k, letter)])
    counts = F.create_map(*[F.lit(x) for k, (_, count) in plain.items() for x in (k, count)])
    arc, ellipse = _is_arc(kind, args)
    return (
        F.when(
            n >= F.element_at(counts, kind),
            F.concat_ws(" ", F.element_at(letters, kind), numbers(F.element_at(counts, kind))),
        )
        .when(kind == "close_path", "Z")
        .when((kind == "rect") & (n >= 4), rect_path_text(args))
        .when(arc, let(_ring(args, ellipse), _arc_text))
        .when(kind == "begin_path", "")
    )


def render_path_command(kind: Column, args: Column, has_current: Column) -> Column:
    """``command_text``, with the leading ``M`` of an arc where there is no current point."""
    lead = F.when(~has_current, arc_lead(kind, args))
    text = command_text(kind, args)
    return F.when(lead.isNotNull(), F.concat_ws(" ", lead, text)).otherwise(text)
