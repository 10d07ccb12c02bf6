"""Which page elements are recorded, and under which size and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlog import schema as S
from drawlog.functions.text import strip


def visible_surface(df: DataFrame) -> DataFrame:
    """Adds ``visible`` from hidden, box_w, box_h, display, visibility, opacity."""
    shown = (
        ~F.coalesce("hidden", F.lit(False))
        & (F.coalesce("box_w", F.lit(0.0)) >= 1)
        & (F.coalesce("box_h", F.lit(0.0)) >= 1)
        & (F.coalesce("display", F.lit("")) != "none")
        & ~F.coalesce("visibility", F.lit("")).isin("hidden", "collapse")
        & (F.coalesce("opacity", F.lit(1.0)) != 0)
    )
    return df.withColumn("visible", shown)


def recordable_vector(df: DataFrame) -> DataFrame:
    """Adds ``recordable`` from dom_id, shapes, box_w, box_h and own_control."""
    own = F.coalesce("own_control", F.lit(False)) if "own_control" in df.columns else F.lit(False)
    dom_id = F.coalesce("dom_id", F.lit(""))
    big = (dom_id != "") & (F.col("shapes") >= 8) & (F.col("box_w") * F.col("box_h") >= 1024)
    return df.withColumn(
        "recordable", ~own & (F.col("shapes") > 0) & ((dom_id == "outputsvg") | F.coalesce(big, F.lit(False)))
    )


def vector_size_name(df: DataFrame) -> DataFrame:
    """Adds width, height and filename of a captured vector element.

    Reads attr_width, attr_height, view_box, box_w, box_h, data_filename,
    dom_id and title; a size that is missing, zero or not a number falls
    through to the next source.
    """
    some = lambda v: F.when(v.isNotNull() & (v != 0) & ~F.isnan(v), v)
    number = lambda c: some(strip(F.col(c)).try_cast("double"))
    box = F.split(strip(F.coalesce("view_box", F.lit(""))), "[ ,]+")
    view = lambda i: F.when(F.size(box) == 4, some(F.get(box, F.lit(i)).try_cast("double")))
    size = lambda attr, i, b: F.greatest(
        F.coalesce(number(attr), view(i), some(F.col(b)), F.lit(1.0)), F.lit(1.0)
    )
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    name = F.coalesce(text("data_filename"), text("dom_id"), text("title"), F.lit("captured-vector"))
    return df.select(
        "*",
        size("attr_width", 2, "box_w").alias("width"),
        size("attr_height", 3, "box_h").alias("height"),
        F.concat(F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", ""), F.lit(".svg")).alias("filename"),
    )


def validate_vector_asset(df: DataFrame) -> DataFrame:
    """Adds ``reason``: id, dimensions, payload, or null for a valid asset."""
    size_ok = lambda c: (
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) & (F.col(c) > 0)
    )
    id_ok = (F.octet_length("svg_id") >= 1) & (F.octet_length("svg_id") <= 256) & (F.octet_length("filename") <= 255)
    payload_ok = (
        (F.col("shapes") <= S.MAX_ASSET_SHAPES)
        & (F.octet_length("markup") <= S.MAX_MARKUP_BYTES)
        & F.col("markup").rlike(r"^\s*<svg")
    )
    no = F.lit(False)
    return df.withColumn(
        "reason",
        F.when(~F.coalesce(id_ok, no), "id")
        .when(~F.coalesce(size_ok("width") & size_ok("height"), no), "dimensions")
        .when(~F.coalesce(payload_ok, no), "payload"),
    )
