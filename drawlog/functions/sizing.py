"""Ratios, artboards, placement and settings rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlog.functions.text import override_filename, strip

# Preset ratios, limits and defaults of export settings.
PRESETS = {"1:1": (1, 1), "4:5": (4, 5), "4:3": (4, 3), "3:2": (3, 2), "2:3": (2, 3), "16:9": (16, 9)}
MAX_SIDE = 10_000
DEFAULT_MIN_PIXELS = 15_000_000.0
DEFAULT_MAX_PIXELS = 65_000_000.0
SAFE_AREA = 0.90
SCALE_LIMITS = (0.5, 3.0)


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def gcd(a: Column, b: Column) -> Column:
    """Euclid in 92 steps, enough for any two bigints (the worst are neighbouring Fibonacci numbers)."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(
        F.struct(acc["b"].alias("a"), F.try_mod(acc["a"], acc["b"]).alias("b"))
    )
    done = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda acc: acc["a"])
    return F.greatest(done, F.lit(1).cast("bigint"))


def reduce_ratio(w: Column, h: Column, ratio: Column) -> Column:
    """Struct rw, rh, name: preset, custom ``w:h`` or the rounded source size, reduced."""
    src_w = F.greatest(F.round(F.greatest(w, F.lit(1.0)), 0), F.lit(1.0)).cast("bigint")
    src_h = F.greatest(F.round(F.greatest(h, F.lit(1.0)), 0), F.lit(1.0)).cast("bigint")
    parts = F.split(ratio, ":")

    def side(i: int) -> Column:
        text = strip(F.get(parts, F.lit(i)))
        n = F.when(text.rlike(r"^\+?[0-9]{1,18}$"), text.try_cast("bigint"))
        return F.when((n >= 1) & (n <= MAX_SIDE), n)

    cw, ch = side(0), side(1)
    preset_w = F.create_map(*[F.lit(x) for k, (a, _) in PRESETS.items() for x in (k, a)])
    preset_h = F.create_map(*[F.lit(x) for k, (_, b) in PRESETS.items() for x in (k, b)])
    is_preset = ratio.isin(*PRESETS)
    is_custom = ~is_preset & (ratio != "source") & (F.size(parts) == 2) & cw.isNotNull() & ch.isNotNull()
    rw = F.when(is_preset, F.element_at(preset_w, ratio)).when(is_custom, cw).otherwise(src_w).cast("bigint")
    rh = F.when(is_preset, F.element_at(preset_h, ratio)).when(is_custom, ch).otherwise(src_h).cast("bigint")
    g = gcd(rw, rh)
    # Presets are already reduced, so one division serves all three cases.
    rw, rh = F.floor(rw / g), F.floor(rh / g)
    name = F.when(is_preset, ratio).when(is_custom, F.concat_ws(":", rw.cast("string"), rh.cast("string")))
    return F.struct(
        rw.cast("bigint").alias("rw"), rh.cast("bigint").alias("rh"), F.coalesce(name, F.lit("source")).alias("name")
    )


def with_artboard(
    df: DataFrame,
    w: str = "width",
    h: str = "height",
    ratio: str = "ratio",
    min_px: str = "min_pixels",
    max_px: str = "max_pixels",
) -> DataFrame:
    """Add art_width, art_height, art_ratio.

    Works step by step in columns so that the ratio is computed once per row.
    """
    return (
        df.withColumn("_r", reduce_ratio(F.col(w), F.col(h), F.col(ratio)))
        .withColumn("_a", artboard_size(F.col(w), F.col(h), F.col("_r"), F.col(min_px), F.col(max_px)))
        .withColumn("art_width", F.col("_a.w"))
        .withColumn("art_height", F.col("_a.h"))
        .withColumn("art_ratio", F.col("_a.name"))
        .drop("_r", "_a")
    )


def artboard_size(w: Column, h: Column, reduced: Column, min_px: Column, max_px: Column) -> Column:
    """Struct w, h, name of the artboard for a reduced ratio."""
    low = F.when(_finite(min_px) & (min_px > 0), min_px).otherwise(DEFAULT_MIN_PIXELS)
    high = F.when(_finite(max_px) & (max_px > low), max_px).otherwise(
        F.greatest(F.lit(DEFAULT_MAX_PIXELS), low)
    )
    one = F.lit(1.0)
    target = F.least(F.greatest(F.greatest(w, one) * F.greatest(h, one), low), high)
    rw, rh = reduced["rw"].cast("double"), reduced["rh"].cast("double")
    raw = F.greatest(F.sqrt(target / (rw * rh)), one)
    down, up = F.floor(raw).cast("double"), F.ceil(raw).cast("double")
    area = lambda m: rw * rh * m * m
    off = lambda m: F.abs(area(m) - target)
    fits = lambda m: (area(m) >= low) & (area(m) <= high)
    nearest = F.when(off(up) < off(down), up).otherwise(down)
    m = (
        F.when(fits(down) & fits(up), nearest)
        .when(fits(down), down)
        .when(fits(up), up)
        .otherwise(nearest)
        .cast("bigint")
    )
    return F.struct(
        (reduced["rw"] * m).alias("w"), (reduced["rh"] * m).alias("h"), reduced["name"].alias("name")
    )


def clamp_scale(scale: Column) -> Column:
    lo, hi = SCALE_LIMITS
    return F.when(_finite(scale), F.greatest(F.least(scale, F.lit(hi)), F.lit(lo))).otherwise(1.0)


def fit_transform(
    src_w: Column, src_h: Column, art_w: Column, art_h: Column, bounds: Column | None, scale: Column
) -> Column:
    """Struct ox, oy, s that puts the drawing into the safe area of the artboard.

    Centered on ``bounds`` (struct min_x, min_y, max_x, max_y) when given and
    not null, else on the source box.
    """
    w, h = F.greatest(src_w, F.lit(1.0)), F.greatest(src_h, F.lit(1.0))
    aw, ah = art_w.cast("double"), art_h.cast("double")
    s = F.least(aw * SAFE_AREA / w, ah * SAFE_AREA / h) * clamp_scale(scale)
    box_x, box_y = (aw - w * s) / 2.0, (ah - h * s) / 2.0
    if bounds is None:
        return F.struct(box_x.alias("ox"), box_y.alias("oy"), s.alias("s"))
    ox = aw / 2.0 - (bounds["min_x"] + bounds["max_x"]) / 2.0 * s
    oy = ah / 2.0 - (bounds["min_y"] + bounds["max_y"]) / 2.0 * s
    return F.struct(
        F.coalesce(ox, box_x).alias("ox"), F.coalesce(oy, box_y).alias("oy"), s.alias("s")
    )


def validate_settings(min_px: Column, max_px: Column, ratio: Column, w: Column, h: Column) -> Column:
    """Name of the first rule that fails, null when all hold."""
    side_ok = lambda v: _finite(v) & (v == F.floor(v)) & (v >= 1) & (v <= MAX_SIDE)
    return (
        F.when(~(_finite(min_px) & (min_px > 0)), "min_pixels")
        .when(~(_finite(max_px) & (max_px > 0)), "max_pixels")
        .when(max_px <= min_px, "pixel_range")
        .when(ratio != "custom", None)
        .when(~side_ok(w), "ratio_width")
        .when(~side_ok(h), "ratio_height")
    )


def sanitize_settings(df: DataFrame) -> DataFrame:
    """Stored user settings (all text columns) to valid export settings.

    Reads ratio, custom_width, custom_height, min_megapixels, max_megapixels,
    background_color, apply_background, artwork_scale and filename; adds the
    export columns and drops what it read.
    """
    number = lambda c: strip(F.col(c)).try_cast("double")
    truthy = lambda v: F.when(_finite(v) & (v != 0), v)
    ratio = F.coalesce("ratio", F.lit("source"))
    custom = (ratio == "custom") | ratio.rlike(r"^\d+:\d+$")
    parts = F.split(ratio, ":")

    def side(column: str, i: int) -> Column:
        given = F.coalesce(truthy(number(column)), truthy(F.get(parts, F.lit(i)).try_cast("double")), F.lit(1.0))
        return F.least(F.greatest(F.floor(given + 0.5), F.lit(1)), F.lit(MAX_SIDE)).cast("bigint")

    pixels = lambda c, default: F.coalesce(
        F.when(_finite(number(c)) & (number(c) > 0), number(c) * 1_000_000), F.lit(default)
    )
    lo, hi = SCALE_LIMITS
    scale = number("artwork_scale")
    clamped = F.floor(F.least(F.greatest(scale, F.lit(lo)), F.lit(hi)) * 100.0 + 0.5) / 100.0
    read = [
        "ratio", "custom_width", "custom_height", "min_megapixels", "max_megapixels",
        "background_color", "apply_background", "artwork_scale", "filename",
    ]
    return df.select(
        *[c for c in df.columns if c not in read],
        F.when(
            custom,
            F.concat_ws(":", side("custom_width", 0).cast("string"), side("custom_height", 1).cast("string")),
        )
        .when(ratio.isin("source", *PRESETS), ratio)
        .otherwise("source")
        .alias("ratio"),
        pixels("min_megapixels", DEFAULT_MIN_PIXELS).alias("min_pixels"),
        pixels("max_megapixels", DEFAULT_MAX_PIXELS).alias("max_pixels"),
        F.when(F.col("background_color").rlike("(?i)^#[0-9a-f]{6}$"), F.col("background_color"))
        .otherwise("#ffffff")
        .alias("background_color"),
        F.when(F.col("apply_background") == "false", True).otherwise(False).alias("transparent_background"),
        F.when(_finite(scale), clamped).otherwise(1.0).alias("artwork_scale"),
        override_filename(F.col("filename")).alias("filename"),
    )
