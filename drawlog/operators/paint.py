"""Jobs over the paint table: clears, removals, palettes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlog import schema as S
from drawlog.functions.color import normalize_paint_hex, parse_paint_rgb, portable_paint
from drawlog.functions.text import strip
from drawlog.operators.running import Run, running, seq_block
from drawlog.sources.staging import stage

EPOCH = [*S.SURFACE, "epoch"]
RGB_STEP = 0.002
NEAR = 48
REACHES = (2, 6, 16, NEAR)


def clear_over_paint(table: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Which partial clears lie over each paint.

    Clears of an epoch are numbered 1..total; those over a paint are always the
    last ones, so they are given as a range (first_clear .. clears) instead of
    one row per pair.
    """
    numbered = running(
        table,
        EPOCH,
        ["sequence"],
        seq_block("sequence", block_rows),
        {"clear_no": Run("sum", (F.col("kind") == "clear").cast("bigint"))},
    )
    totals = (
        table.where("kind = 'clear'").groupBy(*EPOCH).agg(F.count(F.lit(1)).alias("clears"))
    )
    out = numbered.join(totals, EPOCH, "left").withColumn("clears", F.coalesce("clears", F.lit(0)).cast("bigint"))
    later = F.col("clears") - F.col("clear_no")
    return out.withColumn("later_clears", later).withColumn(
        "first_clear", F.when(later > 0, F.col("clear_no") + 1)
    )


def element_id() -> Column:
    """``shape-n`` / ``gap-filler-n``; null for a clear."""
    name = F.when(F.col("kind") == "shape", "shape-").when(F.col("kind") == "stroke", "gap-filler-")
    return F.concat(name, F.col("kind_index").cast("string"))


def _listed(removals: DataFrame, keys: list[str]) -> DataFrame:
    """Removals to be joined: those of single drawings are as many as the drawings, never broadcast them."""
    return removals.hint("merge") if keys else removals


def drop_elements(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove paints by element id; ``ids`` has element_id and any of the canvas keys."""
    keys = [c for c in ids.columns if c in S.SURFACE]
    return (
        table.withColumn("element_id", element_id())
        .join(_listed(ids.select(*keys, "element_id").distinct(), keys), [*keys, "element_id"], "left_anti")
        .drop("element_id")
    )


def matching_paints(paints: DataFrame, colors: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, paint) that equal a chosen color by text or by RGB.

    RGB equality within 0.002 per channel becomes an equi-join on cells of that
    size (the chosen color goes into its 27 neighbour cells) with the exact
    test as residue.
    """
    channels = ("r", "g", "b")
    mine = paints.select(*keys, "paint").where("paint IS NOT NULL").distinct()
    theirs = colors.select(*keys, "color").distinct()
    text = lambda c: F.lower(strip(F.col(c)))
    by_text = (
        mine.withColumn("_t", text("paint"))
        .join(theirs.select(*keys, text("color").alias("_t")).distinct().hint("merge"), [*keys, "_t"], "left_semi")
        .select(*keys, "paint")
    )
    cell = lambda c: F.floor(F.col(c) / RGB_STEP)
    left = (
        mine.withColumn("_c", parse_paint_rgb(F.col("paint")))
        .where("_c IS NOT NULL")
        .select(*keys, "paint", *[F.col(f"_c.{c}").alias(c) for c in channels])
        .select("*", *[cell(c).alias(f"_{c}") for c in channels])
    )
    right = (
        theirs.withColumn("_c", parse_paint_rgb(F.col("color")))
        .where("_c IS NOT NULL")
        .select(*keys, *[F.col(f"_c.{c}").alias(f"o{c}") for c in channels])
        .distinct()
    )
    for c in channels:
        right = right.withColumn(f"_{c}", F.explode(F.array(*[cell(f"o{c}") + d for d in (-1, 0, 1)])))
    near = F.lit(True)
    for c in channels:
        near = near & (F.abs(F.col(c) - F.col(f"o{c}")) < RGB_STEP)
    # The copies of a color in 27 cells are not in the size the planner goes by: never broadcast them.
    by_rgb = left.join(right.hint("merge"), [*keys, *[f"_{c}" for c in channels]]).where(near).select(*keys, "paint")
    return by_text.unionByName(by_rgb).distinct()


def drop_colors(table: DataFrame, colors: DataFrame) -> DataFrame:
    """Remove paints of the chosen colors; ``colors`` has color and any of the table's keys."""
    keys = [c for c in colors.columns if c in table.columns and c not in ("color", "paint")]
    gone = matching_paints(table, colors, keys)
    return table.join(_listed(gone, keys), [*keys, "paint"], "left_anti")


def palette(table: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct normalized colors per asset.

    Paint texts are made distinct first, so colors are parsed once per text.
    """
    texts = table.where("paint IS NOT NULL").select(*keys, "paint").distinct()
    hexes = texts.select(*keys, normalize_paint_hex(F.col("paint")).alias("color")).where("color IS NOT NULL")
    return hexes.groupBy(*keys).agg(F.sort_array(F.collect_set("color")).alias("colors"))


def _channels(col: str) -> list[Column]:
    return [F.conv(F.substring(col, i, 2), 16, 10).cast("bigint") for i in (2, 4, 6)]


def nearest_color(palette_rows: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Closest palette color of every sample, kept within a squared distance of 2304.

    ``palette_rows``: keys, color.  ``samples``: keys, sample.  Nothing farther
    than 48 in any channel can match, so candidates come from an equi-join on
    cells of 48; both sides are distinct colors.  Smaller cells come first and a
    sample that has found its color there is done, so it meets its neighbours
    only, however dense the palette is.
    """
    names = ("r", "g", "b")
    pal = palette_rows.select(*keys, "color").distinct()
    pal = stage(pal.select(*keys, "color", *[c.alias(f"p{n}") for n, c in zip(names, _channels("color"))]), "palette")
    want = samples.select(*keys, "sample").distinct()
    want = stage(want.select(*keys, "sample", *[c.alias(f"s{n}") for n, c in zip(names, _channels("sample"))]), "samples")
    out = None
    for reach in REACHES:
        found = stage(_nearest_within(want, pal, keys, reach), "near")
        out = found if out is None else out.unionByName(found)
        want = want.join(found.select(*keys, "sample"), [*keys, "sample"], "left_anti")
    return out


def _nearest_within(want: DataFrame, pal: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The closest color of every sample that has one within ``reach``."""
    names = ("r", "g", "b")
    for n in names:
        pal = pal.withColumn(f"_{n}", F.explode(F.array(*[F.floor(F.col(f"p{n}") / reach) + d for d in (-1, 0, 1)])))
        want = want.withColumn(f"_{n}", F.floor(F.col(f"s{n}") / reach))
    distance = sum(
        ((F.col(f"p{n}") - F.col(f"s{n}")) * (F.col(f"p{n}") - F.col(f"s{n}")) for n in names), F.lit(0).cast("bigint")
    )
    # The copies of a color in 27 cells are not in the size the planner goes by: never broadcast them.
    pairs = want.join(pal.hint("merge"), [*keys, *[f"_{n}" for n in names]]).withColumn("distance", distance)
    return (
        pairs.where(F.col("distance") <= reach * reach)
        .groupBy(*keys, "sample")
        .agg(F.min(F.struct("distance", "color")).alias("_m"))
        .select(*keys, "sample", F.col("_m.color").alias("color"), F.col("_m.distance").alias("distance"))
    )


def stock_validation(table: DataFrame, errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per canvas: unsupported fills and strokes, has_strokes, valid.

    ``errors`` has one row per canvas (keys, errors); canvases without paints
    come out with zero counts.
    """
    keys = keys or S.SURFACE
    ok = portable_paint(F.col("paint"))
    width_ok = (F.col("line_width") > 0) & ~F.isnan("line_width") & (F.col("line_width") < F.lit(float("inf")))
    shape, stroke = F.col("kind") == "shape", F.col("kind") == "stroke"
    counts = table.groupBy(*keys).agg(
        F.count_if(shape).alias("shapes"),
        F.count_if(stroke).alias("strokes"),
        F.count_if(shape & ~ok).alias("unsupported_fills"),
        F.count_if(stroke & ~(ok & width_ok)).alias("unsupported_strokes"),
    )
    out = errors.join(counts, keys, "left")
    for c in ("shapes", "strokes", "unsupported_fills", "unsupported_strokes"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    return out.withColumn("has_strokes", F.col("strokes") > 0).withColumn(
        "valid",
        (F.col("shapes") > 0)
        & (F.col("errors") == 0)
        & (F.col("unsupported_fills") == 0)
        & (F.col("unsupported_strokes") == 0),
    )
