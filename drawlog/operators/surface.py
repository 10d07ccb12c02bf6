"""Canvas state: size, stack, clips, resets, paints, errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlog import schema as S
from drawlog.functions.geometry import determinant, rect_covers_surface, rect_path_text
from drawlog.functions.text import close_for_fill
from drawlog.operators.ingest import joined_frames, with_defaults
from drawlog.operators.paths import epoch_texts, path_state, snapshot
from drawlog.operators.running import Run, log_block, row_numbers, running, seq_block
from drawlog.sources.staging import stage

# Tables with a row per canvas, level or path are joined by merge: written logs
# are small on disk, the planner would broadcast them through the driver.

_RESET_STEP = -(2**32)


def live_rows(log: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Rows that reach an existing canvas: from its first creation on.

    ``source``: the log that ``log`` was made of, where that is cheaper to read again.
    """
    rows = with_defaults(log).where(F.col("type") != "session_end")
    born = (
        with_defaults(log if source is None else source).where(F.col("type") == "canvas_created")
        .groupBy(*S.SURFACE)
        .agg(F.min("sequence").alias("_born"))
    )
    return rows.join(born.hint("merge"), S.SURFACE).where(F.col("sequence") >= F.col("_born"))


def _size_runs() -> dict[str, Run]:
    def side(name: str) -> Column:
        # greatest() skips nulls, and an event without a size must stay without one.
        given = F.when(F.col(name).isNotNull(), F.greatest(F.col(name), F.lit(1.0)))
        return F.when(F.col("sequence") == F.col("_born"), F.coalesce(given, F.lit(1.0))).otherwise(given)

    return {"now_width": Run("last", side("width")), "now_height": Run("last", side("height"))}


def _stack_runs() -> dict[str, Run]:
    kind = F.col("type")
    # A resize empties the stack: a step deeper than any stack can be.
    step = (
        F.when(kind == "save", 1).when(kind == "restore", -1).when(kind == "canvas_resized", _RESET_STEP).otherwise(0)
    )
    return {
        "depth": Run("depth", step.cast("bigint")),
        "resizes": Run("sum", (kind == "canvas_resized").cast("bigint")),
    }


def stack_depth(log: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Depth of the save stack after every canvas event, and resizes so far."""
    return running(
        live_rows(log), S.SURFACE, ["sequence"], seq_block("sequence", block_rows), _stack_runs()
    ).drop("_born")


def _nearest_clip(nodes: DataFrame) -> DataFrame:
    """For every opened stack level, the clip it inherits from the levels below.

    ``nodes``: SURFACE, resizes, node, up, clip.  Pointers are doubled, so the
    number of rounds is the logarithm of the deepest nesting.
    """
    key = [*S.SURFACE, "resizes"]
    nodes = stage(nodes, "levels")
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    nodes = nodes.drop("level")
    for round_no in range(max(0, math.ceil(math.log2(deepest + 1))) if deepest > 1 else 0):
        parents = nodes.select(
            *key, F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("clip").alias("_clip2")
        )
        open_ended = F.col("clip").isNull() & F.col("up").isNotNull()
        nodes = nodes.join(parents.hint("merge"), [*key, "up"], "left").select(
            *key,
            "node",
            F.when(open_ended, F.col("_up2")).otherwise(F.col("up")).alias("up"),
            F.coalesce("clip", "_clip2").alias("clip"),
        )
        if round_no % 3 == 2:
            nodes = stage(nodes, "levels")
    return nodes.select(*key, F.col("node").alias("_opened"), F.col("clip").alias("_inherited"))


def clip_in_force(rows: DataFrame, block: Column | None) -> DataFrame:
    """Add clip_seq (row that set the clip, null = none) to rows with depth and resizes.

    A clip belongs to the stack level it was set in and ends when that level is
    popped.  Per (canvas, resize, level) one running pass finds the save that
    opened the level and the last clip set in it; a level without a clip of its
    own inherits along the tree of saves.
    """
    key = [*S.SURFACE, "resizes"]
    kind, seq = F.col("type"), F.col("sequence")
    sets = (kind == "clip") & F.col("path_id").isNotNull()
    # Clip rows are numbered so that an odd code is a real clip, an even one "none".
    code = F.when(sets, seq * 2 + F.col("p_known").cast("bigint"))
    # A save is a row of its own level and a probe of the one below.
    once, twice = F.array(F.lit(False)), F.array(F.lit(False), F.lit(True))
    probed = rows.withColumn("_probe", F.explode(F.when(kind == "save", twice).otherwise(once)))
    levels = stage(
        running(
            probed.withColumn("_level", F.col("depth") - F.col("_probe").cast("bigint")),
            [*key, "_level"],
            ["sequence", "_probe"],
            block,
            {
                "_opened": Run("max", F.when((kind == "save") & ~F.col("_probe"), seq)),
                "_own": Run("max", code),
            },
        ).withColumn("_own", F.when(F.floor(F.col("_own") / 2) > F.coalesce("_opened", F.lit(0)), F.col("_own"))),
        "clips",
    )
    nodes = levels.where("_probe").select(
        *key,
        F.col("sequence").alias("node"),
        F.col("_opened").alias("up"),
        F.col("_own").alias("clip"),
        F.col("depth").alias("level"),
    )
    inherited = _nearest_clip(nodes).where("_inherited IS NOT NULL")
    rows = levels.where("NOT _probe")
    inherits = "_own IS NULL AND _opened IS NOT NULL"
    out = rows.where(inherits).join(inherited.hint("merge"), [*key, "_opened"], "left")
    out = out.unionByName(rows.where(f"NOT ({inherits})").withColumn("_inherited", F.lit(None).cast("bigint")))
    found = F.coalesce("_own", "_inherited")
    return out.withColumn("clip_seq", F.when(found % 2 == 1, F.floor(found / 2))).drop(
        "_level", "_probe", "_opened", "_own", "_inherited"
    )


def _clear_parts() -> tuple[Column, Column]:
    """Conditions: the row is a clear with area; it covers the whole canvas."""
    args = F.col("args")
    area = (
        (F.col("type") == "clear_rect")
        & (F.size(args) >= 4)
        & (F.get(args, F.lit(2)) != 0)
        & (F.get(args, F.lit(3)) != 0)
        & (determinant(F.col("transform")) != 0)
    )
    full = (
        area
        & F.col("clip_seq").isNull()
        & rect_covers_surface(args, F.col("transform"), F.col("now_width"), F.col("now_height"))
    )
    return F.coalesce(area, F.lit(False)), F.coalesce(full, F.lit(False))


def surface_log(
    log: DataFrame, resolved: DataFrame | None = None, block_rows: int | None = None, written: bool = True
) -> DataFrame:
    """Every canvas event with the state after it, as a written table.

    Not ``written``, for a single reader: a plan where the log lies in one
    block, whose passes follow each other without being written between.
    Adds now_width, now_height, depth, resizes, clip_seq, epoch (resets so far),
    is_reset, is_clear (partial clear), p_known, p_epoch, p_filled.
    """
    block = log_block(log, block_rows)
    between = stage if block is not None else lambda df, name: df
    known = between(live_rows(path_state(log, resolved, block_rows), log), "paths")
    sized = between(
        running(known, S.SURFACE, ["sequence"], block, {**_size_runs(), **_stack_runs()}).drop("_born"), "sized"
    )
    clipped = clip_in_force(sized, block)
    area, full = _clear_parts()
    marked = clipped.withColumn("is_reset", (F.col("type") == "canvas_resized") | full).withColumn(
        "is_clear", area & ~full
    )
    epochs = running(marked, S.SURFACE, ["sequence"], block, {"epoch": Run("sum", F.col("is_reset").cast("bigint"))})
    out = stage(epochs, "surface") if written else between(epochs, "surface")
    out._drawlog_blocks = log._drawlog_blocks
    return out


def paint_epochs(surface: DataFrame) -> DataFrame:
    return surface.select(*S.SURFACE, "sequence", "type", "is_reset", "epoch")


def active_clip(surface: DataFrame) -> DataFrame:
    return surface.select(*S.SURFACE, "sequence", "type", "depth", "clip_seq")


def counted(surface: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Add shape_no and stroke_no: paints of each kind so far in the epoch, and what the row is.

    is_shape / is_stroke are paints before the cap; is_fault is an error of
    that kind.
    """
    kind = F.col("type")
    rect_ok = F.coalesce(F.size("args") >= 4, F.lit(False))
    shape = ((kind == "fill_rect") & rect_ok) | ((kind == "fill") & F.col("p_filled"))
    stroke = ((kind == "stroke_rect") & rect_ok) | ((kind == "stroke") & F.col("p_filled"))
    rows = surface.withColumn("is_shape", shape).withColumn("is_stroke", stroke)
    return running(
        rows,
        [*S.SURFACE, "epoch"],
        ["sequence"],
        log_block(surface, block_rows),
        {
            "shape_no": Run("sum", F.col("is_shape").cast("bigint")),
            "stroke_no": Run("sum", F.col("is_stroke").cast("bigint")),
        },
    )


def error_rows(numbered: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows that count as an error of their epoch.

    With a cap, a bad fill or stroke counts only while its kind is below it.
    """
    kind = F.col("type")
    rect_bad = ~F.coalesce(F.size("args") >= 4, F.lit(False))
    unknown = ~F.col("p_known")
    below = lambda no: F.lit(True) if cap is None else F.col(no) < cap
    bad_shape = ((kind == "fill") & unknown) | ((kind == "fill_rect") & rect_bad)
    bad_stroke = ((kind == "stroke") & unknown) | ((kind == "stroke_rect") & rect_bad)
    return numbered.where(
        (bad_shape & below("shape_no"))
        | (bad_stroke & below("stroke_no"))
        | ((kind == "clip") & F.col("path_id").isNull())
    )


def last_epochs(surface: DataFrame) -> DataFrame:
    return surface.groupBy(*S.SURFACE).agg(F.max("epoch").alias("epoch"))


def error_count(numbered: DataFrame, cap: int | None = None) -> DataFrame:
    """Errors of every canvas since its last reset, from the :func:`counted` table."""
    bad = error_rows(numbered, cap).groupBy(*S.SURFACE, "epoch").agg(F.count(F.lit(1)).alias("errors"))
    return (
        last_epochs(numbered)
        .join(bad.hint("merge"), [*S.SURFACE, "epoch"], "left")
        .select(*S.SURFACE, F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"))
    )


def shape_cap(numbered: DataFrame, n: int | None = S.MAX_PAINTS) -> DataFrame:
    """Paints within the cap of their kind (all for None), and partial clears of a non-empty canvas."""
    within = lambda no: F.lit(True) if n is None else F.col(no) <= n
    keep = (
        (F.col("is_shape") & within("shape_no"))
        | (F.col("is_stroke") & within("stroke_no"))
        | (F.col("is_clear") & (F.col("shape_no") + F.col("stroke_no") > 0))
    )
    return numbered.where(keep)


def _kinds(rows: DataFrame) -> DataFrame:
    kind = F.expr("CASE WHEN is_shape THEN 'shape' WHEN is_stroke THEN 'stroke' ELSE 'clear' END")
    index = F.expr("CASE WHEN is_shape THEN shape_no WHEN is_stroke THEN stroke_no END")
    return rows.withColumns({"kind": kind, "kind_index": index})


def paint_order(surface: DataFrame, cap: int | None = None, block_rows: int | None = None) -> DataFrame:
    """The paint table: kind, index within its kind, order number within the epoch."""
    kept = shape_cap(counted(surface, block_rows), cap)
    return _kinds(
        row_numbers(kept, [*S.SURFACE, "epoch"], ["sequence"], seq_block("sequence", block_rows), "order_no")
    )


def current_paints(numbered: DataFrame, cap: int | None = None) -> DataFrame:
    """Paints of the epoch after the last reset, from the :func:`counted` table.

    order_no is the sequence here: it orders the paints without another pass.
    """
    table = shape_cap(numbered, cap).join(last_epochs(numbered).hint("merge"), [*S.SURFACE, "epoch"], "left_semi")
    return _kinds(table).withColumn("order_no", F.col("sequence"))


_MATRIX = "coalesce(transform, array(1D, 0D, 0D, 1D, 0D, 0D))"


def paint_texts(
    log: DataFrame,
    surface: DataFrame,
    table: DataFrame,
    resolved: DataFrame | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Paint rows of ``table`` with path text, paint, matrix and clip.

    Columns: SURFACE, epoch, sequence, order_no, kind, kind_index, d, paint,
    fill_rule, line_width, transform, clip_d, clip_transform, width, height.
    """
    kind = F.col("kind")
    base = table.select(
        *S.SURFACE,
        "epoch",
        "sequence",
        "order_no",
        "kind",
        "kind_index",
        "type",
        "path_id",
        "p_epoch",
        rect_path_text(F.col("args")).alias("_rect"),
        F.expr(
            "CASE kind WHEN 'shape' THEN coalesce(fill_style, '#000') WHEN 'stroke' THEN coalesce(stroke_style, '#000') END"
        ).alias("paint"),
        F.expr(
            "CASE WHEN kind = 'shape' THEN CASE WHEN type = 'fill' THEN coalesce(fill_rule, 'nonzero') ELSE 'nonzero' END END"
        ).alias("fill_rule"),
        F.expr("CASE WHEN kind = 'stroke' THEN coalesce(line_width, 1D) END").alias("line_width"),
        F.expr(_MATRIX).alias("transform"),
        "clip_seq",
        F.col("now_width").alias("width"),
        F.col("now_height").alias("height"),
    )
    texts = stage(epoch_texts(log, resolved, block_rows), "texts")
    clip_rows = surface.where((F.col("type") == "clip") & F.col("p_known"))
    clips = snapshot(
        clip_rows.select(*S.SURFACE, "sequence", "path_id", "p_epoch", F.expr(_MATRIX).alias("clip_transform")),
        texts,
    ).select(
        *S.SURFACE, F.col("sequence").alias("clip_seq"), close_for_fill(F.col("d")).alias("clip_d"), "clip_transform"
    )
    by_path = F.col("type").isin("fill", "stroke")
    from_path = snapshot(base.where(by_path), texts).withColumn(
        "d", F.when(kind == "shape", close_for_fill(F.col("d"))).otherwise(F.col("d"))
    )
    from_rect = base.where(~by_path).withColumn("d", F.col("_rect"))
    both = from_path.unionByName(from_rect).drop("_rect", "type", "path_id", "p_epoch")
    return both.join(clips.hint("merge"), [*S.SURFACE, "clip_seq"], "left").drop("clip_seq")


def numbered_log(surface: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The :func:`counted` table, written once for paints, errors and state."""
    return stage(counted(surface, block_rows), "numbered")


def paints(
    log: DataFrame,
    numbered: DataFrame,
    cap: int | None = None,
    resolved: DataFrame | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Current paints of every canvas with their texts, as a written table."""
    return stage(paint_texts(log, numbered, current_paints(numbered, cap), resolved, block_rows), "paints")


def state_of(surface: DataFrame) -> DataFrame:
    """Size, visibility and revision per canvas from the surface table."""
    flag = F.expr("CASE WHEN type = 'canvas_visibility' AND value IN ('true', 'false') THEN sequence END")
    return surface.groupBy(*S.SURFACE).agg(
        F.max_by("now_width", "sequence").alias("width"),
        F.max_by("now_height", "sequence").alias("height"),
        F.coalesce(F.max_by(F.col("value") == "true", flag), F.lit(True)).alias("visible"),
        F.count(F.lit(1)).alias("revision"),
    )


def surface_state(log: DataFrame) -> DataFrame:
    """Per canvas: size, visibility, revision (events so far) and whether the session ended.

    ``created_at`` is the sequence number of the creating event in its own frame.
    """
    rows = live_rows(joined_frames(log, old="_number"))
    side = lambda c: F.coalesce(
        F.max_by(F.greatest(F.col(c), F.lit(1.0)), F.when(F.col(c).isNotNull(), F.col("sequence"))), F.lit(1.0)
    )
    flag = F.when(
        (F.col("type") == "canvas_visibility") & F.col("value").isin("true", "false"), F.col("sequence")
    )
    state = rows.groupBy(*S.SURFACE).agg(
        F.min_by("_number", "sequence").alias("created_at"),
        side("width").alias("width"),
        side("height").alias("height"),
        F.coalesce(F.max_by(F.col("value") == "true", flag), F.lit(True)).alias("visible"),
        F.count(F.lit(1)).alias("revision"),
    )
    ended = log.where(F.col("type") == "session_end").select("session_id", F.lit(True).alias("_ended")).distinct()
    return (
        state.join(ended, "session_id", "left")
        .withColumn("ended", F.coalesce("_ended", F.lit(False)))
        .drop("_ended")
    )
