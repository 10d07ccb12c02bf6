"""From delivered batches to the accepted log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlog import schema as S
from drawlog.operators.running import BLOCK_ROWS, Run, row_numbers, running, seq_block
from drawlog.sources.staging import stage

# Least number of arguments per path command.
COMMAND_ARITY = {
    "move_to": 2,
    "line_to": 2,
    "bezier_curve_to": 6,
    "quadratic_curve_to": 4,
    "close_path": 0,
    "rect": 4,
    "arc": 5,
    "ellipse": 7,
    "begin_path": 0,
}


def with_defaults(log: DataFrame) -> DataFrame:
    """Missing frame and canvas ids get their default names."""
    out = log.withColumn("frame_id", F.coalesce("frame_id", F.lit(S.DEFAULT_FRAME)))
    if "canvas_id" in log.columns:
        out = out.withColumn("canvas_id", F.coalesce("canvas_id", F.lit(S.DEFAULT_CANVAS)))
    return out


def joined_frames(log: DataFrame, block_rows: int | None = None, old: str | None = None) -> DataFrame:
    """One line of events for every session whose frames share a canvas or a path.

    A canvas or path belongs to its session, whichever frame speaks of it.  A
    canvas is shared if events of several frames name it and one of them
    created it; events about paths are not about a canvas.
    Sessions with such an id get the default frame and new sequence numbers, in
    the order of ``arrival`` if the log has it (else of the old numbers), then
    frame and old number.  All other sessions stay as they are.  ``old`` names
    a further column for the numbers as they were.
    """
    rows = with_defaults(log)
    on_canvas = rows.where(~F.col("type").isin("session_end", "path_created", "path_command", "path_append"))
    canvases = on_canvas.groupBy("session_id", F.col("canvas_id").alias("_id")).agg(
        F.min("frame_id").alias("_a"), F.max("frame_id").alias("_z"), F.max(F.col("type") == "canvas_created").alias("_made")
    )
    named = rows.where(F.col("path_id").isNotNull()).groupBy("session_id", F.col("path_id").alias("_id"))
    paths = named.agg(F.min("frame_id").alias("_a"), F.max("frame_id").alias("_z"), F.lit(True).alias("_made"))
    shared = canvases.unionByName(paths).where("_a <> _z AND _made").select("session_id").distinct()
    shared = stage(shared, "shared")
    if shared.isEmpty():
        return log if old is None else log.withColumn(old, F.col("sequence"))
    order = ["arrival"] if "arrival" in log.columns else []
    mixed = rows.join(shared, "session_id", "left_semi").withColumn("_old", F.col("sequence"))
    numbered = row_numbers(
        mixed,
        ["session_id"],
        [*order, "_old", "frame_id"],
        F.floor(F.col(order[0] if order else "_old") / (block_rows or BLOCK_ROWS)),
        "_new",
    )
    numbered = numbered.withColumns({"sequence": F.col("_new"), "frame_id": F.lit(S.DEFAULT_FRAME)})
    apart = rows.join(shared, "session_id", "left_anti").withColumn("_old", F.col("sequence"))
    out = apart.unionByName(numbered.select(*apart.columns))
    return stage(out.withColumnRenamed("_old", old) if old else out.drop("_old"), "joined")


def command_ok(command: Column, path_id: Column) -> Column:
    arity = F.create_map(*[F.lit(x) for kv in COMMAND_ARITY.items() for x in kv])
    need = F.element_at(arity, command["type"])
    have = F.coalesce(F.size(command["args"]), F.lit(0))
    return F.coalesce(path_id.isNotNull() & need.isNotNull() & (have >= need), F.lit(False))


def accepted_prefix(log: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Drop resent events and keep, per frame, the gap-free run from sequence 1.

    Copies are dropped by a partial aggregate on the sequence, so a much-resent
    event is reduced before it is shuffled; with an ``arrival`` column the
    first copy stays.  The run is then found
    per block of sequence numbers: a block counts only when every block before
    it is complete.
    """
    size = block_rows or BLOCK_ROWS
    named = log.withColumn("frame_id", F.coalesce("frame_id", F.lit(S.DEFAULT_FRAME))).where(F.col("sequence") >= 1)
    key = [*S.FRAME, "sequence"]
    if "arrival" in log.columns:
        # The first delivery of a resent event counts.
        rest = [c for c in log.columns if c not in key]
        first = named.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("arrival")).alias("_r"))
        once = first.select(*key, "_r.*")
    else:
        once = named.dropDuplicates(key)
    once = stage(once.withColumn("_b", seq_block("sequence", size)), "once")
    local = once.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*S.FRAME, "_b").orderBy("sequence"))
    ).where(F.col("_rn") == F.col("sequence") - F.col("_b") * size)
    before = Window.partitionBy(*S.FRAME).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        once.groupBy(*S.FRAME, "_b")
        .agg((F.count(F.lit(1)) == size).alias("_full"))
        .withColumn("_n", F.count(F.lit(1)).over(before))
        .withColumn("_all", F.coalesce(F.min("_full").over(before), F.lit(True)))
        .where((F.col("_n") == F.col("_b")) & F.col("_all"))
        .select(*S.FRAME, "_b")
    )
    return local.join(blocks, [*S.FRAME, "_b"], "left_semi").select(*log.columns)


def sequence_gaps(log: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per gap: last sequence before it, next one seen, number missing."""
    once = (
        log.select("session_id", F.coalesce("frame_id", F.lit(S.DEFAULT_FRAME)).alias("frame_id"), "sequence")
        .where(F.col("sequence") >= 1)
        .distinct()
    )
    prev = running(
        once,
        S.FRAME,
        ["sequence"],
        seq_block("sequence", block_rows),
        {"last_good": Run("max", F.col("sequence"), inclusive=False)},
    ).withColumn("last_good", F.coalesce("last_good", F.lit(0).cast("bigint")))
    return prev.where(F.col("sequence") > F.col("last_good") + 1).select(
        *S.FRAME,
        "last_good",
        F.col("sequence").alias("next_seen"),
        (F.col("sequence") - F.col("last_good") - 1).alias("missing"),
    )


def _batch_frames(events: DataFrame) -> DataFrame:
    """One row per (batch, frame): the sequence it needs before it and its last one.

    Only batches within the size limit get here, so the window is bounded.
    """
    w = Window.partitionBy("batch_id", "frame_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_pm", F.max("sequence").over(w))
    fresh = F.col("_pm").isNull() | (F.col("sequence") > F.col("_pm"))
    gap = F.col("_pm").isNull() | (F.col("sequence") > F.col("_pm") + 1)
    return e.groupBy("batch_id", "session_id", "frame_id", "arrival").agg(
        F.greatest(
            F.max(F.when(gap, F.col("sequence") - 1)),
            F.max(F.when(fresh & ~F.col("_cmd_ok"), F.col("sequence"))),
        ).alias("need"),
        F.max("sequence").alias("hi"),
    )


def _settle(rows: DataFrame, span: int) -> DataFrame:
    """Decide which batches are accepted, given only (need, hi) per batch and frame.

    A batch is accepted when every frame in it has already reached ``need``;
    the state of a frame is the largest ``hi`` accepted before.  Each round
    starts from the batches still possible and removes (1) everything behind a
    hole that no remaining batch fills and (2) batches that arrive too early.
    The rounds end when nothing is removed; the answer does not depend on how
    many batches fall per round.
    """
    cur = rows
    while True:
        by_need = running(
            cur,
            S.FRAME,
            ["need", "arrival", "batch_id"],
            F.floor(F.col("need") / span),
            {"_reach": Run("max", F.col("hi"), inclusive=False)},
        )
        hole = (
            by_need.where(F.col("need") > F.coalesce("_reach", F.lit(0)))
            .groupBy(*S.FRAME)
            .agg(F.min("need").alias("_hole"))
        )
        alive = cur.join(hole, S.FRAME, "left").withColumn(
            "_alive", F.col("_hole").isNull() | (F.col("need") < F.col("_hole"))
        )
        state = running(
            alive,
            S.FRAME,
            ["arrival", "batch_id"],
            F.floor(F.col("arrival") / span),
            {"reached": Run("max", F.when(F.col("_alive"), F.col("hi")), inclusive=False)},
        ).withColumn("reached", F.coalesce("reached", F.lit(0).cast("bigint")))
        state = state.withColumn("_ok", F.col("_alive") & (F.col("need") <= F.col("reached")))
        verdict = state.groupBy("batch_id").agg(F.min("_ok").alias("_batch_ok"))
        nxt = stage(
            state.drop("_hole", "_alive", "_ok").join(verdict, "batch_id"),
            "gate",
        )
        kept = nxt.where("_batch_ok").drop("_batch_ok")
        if nxt.where("NOT _batch_ok").isEmpty():
            return kept
        cur = kept.drop("reached")


def batch_gate(
    log: DataFrame,
    sessions: DataFrame | None = None,
    max_events: int = S.MAX_BATCH_EVENTS,
    max_bytes: int = S.MAX_BATCH_BYTES,
    event_limit: int = S.MAX_SESSION_EVENTS,
    span: int = BLOCK_ROWS,
    state: DataFrame | None = None,
    used: DataFrame | None = None,
) -> DataFrame:
    """Accept or refuse every batch as a whole, with the reason of the refusal.

    ``log`` has the event columns plus ``batch_id``, ``arrival`` (number of the
    batch in its session, rising) and optionally ``position``.  ``sessions``
    lists the active sessions; without it every session is active.  ``state``
    (session_id, frame_id, last) gives the sequences and ``used`` (session_id,
    events) the events accepted before this log.  A refused batch leaves both as
    they are.  A batch belongs to the session of its first event.  Result: batch_id, session_id, arrival, events, new_events, reason (null =
    accepted).
    """
    cols = set(log.columns)
    payload = [c for c in S.EVENT.fieldNames() if c in cols]
    ev = with_defaults(log).withColumn("_pos", F.col("position") if "position" in cols else F.col("sequence"))
    ok = (
        (F.col("type") != "path_command") | command_ok(F.col("command"), F.col("path_id"))
        if "command" in cols
        else F.lit(True)
    )
    ev = ev.withColumn("_cmd_ok", ok).withColumn(
        "_bytes", F.octet_length(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})) + 1
    )
    sizes = ev.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("_bytes").alias("_bytes"),
        F.min_by("session_id", "_pos").alias("session_id"),
        (F.min("session_id") != F.max("session_id")).alias("_mixed"),
        F.min("arrival").alias("arrival"),
        F.min(F.coalesce("sequence", F.lit(0))).alias("_low"),
    )
    early = F.when((F.col("events") > max_events) | (F.col("_bytes") + 1 > max_bytes), "size")
    if sessions is not None:
        sizes = sizes.join(
            sessions.select("session_id", F.lit(True).alias("_active")).distinct(), "session_id", "left"
        )
        early = early.when(F.col("_active").isNull(), "session")
    sizes = stage(
        sizes.withColumn("_early", early).withColumn(
            "_never", (F.col("_low") < 1) | F.col("_mixed")
        ),
        "sizes",
    )
    judged = sizes.where("_early IS NULL").select("batch_id", "_never", F.col("session_id").alias("_own"))
    inside = ev.select("batch_id", "arrival", *S.FRAME, "sequence", "_pos", "_cmd_ok").join(judged, "batch_id")
    frames = _batch_frames(inside.where("NOT _never"))
    if state is not None:
        # What was accepted before acts as a first batch that needs nothing.
        frames = frames.unionByName(
            state.select(
                F.concat(F.lit("\x01"), "session_id", F.lit("\x01"), "frame_id").alias("batch_id"),
                *S.FRAME,
                F.lit(-1).cast("bigint").alias("arrival"),
                F.lit(0).cast("bigint").alias("need"),
                F.col("last").alias("hi"),
            )
        )
    kept, over = _settle_within(stage(frames, "frames"), sizes, used, event_limit, span)
    accepted = _new_events(kept)
    known = sizes.join(accepted, "batch_id", "left")
    full = over.select("batch_id", F.lit(True).alias("_full"))

    # The first bad event of a refused batch needs the state its frame had.
    refused = inside.join(accepted.select("batch_id"), "batch_id", "left_anti")
    reach = kept.select(*S.FRAME, "arrival", "batch_id", "hi", F.lit(None).cast("boolean").alias("_probe"))
    probes = refused.select(
        *S.FRAME, "arrival", "batch_id", F.lit(None).cast("bigint").alias("hi"), F.lit(True).alias("_probe")
    ).distinct()
    reached = (
        running(
            reach.unionByName(probes),
            S.FRAME,
            ["arrival", "batch_id"],
            F.floor(F.col("arrival") / span),
            {"_x": Run("max", F.col("hi"), inclusive=False)},
        )
        .where("_probe")
        .select("batch_id", *S.FRAME, F.coalesce("_x", F.lit(0)).alias("_x"))
    )
    w = Window.partitionBy("batch_id", "frame_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    bad = refused.join(reached, ["batch_id", *S.FRAME]).withColumn(
        "_cur", F.greatest(F.col("_x"), F.max("sequence").over(w))
    )
    fault = (
        F.when((F.coalesce("sequence", F.lit(0)) < 1) | (F.col("session_id") != F.col("_own")), "sequence")
        .when(F.col("sequence") > F.col("_cur") + 1, "sequence")
        .when((F.col("sequence") > F.col("_cur")) & ~F.col("_cmd_ok"), "invalid")
    )
    first = (
        bad.withColumn("_fault", fault)
        .where("_fault IS NOT NULL")
        .groupBy("batch_id")
        .agg(F.min_by("_fault", F.struct("_pos", "frame_id")).alias("_fault"))
    )
    return (
        known.join(full, "batch_id", "left")
        .join(first, "batch_id", "left")
        .select(
            "batch_id",
            "session_id",
            "arrival",
            "events",
            F.coalesce("new_events", F.lit(0).cast("bigint")).alias("new_events"),
            F.when(F.col("_early").isNotNull(), F.col("_early"))
            .when(F.col("_full"), "limit")
            .when(F.col("new_events").isNull(), F.coalesce("_fault", F.lit("sequence")))
            .alias("reason"),
        )
    )


def session_event_cap(
    batches: DataFrame, n: int = S.MAX_SESSION_EVENTS, span: int = BLOCK_ROWS, used: DataFrame | None = None
) -> DataFrame:
    """Batches that fit when a session takes at most ``n`` events, in order of arrival.

    A batch that does not fit leaves the count as it is, so a later, smaller
    one may fit.  ``batches``: session_id, batch_id, arrival, new_events;
    ``used`` (session_id, events): what sessions took before.  Adds
    session_events, the session's count with the batch.

    A round takes everything before the first batch that does not fit and
    drops all later ones larger than the room that is left.  The room falls
    below the size of each refused batch, so rounds are bounded by the number
    of different sizes, whatever the number of batches.
    """
    cols, at = batches.columns, F.struct("arrival", "batch_id")
    if used is None:
        cur = batches.withColumn("_used", F.lit(0).cast("bigint"))
    else:
        cur = batches.join(used.select("session_id", F.col("events").alias("_used")), "session_id", "left")
        cur = cur.withColumn("_used", F.coalesce("_used", F.lit(0).cast("bigint")))
    taken = None
    while True:
        ran = running(
            cur,
            ["session_id"],
            ["arrival", "batch_id"],
            F.floor(F.col("arrival") / span),
            {"_sum": Run("sum", F.col("new_events"))},
        ).withColumn("session_events", (F.col("_used") + F.col("_sum")).cast("bigint"))
        over = ran.where(F.col("session_events") > n).groupBy("session_id").agg(F.min(at).alias("_over"))
        marked = stage(ran.join(over, "session_id", "left").drop("_sum"), "cap")
        good = marked.where(F.col("_over").isNull() | (at < F.col("_over"))).select(*cols, "session_events")
        taken = good if taken is None else taken.unionByName(good)
        now = good.groupBy("session_id").agg(F.max("session_events").alias("_now"))
        rest = marked.where(at > F.col("_over")).drop("_over", "session_events").join(now, "session_id", "left")
        rest = rest.withColumn("_used", F.coalesce("_now", "_used")).drop("_now")
        cur = stage(rest.where(F.col("new_events") <= n - F.col("_used")), "cap")
        if cur.isEmpty():
            return taken


def _new_events(kept: DataFrame) -> DataFrame:
    fresh = F.sum(F.greatest(F.col("hi") - F.col("reached"), F.lit(0))).cast("bigint").alias("new_events")
    return kept.groupBy("batch_id").agg(fresh)


def _settle_within(frames: DataFrame, sizes: DataFrame, used: DataFrame | None, n: int, span: int) -> tuple[DataFrame, DataFrame]:
    """:func:`_settle` under the event limit: accepted (batch, frame) rows, and the batches the limit refuses.

    All decisions before the first batch of a session that passes the limit
    stand.  That batch is refused, and so is the first one of every other
    frame from there on that is larger than the room left: what its frame has
    reached is known, and the room never grows.  Without them their frames
    stop, so the rest of what was accepted is settled anew.
    """
    batches = sizes.select("batch_id", "session_id", "arrival")
    at = F.struct("arrival", "batch_id")
    refused = None
    while True:
        kept = _settle(frames, span)
        counted = running(
            batches.join(_new_events(kept), "batch_id"),
            ["session_id"],
            ["arrival", "batch_id"],
            F.floor(F.col("arrival") / span),
            {"_sum": Run("sum", F.col("new_events"))},
        )
        if used is not None:
            counted = counted.join(used.select("session_id", F.col("events").alias("_used")), "session_id", "left")
            counted = counted.withColumn("_sum", F.col("_sum") + F.coalesce("_used", F.lit(0)))
        first = counted.where(F.col("_sum") > n).groupBy("session_id").agg(
            F.min(at).alias("_from"), F.min_by(n - F.col("_sum") + F.col("new_events"), at).alias("_room")
        )
        late = kept.join(first, "session_id").where(at >= F.col("_from"))
        lead = late.groupBy(*S.FRAME).agg(F.min(at).alias("_lead"))
        fresh = F.sum(F.greatest(F.col("hi") - F.col("reached"), F.lit(0)))
        judged = late.join(lead, S.FRAME).groupBy("batch_id").agg(
            F.bool_and(at == F.col("_lead")).alias("_leads"), (fresh > F.min("_room")).alias("_large")
        )
        over = stage(judged.where("_leads AND _large").select("batch_id"), "over")
        refused = over if refused is None else refused.unionByName(over)
        if over.isEmpty():
            return kept, refused
        # Fewer batches never let another one in, so what was refused above stays out of the next round.
        frames = stage(kept.drop("reached").join(over, "batch_id", "left_anti"), "frames")


# Control events at one arrival, and the log rows there (2), act in this order.
_TURN = {"stop": 0, "start": 1, "clear_surfaces": 3, "clear": 4}


def session_lifecycle(log: DataFrame, control: DataFrame, span: int = BLOCK_ROWS) -> DataFrame:
    """Log rows that survive the control events of their session.

    ``control``: session_id, arrival, action in start / stop / clear /
    clear_surfaces; repeated rows count once.  Every start begins a new
    generation of the session with its own sequences, surfaces and count; a
    session without any start has one generation from its first row on.  A
    generation takes rows from its start until a stop or clear.  A clear, or a
    clear_surfaces while no generation takes rows, drops everything before it.
    Rows older than a clear_surfaces of their generation keep their sequence
    numbers but no longer count and no longer belong to a surface
    (``on_surface`` false).  Adds on_surface and generation (from 1);
    :func:`generations_apart` makes generations sessions of their own.
    """
    acts = stage(control.select("session_id", "arrival", F.col("action").alias("_action")).distinct(), "control")
    turn = F.coalesce(*[F.when(F.col("_action") == a, n) for a, n in _TURN.items()], F.lit(5)).alias("_turn")
    begins = F.coalesce(F.col("_action") == "start", F.lit(False)).cast("bigint")
    started = acts.where("_action = 'start'").select("session_id", F.lit(True).alias("_started")).distinct()
    none = acts.where("_action = 'start'").isEmpty()

    def in_generation(df: DataFrame) -> DataFrame:
        """Add generation: starts so far, 1 for sessions without any."""
        if none:
            return df.withColumn("generation", F.lit(1).cast("bigint"))
        block = F.floor(F.col("arrival") / span)
        # Rows of one session at one place have the same starts before them, in whatever order they come.
        counted = running(df, ["session_id"], ["arrival", "_turn"], block, {"generation": Run("sum", begins)})
        counted = counted.join(started, "session_id", "left")
        return counted.withColumn("generation", F.when(F.col("_started"), F.col("generation")).otherwise(1)).drop("_started")

    at = F.struct("arrival", "_turn")
    acts = stage(in_generation(acts.select("*", turn)), "control")
    halts = acts.where("_action IN ('stop', 'clear')").groupBy("session_id", "generation").agg(F.min(at).alias("_halt"))
    acts = acts.join(halts, ["session_id", "generation"], "left")
    idle = (F.col("generation") == 0) | F.coalesce(at > F.col("_halt"), F.lit(False))
    on_surfaces = F.col("_action") == "clear_surfaces"
    wiped = acts.where((F.col("_action") == "clear") | (on_surfaces & idle)).groupBy("session_id").agg(F.max(at).alias("_wiped"))
    cleared = acts.where(on_surfaces & ~idle).groupBy("session_id", "generation").agg(F.max("arrival").alias("_cleared"))

    rows = log.withColumns({"_turn": F.lit(2), "_action": F.lit(None).cast("string")})
    if not none:
        marks = acts.where("_action = 'start'").select("session_id", "arrival", "_action", "_turn")
        rows = in_generation(rows.unionByName(marks, allowMissingColumns=True)).where("_action IS NULL")
    else:
        rows = in_generation(rows)
    kept = (
        rows.where("generation > 0")
        .join(wiped, "session_id", "left")
        .join(halts, ["session_id", "generation"], "left")
        .where(F.col("_wiped").isNull() | (at > F.col("_wiped")))
        .where(F.col("_halt").isNull() | (at < F.col("_halt")))
        .join(cleared, ["session_id", "generation"], "left")
    )
    on_surface = F.col("_cleared").isNull() | (F.col("arrival") > F.col("_cleared"))
    return kept.select(*log.columns, on_surface.alias("on_surface"), "generation")


def generations_apart(rows: DataFrame) -> DataFrame:
    """Rows of :func:`session_lifecycle` with every later generation as a session of its own, ``<session_id>#<generation>``.

    All other operators work by session, so sequences, surfaces, paths and
    counts then begin anew with each start.
    """
    later = F.concat("session_id", F.lit("#"), F.col("generation").cast("string"))
    return rows.withColumn("session_id", F.when(F.col("generation") > 1, later).otherwise(F.col("session_id")))
