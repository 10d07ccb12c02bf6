"""Path text at the moment of a paint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlog import schema as S
from drawlog.functions.geometry import arc_lead, command_text
from drawlog.operators.ingest import with_defaults
from drawlog.functions.text import fmt4
from drawlog.operators.running import Run, log_block, running, seq_block
from drawlog.operators.segments import explode_path_segments, flatten_arcs
from drawlog.sources.staging import stage

PATH_EVENTS = ("path_created", "path_command", "path_append")
_KEYED = [*S.FRAME, "sequence"]


def is_object(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\s*\{"), F.lit(False))


def is_seed(value: Column) -> Column:
    return (
        value.isNotNull()
        & ~is_object(value)
        & ~value.isin("true", "false", "null")
    )


NO_REFS = object()  # instead of texts: leave copies and appends open


def references(log: DataFrame) -> DataFrame | object:
    """Texts of the log's copies and appends (:func:`path_lineage`), resolved once for each log object."""
    if getattr(log, "_drawlog_references", None) is None:
        refers = F.col("path_id").isNotNull() & F.col("type").isin("path_created", "path_append") & is_object(F.col("value"))
        log._drawlog_references = NO_REFS if log.where(refers).isEmpty() else path_lineage(log)
    return log._drawlog_references


def _with_refs(rows: DataFrame, resolved: DataFrame | object) -> DataFrame:
    """Add ref_text and ref_current: text of copies and appends by (session, frame, sequence)."""
    if resolved is NO_REFS:
        return rows.withColumns({"ref_text": F.lit(None).cast("string"), "ref_current": F.lit(False)})
    refs = resolved.select(
        *_KEYED, F.when(F.col("d") != "", F.col("d")).alias("ref_text"), F.col("has_current").alias("ref_current")
    )
    return rows.join(refs, _KEYED, "left")


def _seed_text() -> Column:
    value = F.col("value")
    return F.coalesce("ref_text", F.when(is_seed(value) & (value != ""), value))


_BEGINS = "type = 'path_command' AND command.type = 'begin_path'"


def path_state(log: DataFrame, resolved: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """Every log row with the state of its path just before it.

    Adds p_known (path exists), p_epoch (begin_path so far) and p_filled (has
    text).  A creation only has an effect as the first event of its path.
    Copies and appends are resolved here unless ``resolved`` brings their
    texts.
    """
    rows = _with_refs(with_defaults(log), references(log) if resolved is None else resolved)
    seq = F.col("sequence")
    exists = F.expr(
        "path_id IS NOT NULL AND (type IN ('path_created', 'path_command') OR (type = 'path_append' AND ref_text IS NOT NULL))"
    )
    adds = F.expr(
        "(type = 'path_command' AND command.type <> 'begin_path') OR (type = 'path_append' AND ref_text IS NOT NULL)"
    )
    seeded = (F.col("type") == "path_created") & _seed_text().isNotNull()
    state = running(
        rows.where("path_id IS NOT NULL"),
        S.PATH,
        ["sequence"],
        log_block(log, block_rows),
        {
            "_first": Run("min", F.when(exists, seq * 2 + F.coalesce(seeded, F.lit(False)).cast("bigint"))),
            "p_epoch": Run("sum", F.expr(f"CAST({_BEGINS} AS BIGINT)")),
            "_begun": Run("max", F.expr(f"CASE WHEN {_BEGINS} THEN sequence END")),
            "_added": Run("max", F.when(adds, seq)),
        },
    )
    state = state.withColumns(
        {
            "p_known": F.expr("_first IS NOT NULL"),
            "p_filled": F.expr(
                "greatest(coalesce(_added, 0), CASE WHEN _first % 2 = 1 THEN _first DIV 2 ELSE 0 END) > coalesce(_begun, 0)"
            ),
        }
    ).drop("_first", "_begun", "_added")
    # Rows without a path have no state and take no part in the pass.
    none = {"p_epoch": F.lit(0).cast("bigint"), "p_known": F.lit(False), "p_filled": F.lit(False)}
    others = rows.where("path_id IS NULL").withColumns(none)
    return state.unionByName(others).drop("ref_text", "ref_current")


def path_pieces(log: DataFrame, resolved: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """Text pieces of every path: PATH, p_epoch, sequence, sets_current, lead, text.

    ``lead`` is put before ``text`` when the path has no current point there.
    """
    rows = _with_refs(
        with_defaults(log)
        .where(F.col("path_id").isNotNull() & F.col("type").isin(*PATH_EVENTS))
        .select(*S.PATH, "sequence", "type", "command", "value"),
        references(log) if resolved is None else resolved,
    )
    exists = F.expr("type <> 'path_append' OR ref_text IS NOT NULL")
    placed = running(
        rows,
        S.PATH,
        ["sequence"],
        log_block(log, block_rows),
        {
            "_first": Run("min", F.when(exists, F.col("sequence"))),
            "p_epoch": Run("sum", F.expr(f"CAST({_BEGINS} AS BIGINT)")),
        },
    )
    kind, args = F.col("command")["type"], F.col("command")["args"]
    is_command = (F.col("type") == "path_command") & (kind != "begin_path")
    first_creation = (F.col("type") == "path_created") & (F.col("sequence") == F.col("_first"))
    return placed.select(
        *S.PATH,
        "p_epoch",
        "sequence",
        F.when(is_command, kind != "close_path")
        .when(first_creation, F.coalesce("ref_current", F.lit(False)))
        .otherwise(False)
        .alias("sets_current"),
        F.when(is_command, arc_lead(kind, args)).alias("lead"),
        F.when(is_command, command_text(kind, args))
        .when(first_creation, _seed_text())
        .when(F.col("type") == "path_append", F.col("ref_text"))
        .alias("text"),
    ).where("text IS NOT NULL")


def path_epochs(log: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Number of begin_path so far in the path of every path event, paint and clip."""
    rows = with_defaults(log).where(F.col("path_id").isNotNull())
    begins = F.coalesce(F.col("command")["type"] == "begin_path", F.lit(False))
    return running(
        rows,
        S.PATH,
        ["sequence"],
        seq_block("sequence", block_rows),
        {"path_epoch": Run("sum", begins.cast("bigint"))},
    )


def epoch_texts(log: DataFrame, resolved: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """One row per path epoch: its pieces in order and where a current point starts."""
    return (
        path_pieces(log, resolved, block_rows)
        .groupBy(*S.PATH, "p_epoch")
        .agg(
            F.array_sort(F.collect_list(F.struct("sequence", "lead", "text"))).alias("_pieces"),
            F.min(F.when(F.col("sets_current"), F.col("sequence"))).alias("_current_from"),
        )
    )


def snapshot(asks: DataFrame, texts: DataFrame, keep_current: bool = False) -> DataFrame:
    """Add ``d``: text of the asked path epoch up to the asking row.

    The epoch's pieces are aggregated once; each paint takes those with a
    smaller sequence, so later edits do not reach back.
    """
    text = F.expr(
        """array_join(transform(filter(_pieces, p -> p.sequence < sequence),
             p -> CASE WHEN p.lead IS NULL OR p.sequence > _current_from THEN p.text
                       ELSE concat(p.lead, ' ', p.text) END), ' ')"""
    )
    # Texts take far more memory than their written size: never broadcast.
    out = asks.join(texts.hint("merge"), [*S.PATH, "p_epoch"], "left").withColumn("d", F.coalesce(text, F.lit("")))
    if keep_current:
        out = out.withColumn("has_current", F.coalesce(F.col("_current_from") < F.col("sequence"), F.lit(False)))
    return out.drop("_pieces", "_current_from")


def path_asof_snapshot(
    log: DataFrame, resolved: DataFrame | None = None, block_rows: int | None = None
) -> DataFrame:
    """Path text at every fill, stroke and clip; d is null for an unknown path."""
    state = path_state(log, resolved, block_rows).where(
        F.col("type").isin("fill", "stroke", "clip") & F.col("path_id").isNotNull()
    )
    asks = state.select(*S.SURFACE, "sequence", "type", "path_id", "p_known", "p_epoch")
    out = snapshot(asks, epoch_texts(log, resolved, block_rows))
    return out.select(
        *S.SURFACE, "sequence", "type", "path_id", F.when(F.col("p_known"), F.col("d")).alias("d")
    )


def path_refs(log: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Copies and appends with the epoch of their source and of their own path.

    Columns: session_id, frame_id, sequence, type, path_id, p_epoch,
    source_path_id, src_epoch, transform.
    """
    rows = with_defaults(log).where(F.col("path_id").isNotNull() & F.col("type").isin(*PATH_EVENTS))
    source = F.when(is_object(F.col("value")), F.get_json_object("value", "$.source_path_id"))
    rows = rows.select(
        *S.PATH, "sequence", "type", "command", "transform",
        F.when(F.col("type") != "path_command", source).alias("source_path_id"),
    )
    epoch = {"p_epoch": Run("sum", F.expr(f"CAST({_BEGINS} AS BIGINT)"))}
    block = seq_block("sequence", block_rows)
    own = running(rows, S.PATH, ["sequence"], block, epoch).where("source_path_id IS NOT NULL").drop("command")
    own = stage(own, "refs")
    asks = own.select(
        *S.FRAME, F.col("source_path_id").alias("path_id"), "sequence", F.lit("ask").alias("type"),
        F.lit(None).cast(rows.schema["command"].dataType).alias("command"),
    )
    line = rows.select(*S.PATH, "sequence", "type", "command").unionByName(asks)
    asked = (
        running(line, S.PATH, ["sequence", "type"], block, epoch)
        .where("type = 'ask'")
        .select(*_KEYED, F.col("p_epoch").alias("src_epoch"))
    )
    return own.join(asked, _KEYED)


def _moved_text(rows: DataFrame) -> DataFrame:
    """Text ``d`` of rows (session, frame, sequence, transform) moved by their matrix.

    Written as absolute commands with up to four decimals; arcs become cubics.
    Text that cannot be read, or does not start with a move, gives null.
    """
    seg = explode_path_segments(rows.select(*_KEYED, "d", "transform"))
    base = ["letter", "px", "py", "c1x", "c1y", "c2x", "c2y", "x", "y"]
    keep = [*_KEYED, "transform", "seg_no"]
    arcs = flatten_arcs(seg.where("letter = 'A'")).select(*keep, "piece_no", *base)
    others = seg.where("letter <> 'A'").select(*keep, F.lit(1).cast("bigint").alias("piece_no"), *base)
    both = arcs.unionByName(others)

    def at(p: str) -> list[Column]:
        return [
            fmt4(F.expr(f"transform[0] * {p}x + transform[2] * {p}y + transform[4]")),
            fmt4(F.expr(f"transform[1] * {p}x + transform[3] * {p}y + transform[5]")),
        ]

    line = (
        F.when(F.col("letter") == "Z", "Z")
        .when(F.col("letter") == "M", F.concat_ws(" ", F.lit("M"), *at("")))
        .when(F.col("letter").isin("C", "S"), F.concat_ws(" ", F.lit("C"), *at("c1"), *at("c2"), *at("")))
        .when(F.col("letter").isin("Q", "T"), F.concat_ws(" ", F.lit("Q"), *at("c1"), *at("")))
        .otherwise(F.concat_ws(" ", F.lit("L"), *at("")))
    )
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "piece_no", line.alias("t")))), lambda r: r["t"]), " "
    )
    moved = F.bool_or((F.col("seg_no") == 1) & (F.col("letter") != "M"))
    return both.groupBy(*_KEYED).agg(F.when(~moved, text).alias("d"))


def _bends() -> Column:
    ident = F.expr("array(1D, 0D, 0D, 1D, 0D, 0D)")
    return F.coalesce((F.col("type") == "path_append") & F.col("transform").isNotNull() & (F.col("transform") != ident), F.lit(False))


def _plain_copies(refs: DataFrame, used: DataFrame, block_rows: int | None = None) -> DataFrame:
    """References whose source held nothing but one other reference: _KEYED, ``_root``, ``_keeps``.

    Such a reference has the text of the other one, so a chain of them is
    followed by pointer doubling down to ``_root``, the sequence of the first
    that is none itself.  ``_keeps`` tells whether the root's current point is
    kept on the way (a creation keeps it, an append does not).
    """
    epoch = {"p_epoch": Run("sum", F.expr(f"CAST({_BEGINS} AS BIGINT)"))}
    source = [*S.PATH, "p_epoch"]
    events = running(used.select(*S.PATH, "sequence", "type", "command"), S.PATH, ["sequence"], seq_block("sequence", block_rows), epoch)
    events = stage(events.where(f"NOT coalesce({_BEGINS}, false)").select(*source, "sequence"), "lineage-events")
    first = events.groupBy(*source).agg(F.min("sequence").alias("_root"))
    second = events.join(first, source).where("sequence > _root").groupBy(*source).agg(F.min("sequence").alias("_second"))
    only = (
        refs.select(*source, F.col("sequence").alias("_root"), (F.col("type") == "path_created").alias("_keeps"))
        .join(first, [*source, "_root"])
        .where("NOT _keeps OR p_epoch = 0")  # a creation only has an effect as the first event of its path
        .join(second, source, "left")
        .withColumnsRenamed({"path_id": "source_path_id", "p_epoch": "src_epoch"})
    )
    plain = (
        refs.where(~_bends())
        .join(only, [*S.FRAME, "source_path_id", "src_epoch"])
        .where("_root < sequence AND (_second IS NULL OR _second >= sequence)")
        .select(*_KEYED, "_root", "_keeps")
    )
    plain = stage(plain, "lineage-plain")
    while True:
        further = plain.select(*S.FRAME, F.col("sequence").alias("_root"), F.col("_root").alias("_next"), F.col("_keeps").alias("_too"))
        if plain.join(further, [*S.FRAME, "_root"], "left_semi").isEmpty():
            return plain
        plain = plain.join(further, [*S.FRAME, "_root"], "left").select(
            *_KEYED, F.coalesce("_next", "_root").alias("_root"), (F.col("_keeps") & F.coalesce("_too", F.lit(True))).alias("_keeps")
        )
        plain = stage(plain, "lineage-plain")


def path_lineage(log: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Text of every copy and append: its source's text at that moment.

    Copies of copies with nothing added in between take the text of the first
    one, found by pointer doubling.  The other references are resolved from
    the bottom up: a round takes those whose source holds no open reference
    before them, so each text is built once; the number of rounds is the
    longest chain of references that add or move something.  Result:
    session_id, frame_id, sequence, type, path_id, source_path_id, d,
    has_current.
    """
    refs = stage(path_refs(log, block_rows), "lineage-refs")
    sources = refs.select(*S.FRAME, F.col("source_path_id").alias("path_id")).distinct()
    used = with_defaults(log).where(F.col("type").isin(*PATH_EVENTS)).join(sources, S.PATH, "left_semi")
    used = stage(used.select(*S.PATH, "sequence", "type", "command", "value"), "lineage-sources")
    plain = _plain_copies(refs, used, block_rows)
    open_refs, resolved = refs.join(plain, _KEYED, "left"), None
    while True:
        waiting = (
            open_refs.groupBy(*S.FRAME, F.col("path_id").alias("source_path_id"), F.col("p_epoch").alias("src_epoch"))
            .agg(F.min("sequence").alias("_open"))
        )
        marked = stage(
            open_refs.join(waiting, [*S.FRAME, "source_path_id", "src_epoch"], "left").withColumn(
                "_ready", F.col("_root").isNull() & (F.col("_open").isNull() | (F.col("_open") >= F.col("sequence")))
            ).drop("_open"),
            "lineage-round",
        )
        ready = marked.where("_ready")
        asks = ready.select(
            *S.FRAME, F.col("source_path_id").alias("path_id"), F.col("src_epoch").alias("p_epoch"), "sequence",
            F.col("path_id").alias("_target"), "type", "transform",
        )
        texts = epoch_texts(used, NO_REFS if resolved is None else resolved, block_rows)
        copied = snapshot(asks, texts, keep_current=True)
        copied = stage(copied, "lineage-texts")
        moved = _moved_text(copied.where(_bends() & (F.col("d") != "")))
        named = [*_KEYED, "type", F.col("_target").alias("path_id"), F.col("path_id").alias("source_path_id")]
        done = (
            copied.where(~_bends())
            .select(*named, "d", "has_current")
            .unionByName(copied.where(_bends()).select(*named, "has_current").join(moved, _KEYED, "left"))
        )
        done = stage(done, "lineage-done")
        roots = done.select(*S.FRAME, F.col("sequence").alias("_root"), F.coalesce("d", F.lit("")).alias("d"), "has_current")
        follow = marked.where("_root IS NOT NULL").join(roots, [*S.FRAME, "_root"]).select(
            *_KEYED, "type", "path_id", "source_path_id", "d", (F.col("_keeps") & F.col("has_current")).alias("has_current")
        )
        done = done.unionByName(stage(follow, "lineage-follow"))
        resolved = done if resolved is None else resolved.unionByName(done)
        open_refs = marked.drop("_ready").join(done.select(*_KEYED), _KEYED, "left_anti")
        if open_refs.isEmpty():
            return resolved
