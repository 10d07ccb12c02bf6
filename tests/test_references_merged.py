"""Copies and appends without further arguments, limits, one log cut in several ways, and merged documents."""

import random

import pytest
from events import frame, numbered
from pyspark.sql import functions as F

from drawlog.operators import export, ingest, paths, surface, tiles
from drawlog.operators.assets import edit_markup, vector_elements
from drawlog.operators.catalog import canvas_catalog, document_tables
from drawlog.functions.sizing import gcd
from drawlog.sources.readers import load_export_settings

COPY = [
    ("canvas_created", {"width": 60.0, "height": 40.0}),
    ("path_created", {"path_id": "a", "value": "M 1 2 L 9 2 L 9 8 Z"}),
    ("path_created", {"path_id": "b", "value": '{"source_path_id": "a"}'}),
    ("path_append", {"path_id": "d", "value": '{"source_path_id": "b"}'}),
    ("fill", {"path_id": "b"}),
    ("fill", {"path_id": "d"}),
    ("fill", {"path_id": "nowhere"}),
]


def test_copies_and_appends_are_part_of_the_pipeline(spark):
    log = frame(spark, numbered(*COPY))
    row = canvas_catalog(log).first()
    assert (row["shapes"], row["errors"]) == (2, 1)
    got = {r["path_id"]: r["d"] for r in paths.path_asof_snapshot(log).collect()}
    assert got == {"b": COPY[1][1]["value"], "d": COPY[1][1]["value"], "nowhere": None}


def test_gcd_of_neighbouring_fibonacci_numbers(spark):
    a, b = 1, 1
    while b < 2**61:
        a, b = b, a + b
    assert spark.range(1).select(gcd(F.lit(b), F.lit(a)).alias("g")).first()["g"] == 1


def _receive(batches, max_events, limit):
    """One batch after the other: reasons by batch."""
    last, used, out = {}, {}, {}
    for bid, session, f, seqs in batches:
        if len(seqs) > max_events:
            out[bid] = "size"
            continue
        cur, fresh, reason = last.get((session, f), 0), 0, None
        for q in seqs:
            if q == cur + 1:
                cur, fresh = q, fresh + 1
            elif q > cur:
                reason = "sequence"
                break
        if reason is None and used.get(session, 0) + fresh > limit:
            reason = "limit"
        out[bid] = reason
        if reason is None:
            last[session, f], used[session] = cur, used.get(session, 0) + fresh
    return out


SCHEMA = "session_id string, frame_id string, canvas_id string, sequence long, type string, batch_id string, arrival long"


def _log(spark, batches):
    return spark.createDataFrame([(s, f, "c", q, "x", b, n) for n, (b, s, f, qs) in enumerate(batches) for q in qs], SCHEMA)


def test_a_refused_batch_leaves_the_count(spark):
    sizes = spark.createDataFrame([("s", "b1", 1, 5), ("s", "b2", 2, 10), ("s", "b3", 3, 2), ("s", "b4", 4, 0), ("s", "b5", 5, 1), ("s", "b6", 6, 1)], "session_id string, batch_id string, arrival long, new_events long")
    got = ingest.session_event_cap(sizes, n=8, span=2).collect()
    assert sorted((r["batch_id"], r["session_events"]) for r in got) == [("b1", 5), ("b3", 7), ("b4", 7), ("b5", 8)]
    batches = [("b1", "s", "A", [1, 2, 3, 4, 5]), ("b2", "s", "A", list(range(6, 16))), ("b3", "s", "B", [1, 2]), ("b4", "s", "A", [16, 17])]
    got = {r["batch_id"]: r["reason"] for r in ingest.batch_gate(_log(spark, batches), event_limit=8).collect()}
    assert got == {"b1": None, "b2": "limit", "b3": None, "b4": "sequence"} == _receive(batches, 100, 8)


def _random_batches(seed):
    r = random.Random(seed)
    batches, at = [], {}
    for i in range(120):
        s, f = r.choice("st"), r.choice("ABC")
        start = at.get((s, f), 1) + r.choice([0] * 12 + [-3, 2])
        qs = list(range(max(start, 1), max(start, 1) + r.choice([1, 2, 3, 4, 5, 5, 6])))
        batches.append((f"b{i:03d}", s, f, qs))
        if start <= at.get((s, f), 1) and len(qs) < 6 and r.random() < 0.9:
            at[s, f] = max(at.get((s, f), 1), qs[-1] + 1)
    return batches


@pytest.mark.parametrize("parts", [1, 3])
def test_the_limit_does_not_depend_on_how_the_log_was_cut(spark, parts):
    from drawlog.streaming import tables

    batches = _random_batches(4)
    want = _receive(batches, 5, 40)
    assert "limit" in want.values() and "sequence" in want.values()
    log = _log(spark, batches)
    if parts == 1:
        assert {r["batch_id"]: r["reason"] for r in ingest.batch_gate(log, max_events=5, event_limit=40, span=16).collect()} == want
        return
    from drawlog.sources.staging import stage_path

    source, sink = stage_path(spark, "cut"), stage_path(spark, "sink")
    step = -(-len(batches) // parts)
    for i in range(parts):
        log.where(f"arrival >= {i * step} AND arrival < {(i + 1) * step}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = tables.stream_quarantine(stream, sink, buckets=4, max_events=5, event_limit=40)
    writer.option("checkpointLocation", stage_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    assert {r["batch_id"]: r["reason"] for r in tables.refused(spark, sink).collect()} == {b: x for b, x in want.items() if x}


def test_first_copy_of_a_resent_event_counts(spark):
    rows = [("s", "f", 1, "late", 5), ("s", "f", 1, "first", 2), ("s", "f", 2, "only", 3)]
    df = spark.createDataFrame(rows, "session_id string, frame_id string, sequence long, type string, arrival long")
    assert [r["type"] for r in ingest.accepted_prefix(df).orderBy("sequence").collect()] == ["first", "only"]


def test_frames_that_share_nothing_keep_their_numbers(spark):
    rows = []
    for f in ("one", "two"):
        kinds = [("canvas_created", {"canvas_id": f"{f}-c", "width": 80.0, "height": 60.0}), ("path_command", {"canvas_id": None, "path_id": f"{f}-p", "command": {"type": "move_to", "args": [1.0, 1.0]}})]
        kinds += [("save", {"canvas_id": None}), ("fill", {"canvas_id": f"{f}-c", "path_id": f"{f}-p"})]
        rows += [{**r, "frame_id": f} for r in numbered(*kinds)]
    log = frame(spark, rows)
    joined = ingest.joined_frames(log)
    assert sorted(map(str, joined.collect())) == sorted(map(str, log.collect()))
    # A shared canvas joins the frames, and its creation keeps the number it had.
    extra = numbered(("set_transform", {}), ("set_transform", {}), ("canvas_created", {"width": 30.0, "height": 30.0}))[2]
    more = [{**extra, "frame_id": "two", "sequence": 5, "canvas_id": "both"}, {**extra, "type": "fill_rect", "frame_id": "one", "sequence": 5, "canvas_id": "both", "args": [0.0, 0.0, 1.0, 1.0]}]
    state = {r["canvas_id"]: r["created_at"] for r in surface.surface_state(frame(spark, rows + more)).collect()}
    assert state == {"one-c": 1, "two-c": 1, "both": 5}


def test_frames_share_a_canvas(spark):
    rows = []
    for f in ("one", "two"):
        for i, (kind, kw) in enumerate([("canvas_created", {"width": 80.0, "height": 60.0}), ("fill_rect", {"args": [1.0, 1.0, 30.0, 20.0]})], 1):
            rows.append({**numbered((kind, kw))[0], "frame_id": f, "canvas_id": None, "sequence": i})
    rows.append({**numbered(("canvas_created", {"width": 20.0, "height": 20.0}))[0], "session_id": "other", "frame_id": "one"})
    log = frame(spark, rows)
    got = {r["session_id"]: (r["revision"], r["shapes"]) for r in canvas_catalog(log).collect()}
    assert got == {"s": (4, 2), "other": (1, 0)}
    assert sorted(r["revision"] for r in surface.surface_state(log).collect()) == [1, 4]
    assert ingest.joined_frames(log.where("frame_id = 'one'")).count() == 3


def _tile(n, x):
    kw = {"canvas_id": f"f-canvas-{n}", "width": 50.0, "height": 50.0}
    at = {"canvas_id": kw["canvas_id"], "transform": [1.0, 0.0, 0.0, 1.0, x, 0.0]}
    return [
        ("canvas_created", kw),
        ("fill_rect", {"args": [0.0, 0.0, 90.0, 30.0], "fill_style": "#123", **at}),
        ("clear_rect", {"args": [5.0, 5.0, 10.0, 10.0], **at}),
        ("fill_rect", {"args": [1.0, 1.0, 2.0, 2.0], "fill_style": "#456", **at}),
    ]


def test_tiled_drawing_becomes_one_document(spark):
    log = frame(spark, numbered(*_tile(1, 0.0), *_tile(2, -50.0)))
    merged, docs = document_tables(log)
    (doc,) = docs.collect()
    assert (doc["tiles"], doc["width"], doc["height"]) == (2, 90.0, 30.0)
    kinds = [r["kind"] for r in merged.orderBy("order_no").collect()]
    # Both tiles saw the same shapes; each clear ends at its own tile.
    assert kinds == ["shape", "clear", "clear", "shape"]
    settings = load_export_settings(docs).drop("removed_colors", "removed_elements")
    svg = export.svg_documents(merged, settings, tiles.GROUP).first()["svg"]
    assert svg.count("<mask id=") == 2 and 'transform="matrix(1 0 0 1 50 0)"' in svg
    eps = export.eps_documents(merged, settings, tiles.GROUP).first()["eps"]
    assert eps.count("% clearRect exclusion") == 2 and "50 0 moveto" in eps
    stats = export.document_stats(merged, settings, tiles.GROUP).first()
    assert (stats["shapes"], stats["gap_fillers"]) == (2, 0)


def test_gaps_go_before_their_anchor():
    assert tiles._join_gaps(list("pqr"), list("xqyzrw")) == list("pxqyzrw")
    assert tiles._join_gaps(list("pq"), list("qp")) == list("pqp")
    assert tiles._join_gaps([], list("ab")) == list("ab")


def test_deep_and_broken_markup(spark):
    deep = "<svg>" + "<g>" * 3000 + '<path d="M0 0" id="x"/>' + "</g>" * 3000 + "</svg>"
    df = spark.createDataFrame([("s", "deep", deep), ("s", "broken", "<svg><path"), ("s", "none", None)], "session_id string, svg_id string, markup string")
    assert [(r["svg_id"], r["dom_id"]) for r in vector_elements(df).collect()] == [("deep", "x")]
    none = spark.createDataFrame([], "session_id string, svg_id string, element_id string")
    chosen = spark.createDataFrame([("s", "deep", "x")], "session_id string, svg_id string, element_id string")
    colors = none.withColumnRenamed("element_id", "color")
    out = {r["svg_id"]: r["markup"] for r in edit_markup(df, chosen, colors).collect()}
    assert "<path" not in out["deep"] and out["broken"] == "<svg><path"
