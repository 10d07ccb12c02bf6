import random

import pytest
from events import frame, numbered, random_log
from fold import IDENT, fold

from drawlog.operators import paths, surface
from drawlog.operators.running import Run, running
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 64), (3, None)])
def test_spark_matches_the_sequential_fold(spark, seed, block):
    rows = random_log(seed)
    canvases, refs = fold(rows, cap=9)
    log = frame(spark, rows)
    resolved = paths.path_lineage(log, block)
    texts = {r["sequence"]: r["d"] for r in resolved.collect()}
    assert {k: v for k, v in texts.items() if v} == {k: v for k, v in refs.items() if v}
    s = surface.surface_log(log, resolved, block)
    n = surface.numbered_log(s, block)
    table = surface.paints(log, n, 9, resolved, block).orderBy("canvas_id", "order_no").collect()
    got = {}
    for p in table:
        clip = None if p["clip_d"] is None else (p["clip_d"], list(p["clip_transform"]))
        got.setdefault(p["canvas_id"], []).append((p["kind"], p["d"], p["paint"], clip))
    want = {c: v.ops for c, v in canvases.items() if v.ops}
    assert got == {c: [(k, d, f, None if cl is None else (cl[0], list(cl[1]))) for k, d, f, cl in ops] for c, ops in want.items()}
    errors = {r["canvas_id"]: r["errors"] for r in surface.error_count(n, 9).collect()}
    assert errors == {c: v.errors for c, v in canvases.items()}
    state = {r["canvas_id"]: (r["width"], r["height"], r["visible"], r["revision"]) for r in surface.state_of(s).collect()}
    assert state == {c: (v.w, v.h, v.visible, v.revision) for c, v in canvases.items()}
    raw = {r["canvas_id"]: (r["width"], r["height"], r["visible"], r["revision"]) for r in surface.surface_state(log).collect()}
    assert raw == state


def test_running_values_do_not_depend_on_the_block_size(spark):
    r = random.Random(5)
    rows = [(k, i, r.choice([None, -2, 1, 1, 3]), r.choice([-1, 1, 0])) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint, s bigint")
    runs = {
        "sum": Run("sum", F.col("v")),
        "low": Run("min", F.col("v")),
        "before": Run("last", F.col("v"), inclusive=False),
        "depth": Run("depth", F.col("s")),
    }
    got = {(x["k"], x["i"]): x for x in running(df, ["k"], ["i"], F.floor(F.col("i") / 9), runs).collect()}
    for k in ("a", "b"):
        total, low, last, depth = 0, None, None, 0
        for _, i, v, s in [x for x in rows if x[0] == k]:
            before = last
            if v is not None:
                total, low, last = total + v, v if low is None else min(low, v), v
            depth = max(depth + s, 0)
            x = got[(k, i)]
            assert (x["sum"], x["low"], x["before"], x["depth"]) == (total, low, before, depth)


def test_later_edits_do_not_change_earlier_paints(spark):
    cmd = lambda t, *a: ("path_command", {"path_id": "p", "command": {"type": t, "args": list(a)}})
    rows = numbered(
        ("canvas_created", {"width": 100.0, "height": 100.0}), cmd("move_to", 0.0, 0.0), cmd("line_to", 10.0, 0.0),
        cmd("line_to", 10.0, 10.0), ("fill", {"path_id": "p"}), cmd("begin_path"), cmd("move_to", 0.0, 0.0), cmd("line_to", 0.0, 20.0),
        ("fill", {"path_id": "p"}),
    )
    log = frame(spark, rows)
    n = surface.numbered_log(surface.surface_log(log))
    got = [r["d"] for r in surface.paints(log, n).orderBy("order_no").collect()]
    assert got == ["M 0 0 L 10 0 L 10 10 Z", "M 0 0 L 0 20 Z"]


def test_append_with_matrix_moves_the_first_point(spark):
    cmd = lambda t, *a: ("path_command", {"path_id": "p", "command": {"type": t, "args": list(a)}})
    ref = {"path_id": "q", "value": '{"source_path_id": "p"}', "transform": [0.0, 1.0, -1.0, 0.0, 100.0, 200.0]}
    rows = numbered(cmd("move_to", 0.0, 0.0), cmd("line_to", 10.0, 0.0), cmd("quadratic_curve_to", 1.0, 2.0, 3.0, 4.0), ("path_append", ref))
    d = paths.path_lineage(frame(spark, rows)).first()["d"]
    assert d == "M 100 200 L 100 210 Q 98 201 96 203"


def test_clip_ends_with_its_restore(spark):
    rows = numbered(
        ("canvas_created", {"width": 9.0, "height": 9.0}), ("save", {}),
        ("path_command", {"path_id": "p", "command": {"type": "rect", "args": [0.0, 0.0, 5.0, 5.0]}}), ("clip", {"path_id": "p"}),
        ("fill_rect", {"args": [0.0, 0.0, 1.0, 1.0]}), ("restore", {}), ("fill_rect", {"args": [2.0, 2.0, 1.0, 1.0]}),
    )
    log = frame(spark, rows)
    n = surface.numbered_log(surface.surface_log(log))
    clips = [r["clip_d"] for r in surface.paints(log, n).orderBy("order_no").collect()]
    assert clips == ["M 0 0 h 5 v 5 h -5 Z", None]
    assert IDENT[0] == 1.0


def copy_of(kind, target, source, **kw):
    return (kind, {"path_id": target, "value": '{"source_path_id": "%s"}' % source, "canvas_id": None, **kw})


def command(path, name, *args):
    return ("path_command", {"path_id": path, "command": {"type": name, "args": list(args)}, "canvas_id": None})


def test_long_chain_of_copies_takes_few_rounds(spark, monkeypatch):
    staged, real = [], paths.stage
    monkeypatch.setattr(paths, "stage", lambda df, name: (staged.append(name), real(df, name))[1])
    chain = [copy_of("path_append" if i % 7 == 3 else "path_created", f"p{i}", f"p{i - 1}") for i in range(1, 1001)]
    rows = numbered(command("p0", "move_to", 1.0, 2.0), command("p0", "line_to", 3.0, 4.0), *chain, command("p500", "line_to", 9.0, 9.0))
    got = paths.path_lineage(frame(spark, rows)).orderBy("sequence").collect()
    assert [r["d"] for r in got] == ["M 1 2 L 3 4"] * 1000
    # The current point goes with creations and ends at the first append.
    assert [r["has_current"] for r in got] == [True] * 3 + [False] * 997
    assert staged.count("lineage-round") == 1 and staged.count("lineage-plain") <= 11


def tangled(seed, n, moved):
    """Copies of copies, appends and edits of a few paths; ``moved`` of the appends have a matrix."""
    r = random.Random(seed)
    rows, ids = [("canvas_created", {"width": 100.0, "height": 50.0, "canvas_id": "c"}), command("p0", "move_to", 1.0, 1.0)], ["p0"]
    for i in range(n):
        kind = r.choices(["copy", "append", "begin", "line", "arc", "fill", "again"], [9, 5, 2, 3, 2, 4, 1])[0]
        p, q = r.choice(ids[-6:]), r.choice(ids[-6:])
        if kind == "copy":
            ids.append(f"p{i + 1}")
            rows.append(copy_of("path_created", ids[-1], q))
        elif kind == "again":
            rows.append(copy_of("path_created", p, q))
        elif kind == "append":
            p = r.choice([p, f"n{i}"])
            ids.append(p)
            rows.append(copy_of("path_append", p, q, transform=[2.0, 0.0, 0.0, 1.0, 3.0, 5.0] if r.random() < moved else None))
        elif kind == "fill":
            rows.append(("fill", {"path_id": p, "canvas_id": "c", "fill_style": "#f00"}))
        else:
            rows.append(command(p, *{"begin": ("begin_path",), "line": ("line_to", float(i), 2.0), "arc": ("arc", 9.0, 9.0, 5.0, 0.0, 1.0, 0.0)}[kind]))
    return numbered(*rows)


def test_tangled_copies_match_the_sequential_fold(spark):
    rows = tangled(1, 70, 0.0)
    canvases, refs = fold(rows, cap=5000)
    log = frame(spark, rows)
    resolved = paths.path_lineage(log, 16)
    texts = {x["sequence"]: x["d"] for x in resolved.collect()}
    assert {k: v for k, v in texts.items() if v} == {k: v for k, v in refs.items() if v}
    n = surface.numbered_log(surface.surface_log(log, resolved, 16), 16)
    got = [p["d"] for p in surface.paints(log, n, 5000, resolved, 16).orderBy("order_no").collect()]
    assert got == [d for _, d, _, _ in canvases["c"].ops]


def test_doubling_and_rounds_agree_on_moved_appends(spark, monkeypatch):
    log = frame(spark, tangled(2, 60, 0.4))
    by_doubling = {x["sequence"]: (x["d"] or "", x["has_current"]) for x in paths.path_lineage(log, 16).collect()}
    real = paths._plain_copies
    monkeypatch.setattr(paths, "_plain_copies", lambda *a: real(*a).limit(0))
    by_rounds = {x["sequence"]: (x["d"] or "", x["has_current"]) for x in paths.path_lineage(log, 16).collect()}
    assert by_doubling == by_rounds and len({d for d, _ in by_rounds.values()}) > 5


def test_nearest_color_meets_neighbours_only(spark, monkeypatch):
    from drawlog.operators import paint

    rng = random.Random(3)
    code = lambda: "#%02x%02x%02x" % tuple(rng.choice([rng.randrange(256), rng.randrange(40)]) for _ in range(3))
    dense = ["#%02x%02x%02x" % (r, g, b) for r in range(12) for g in range(12) for b in range(12)]
    colors = [("a", c) for c in dense] + [("b", code()) for _ in range(60)] + [("b", "#000000")] * 2
    samples = [("a", c) for c in dense] + [(k, code()) for k in "ab" for _ in range(150)] + [("b", None), (None, "#000000"), ("c", "#000000")]
    pairs, within = [], paint._nearest_within

    def counted(want, pal, keys, reach):
        pairs.append((reach, want.count()))
        return within(want, pal, keys, reach)

    monkeypatch.setattr(paint, "_nearest_within", counted)
    got = paint.nearest_color(spark.createDataFrame(colors, "k string, color string"), spark.createDataFrame(samples, "k string, sample string"), ["k"])
    rgb = lambda c: [int(c[i : i + 2], 16) for i in (1, 3, 5)]
    want = set()
    for k, s in {x for x in samples if None not in x}:
        best = min(((sum((a - b) ** 2 for a, b in zip(rgb(s), rgb(c))), c) for o, c in colors if o == k), default=(10**9, ""))
        if best[0] <= 48 * 48:
            want.add((k, s, best[1], best[0]))
    assert {tuple(r) for r in got.select("k", "sample", "color", "distance").collect()} == want
    # Samples of the dense palette are done in the smallest cells.
    assert len(pairs) == 4 and pairs[0][1] > 1700 and pairs[1][1] < 350


def test_one_block_is_read_once_and_gives_what_blocks_give(spark, monkeypatch):
    written = []
    real = surface.stage
    monkeypatch.setattr(surface, "stage", lambda df, name: written.append(name) or real(df, name))
    log = frame(spark, [r for r in random_log(11, 300) if not (r["value"] or "").startswith("{")])
    whole = surface.surface_log(log, written=False)
    # No table between the passes, and none is shuffled for block totals.
    assert not {"paths", "sized", "surface"} & set(written)
    n = surface.numbered_log(whole)
    cut = surface.numbered_log(surface.surface_log(log, block_rows=16), 16)
    assert {"paths", "sized", "surface"} <= set(written)
    rows = lambda df: sorted(map(str, df.select(*sorted(n.columns)).collect()))
    assert rows(n) == rows(cut)
