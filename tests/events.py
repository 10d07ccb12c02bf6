"""Small event tables for the tests."""

from __future__ import annotations

import random

from drawlog.schema import EVENT


def event(sequence, kind, **kw):
    row = {f: None for f in EVENT.fieldNames()}
    row.update(session_id="s", frame_id="f", canvas_id="c", sequence=sequence, type=kind)
    row.update(kw)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in EVENT.fieldNames()) for r in rows], EVENT)


def numbered(*rows):
    """Events from (kind, fields) pairs, numbered from 1."""
    return [event(i, k, **kw) for i, (k, kw) in enumerate(rows, 1)]


def random_log(seed: int, n: int = 900):
    """One frame with two canvases, deep save stacks, clips, clears, copies and appends."""
    r = random.Random(seed)
    rows = [event(1, "canvas_created", canvas_id="f-canvas-1", width=100.0, height=50.0)]
    ids = ["p0"]
    for i in range(2, n):
        canvas = r.choice(["f-canvas-1", "f-canvas-2"])
        kind = r.choices(
            ["fill_rect", "stroke_rect", "save", "restore", "clip", "fill", "stroke", "clear_rect", "path_command",
             "canvas_resized", "canvas_created", "canvas_visibility", "path_created", "path_append", "set_transform"],
            [8, 6, 9, 7, 6, 8, 6, 6, 26, 1, 1, 2, 3, 3, 2],
        )[0]
        pid = r.choice(ids + ["unknown"])
        m = r.choice([None, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [2.0, 0.0, 0.0, -1.0, 3.0, 50.0]])
        kw = {"canvas_id": canvas, "transform": m}
        num = lambda: round(r.uniform(-20, 120), 3)
        if kind in ("fill_rect", "stroke_rect"):
            kw["args"] = [num() for _ in range(r.choice([4, 4, 4, 4, 3]))]
        elif kind == "clear_rect":
            kw["args"] = r.choice([[-1.0, -1.0, 500.0, 500.0], [num(), num(), num(), 10.0], [0.0, 0.0, 0.0, 5.0]])
        elif kind in ("fill", "stroke", "clip"):
            kw["path_id"] = None if kind == "clip" and r.random() < 0.1 else pid
        elif kind == "path_command":
            name, n_args = r.choice(
                [("move_to", 2), ("line_to", 2), ("line_to", 2), ("bezier_curve_to", 6), ("quadratic_curve_to", 4),
                 ("close_path", 0), ("rect", 4), ("arc", 6), ("begin_path", 0)]
            )
            args = [num() for _ in range(n_args)]
            if name == "arc":
                args = [num(), num(), 5.0, 0.0, r.choice([1.0, 4.0, 6.283185307179586]), r.choice([0.0, 1.0])]
            kw.update(path_id=r.choice(ids), command={"type": name, "args": args}, canvas_id=None)
        elif kind == "path_created":
            new = f"q{i}"
            value = r.choice(["M 1 1 L 2 2", "", None, '{"source_path_id": "%s"}' % pid])
            kw.update(path_id=new, value=value, canvas_id=None)
            ids.append(new)
        elif kind == "path_append":
            kw.update(path_id=r.choice(ids), value='{"source_path_id": "%s"}' % r.choice(ids), canvas_id=None, transform=None)
        elif kind == "canvas_visibility":
            kw["value"] = r.choice(["true", "false"])
        elif kind in ("canvas_resized", "canvas_created"):
            kw.update(width=r.choice([None, 80.0, 0.5]), height=r.choice([None, 60.0]))
        if kind in ("fill", "fill_rect"):
            kw["fill_style"] = r.choice([None, "#f00", "url(#g)"])
        rows.append(event(i, kind, **kw))
    return rows
