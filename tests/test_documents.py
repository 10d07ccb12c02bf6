import random

import pytest
from events import frame, numbered
from pyspark.sql import functions as F

from drawlog.operators import export, segments, surface
from drawlog.operators.assets import allocate_unique_filenames, asset_revisions, edit_markup, vector_elements
from drawlog.schema import SURFACE
from drawlog.sources.readers import load_export_settings
from drawlog.sources.sinks import read_documents, write_documents
from drawlog.sources.staging import stage

BOARD = {"ratio": "1:1", "min_pixels": 360_000.0, "max_pixels": 360_000.0}  # 600 by 600
WIDE, HIGH, SIDE = 240.0, 160.0, 600.0
ALL = [0.0, 0.0, WIDE, HIGH]
BOX = [30.0, 40.0, 50.0, 20.0]


def drawing(spark, *rows, width=WIDE, height=HIGH, **settings):
    log = frame(spark, numbered(("canvas_created", {"width": width, "height": height}), *rows))
    n = surface.numbered_log(surface.surface_log(log))
    docs = surface.state_of(n).select(*SURFACE, "width", "height").withColumns({k: F.lit(v) for k, v in {**BOARD, **settings}.items()})
    return surface.paints(log, n), load_export_settings(docs).drop("removed_colors", "removed_elements")


def placement(box=None, scale=1.0):
    """Nine tenths of the board hold the canvas; the box of the shapes is centered, or the canvas without shapes."""
    s = min(SIDE * 0.9 / WIDE, SIDE * 0.9 / HIGH) * scale
    x, y, w, h = box or (0.0, 0.0, WIDE, HIGH)
    numbers = SIDE / 2 - (x + w / 2) * s, SIDE / 2 - (y + h / 2) * s, s
    return "translate({:g} {:g}) scale({:g})".format(*numbers)


def svg_of(spark, *rows, **kw):
    return export.svg_documents(*drawing(spark, *rows, **kw), SURFACE).first()["svg"]


def test_placement_follows_the_shapes_or_the_canvas(spark):
    box = ("fill_rect", {"args": BOX})
    assert placement(BOX) in svg_of(spark, box)
    assert placement(scale=1.5) in svg_of(spark, artwork_scale=1.5)
    assert '<rect id="background-color" width="600" height="600" fill="#ffffff"/>' in svg_of(spark, box)
    assert 'id="background' not in svg_of(spark, box, transparent_background=True)
    # A stroke that its clip hides does not count.
    hidden = [
        ("path_command", {"path_id": "k", "command": {"type": "rect", "args": [0.0, 0.0, 10.0, 10.0]}}),
        ("save", {}),
        ("clip", {"path_id": "k"}),
        ("stroke_rect", {"args": [700.0, 20.0, 40.0, 40.0]}),
        ("restore", {}),
    ]
    assert placement(BOX) in svg_of(spark, *hidden, box)


def test_clears_cut_earlier_paints_only(spark):
    hole = lambda x: ("clear_rect", {"args": [x, 10.0, 25.0, 30.0]})
    paint = lambda c: ("fill_rect", {"args": ALL, "fill_style": c})
    table, docs = drawing(spark, paint("#010203"), hole(20.0), paint("#040506"), hole(90.0), paint("#070809"))
    svg = export.svg_documents(table, docs, SURFACE).first()["svg"]
    body = svg[svg.index('<g id="artwork"') :]
    marks = [body.index(x) for x in ('<g mask="url(#clear-2)">', '<g mask="url(#clear-1)">', "#010203", "</g>", "#040506")]
    assert marks == sorted(marks)
    assert body.index("#040506") < body.index("</g>", marks[3] + 1) < body.index("#070809")
    assert 'x="-1" y="-1" width="242" height="162"' in svg
    eps = export.eps_documents(table, docs, SURFACE).first()["eps"]
    parts = eps.split("gsave\n")
    # The first paint carries both clears, the second one the later clear, the last none.
    assert eps.count("% clearRect exclusion") == 3
    assert "115 10 lineto" in eps and "45 10 lineto" in eps and len(parts) > 3


def test_eps_page_and_colors(spark):
    rows = [("fill_rect", {"args": BOX, "fill_style": c}) for c in ("#0000ff", "transparent", "#00ff00")]
    table, docs = drawing(spark, *rows)
    r = export.eps_documents(table, docs, SURFACE).first()
    assert (r["art_width"], r["art_height"], r["art_ratio"]) == (600, 600, "1:1")
    lines = r["eps"].splitlines()
    assert lines[0].startswith("%!PS-Adobe") and lines[-1] == "%%EOF"
    assert "%%BoundingBox: 0 0 600 600" in lines and "0 600 translate" in lines
    assert [x for x in lines if x.endswith("setrgbcolor")][-2:] == ["0 0 1 setrgbcolor", "0 1 0 setrgbcolor"]
    assert lines.count("newpath") == 2


def test_eps_documents_broadcast_nothing(spark, monkeypatch):
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    for module in (surface, export):
        monkeypatch.setattr(module, "stage", noted)
    path = [("path_command", {"path_id": "k", "command": {"type": "rect", "args": BOX}}), ("save", {}), ("clip", {"path_id": "k"})]
    paint = lambda c: ("fill_rect", {"args": BOX, "fill_style": c})
    rows = [*path, paint("#0a0b0c"), paint("#0000ff"), ("clear_rect", {"args": BOX}), ("restore", {}), paint("#00ff00"), ("fill", {"path_id": "k"})]
    log = stage(frame(spark, numbered(("canvas_created", {"width": WIDE, "height": HIGH}), *rows)), "log")
    n = surface.numbered_log(surface.surface_log(log))
    docs = surface.state_of(n).select(*SURFACE, "width", "height").withColumns({k: F.lit(v) for k, v in BOARD.items()})
    docs = stage(load_export_settings(docs.join(surface.error_count(n).hint("merge"), SURFACE)), "docs")
    ids = docs.select("canvas_id", F.lit("shape-3").alias("element_id"))
    colors = docs.select("canvas_id", F.lit("#0A0B0C").alias("color"))
    out = export.eps_documents(surface.paints(log, n), docs, SURFACE, ids, colors)
    plans["eps"] = out._jdf.queryExecution().executedPlan().toString()
    assert {"numbered", "texts", "paints", "kept", "clears", "exclusions"} < set(plans)
    assert [k for k, v in plans.items() if "Broadcast" in v] == []
    eps = out.first()["eps"]
    assert [x for x in eps.splitlines() if x.endswith("setrgbcolor")][1:] == ["0 0 1 setrgbcolor", "0 0 0 setrgbcolor"]
    assert eps.count("% clearRect exclusion") == 1


def test_removed_colors_leave_the_document(spark):
    table, docs = drawing(spark, *[("fill_rect", {"args": BOX, "fill_style": c}) for c in ("#0a0b0c", "olive", "rgb(10, 11, 12)")])
    gone = spark.createDataFrame([("#0A0B0C",)], "color string")
    svg = export.svg_documents(table, docs, SURFACE, removed_colors=gone).first()["svg"]
    assert "#0a0b0c" not in svg and "rgb(10" not in svg and 'id="shape-2"' in svg


def test_wrapped_asset(spark):
    markup = '<svg><path id="k" d="M3 4 L30 40" fill="#00f" stroke="#0f0" transform="matrix(1 0 0 3 7 9)"/></svg>'
    a = spark.createDataFrame([("s", "v", 80.0, 20.0, "w.svg", markup)], "session_id string, svg_id string, width double, height double, filename string, markup string")
    a = a.withColumns({**{k: F.lit(v) for k, v in BOARD.items()}, "background_color": F.lit("#0a0b0c"), "artwork_scale": F.lit(1.0)})
    a = load_export_settings(a).drop("removed_colors", "removed_elements")
    r = export.wrapped_vector_documents(a).first()
    assert (r["art_width"], r["art_height"], r["art_ratio"]) == (600, 600, "1:1")
    assert 'fill="#0a0b0c"' in r["text"] and f"scale({600 * 0.9 / 80:g})" in r["text"]
    eps = export.wrapped_vector_documents(a, fmt="eps").first()["text"]
    steps = ["[1 0 0 3 7 9] concat", "0 0 1 setrgbcolor", "3 4 moveto", "30 40 lineto", "fill", "0 1 0 setrgbcolor", "stroke"]
    found = [eps.index(x, eps.index(steps[0])) for x in steps]
    assert found == sorted(found)


def test_postscript_of_curves(spark):
    start, corner, inner, outer, turn, pull, end = (3, 7), (12, 7), (14, 9), (17, 18), (21, 25), (27, 31), (33, 16)
    at = lambda *points: " ".join(f"{x} {y}" for x, y in points)
    d = f"M {at(start)} L {at(corner)} C {at(inner, outer, turn)} Q {at(pull, end)} Z"
    df = spark.createDataFrame([(d,), ("M 0 0 A 5 5 0 0 1 10 0",), ("M 0 0 X",)], "d string")
    got = {r["d"]: r["ps"] for r in segments.postscript_texts(df).collect()}
    # A quadratic curve is the cubic one whose handles reach two thirds of the way to its control point.
    handles = [tuple(p + 2 * (q - p) // 3 for p, q in zip(point, pull)) for point in (turn, end)]
    assert all((q - p) % 3 == 0 for point in (turn, end) for p, q in zip(point, pull))
    assert got[d] == f"{at(start)} moveto\n{at(corner)} lineto\n{at(inner, outer, turn)} curveto\n{at(*handles, end)} curveto\nclosepath\n"
    assert got["M 0 0 A 5 5 0 0 1 10 0"].endswith("10 0 curveto\n") and "M 0 0 X" not in got


def test_tight_boxes(spark):
    df = spark.createDataFrame(
        [(1, "M 0 0 C 0 10 10 10 10 0"), (2, "M 0 0 A 5 5 0 0 1 10 0"), (3, "M 900 900 M 0 0 L 1 1"), (4, "M 0 0 7")], "i int, d string"
    ).withColumn("transform", F.lit(None).cast("array<double>"))
    got = {r["i"]: r for r in segments.tight_boxes(df, ["i"]).collect()}
    assert got[1]["max_y"] == pytest.approx(7.5)
    # A half circle above the x axis in screen coordinates.
    assert got[2]["min_y"] == pytest.approx(-5.0, abs=1e-3) and got[2]["max_y"] == pytest.approx(0.0, abs=1e-9)
    assert got[3]["max_x"] == 1.0
    assert got[4]["readable"] is False


def first_free(asked, stored):
    taken, out = set(stored), []
    for name in asked:
        stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
        k, cand = 0, name
        while cand in taken:
            k += 1
            cand = f"{stem}_{k}{dot}{ext}"
        taken.add(cand)
        out.append(cand)
    return out


def stored_names(spark, asked, stored, span):
    df = spark.createDataFrame(list(enumerate(asked)), "row_no long, filename string")
    got = allocate_unique_filenames(df, spark.createDataFrame([(s,) for s in stored], "filename string"), span=span)
    return [r["stored_name"] for r in got.orderBy("row_no").collect()]


def test_file_names_match_first_free(spark):
    asked = ["a.svg", "a.svg", "a_1.svg", "a.svg", "b.svg", "a_1.svg", "b.svg", "c"]
    stored = {"a_2.svg", "b.svg", "b_1.svg"}
    assert stored_names(spark, asked, stored, 2) == first_free(asked, stored)


@pytest.mark.parametrize("seed", range(4))
def test_file_names_in_chains(spark, seed):
    """Names that are numbers of each other, three levels deep, in any order and beside stored files."""
    rng = random.Random(seed)
    stems = ["a"] * 6 + [f"a_{k}" for k in (1, 2, 3, 5, 8, 9, 12)] * 2 + ["a_1_1", "a_1_2", "a_2_1", "a_1_1_1", "a_1_1_2", "b_1", "b_3", "a_01", "_1", "b"]
    asked = [rng.choice(stems) + rng.choice([".svg"] * 5 + [".eps", ""]) for _ in range(150)]
    stored = {rng.choice(["a", "a_4", "a_7", "a_2", "a_1_3", "a_1_1_1", "b"]) + ".svg" for _ in range(4)}
    assert stored_names(spark, asked, stored, 1 + seed * 3) == first_free(asked, stored)


def many_paints(spark):
    """Three drawings with settings: paints and clipped clears; its strokes alone; nothing."""
    r = random.Random(5)
    at = lambda: [float(r.randrange(200)), float(r.randrange(120)), float(r.randrange(1, 40)), float(r.randrange(1, 40))]
    first = [("path_command", {"path_id": "k", "command": {"type": "rect", "args": at()}}), ("clip", {"path_id": "k"})]
    for i in range(60):
        first.append(("clear_rect" if i % 9 == 4 else "stroke_rect" if i % 4 == 1 else "fill_rect", {"args": at(), "fill_style": f"#{i:06x}"}))
    table, docs = drawing(spark, *first)
    lines = table.where("kind = 'stroke'").withColumn("session_id", F.lit("lines"))
    others = docs.withColumn("session_id", F.explode(F.array(F.lit("lines"), F.lit("nothing"))))
    return stage(table.unionByName(lines), "table"), stage(docs.unionByName(others), "docs")


def test_chunks_make_up_the_documents(spark, tmp_path):
    table, docs = many_paints(spark)
    size = 300
    for kind, whole, cut in (("svg", export.svg_documents, export.svg_chunks), ("eps", export.eps_documents, export.eps_chunks)):
        want = {r["session_id"]: r[kind] for r in whole(table, docs, SURFACE).collect()}
        assert len(want) == 3
        chunks = stage(cut(table, docs, SURFACE, chunk_chars=size, block_rows=4), "chunks")
        got, most = {}, 0
        for r in chunks.orderBy("session_id", "chunk").collect():
            start = len(got.setdefault(r["session_id"], ""))
            assert r["chunk"] * size <= start < (r["chunk"] + 1) * size
            got[r["session_id"]] += r["text"]
            most = max(most, r["chunk"])
        assert got == want and most > 10
        named = chunks.withColumn("stored_name", F.concat("session_id", F.lit(f".{kind}")))
        write_documents(named, str(tmp_path), kind, chunk="chunk")
        files = {r["filename"]: r["document"] for r in read_documents(spark, str(tmp_path), kind).collect()}
        assert files == {f"{k}.{kind}": v for k, v in want.items()}
        print(kind, "checked")
    with pytest.raises(Exception, match="two documents are named"):
        write_documents(named.withColumn("stored_name", F.lit("one")), str(tmp_path), "eps", chunk="chunk")


def test_chunks_of_ties_and_empty_texts(spark):
    rows = [("a", 0, 1, "x" * 7), ("a", 0, 1, "x" * 7), ("a", 1, -2, "b"), ("a", 1, -1, ""), ("a", 1, 70_000, "c"), ("b", 0, 0, None)]
    df = spark.createDataFrame(rows, "k string, part int, order_no long, text string")
    got = {(r["k"], r["chunk"]): r["text"] for r in export.document_chunks(df, ["k"], 5).collect()}
    assert got == {("a", 0): "x" * 7, ("a", 1): "x" * 7, ("a", 2): "b", ("a", 3): "c"}
    assert export.document_chunks(df.limit(0), ["k"]).count() == 0


def test_documents_are_files(spark, tmp_path):
    docs = spark.createDataFrame([("a.svg", "<svg>é</svg>"), ("_b.svg", ""), ("c d%20.svg", None), (".e", "x\ny\n")], "stored_name string, text string")
    write_documents(docs, str(tmp_path), "svg")
    write_documents(docs.limit(0), str(tmp_path), "svg")
    write_documents(docs.withColumn("stored_name", F.concat(F.lit("2"), "stored_name")), str(tmp_path), "svg")
    want = {"a.svg": "<svg>é</svg>", "_b.svg": "", "c d%20.svg": "", ".e": "x\ny\n"}
    got = {r["filename"]: r["document"] for r in read_documents(spark, str(tmp_path), "svg").collect()}
    assert got == want | {"2" + k: v for k, v in want.items()}
    assert sorted(f.name for f in (tmp_path / "svg").glob("part-*/*")) == sorted(got)


@pytest.mark.parametrize("bad", ["a.svg", "", "../up.svg", None])
def test_failed_documents_leave_no_file(spark, tmp_path, bad):
    rows = [(f"{n}.svg", "x") for n in "abcdefgh"] + [(bad, "y")]
    docs = spark.createDataFrame(rows, "stored_name string, text string").repartition(4)
    with pytest.raises(Exception, match="file name|are named"):
        write_documents(docs, str(tmp_path), "svg")
    assert [f for f in tmp_path.rglob("*") if f.is_file()] == []


def test_asset_sent_twice_then_changed(spark):
    rows = [("s", "v", i, 320.0, 240.0, n, "f.svg", m) for i, (n, m) in enumerate([(1, "<svg>a</svg>"), (2, "<svg>a</svg>"), (2, "<svg>b</svg>")])]
    df = spark.createDataFrame(rows, "session_id string, svg_id string, arrival long, width double, height double, shapes long, filename string, markup string")
    got = asset_revisions(df, span=2).orderBy("arrival").collect()
    assert [(r["changed"], r["revision"]) for r in got] == [(True, 1), (False, 1), (True, 2)]


def test_edit_markup(spark):
    a = spark.createDataFrame([("s", "v", '<svg xmlns="http://www.w3.org/2000/svg"><g fill="red"><rect/><path id="x" d="M0 0"/></g><line stroke="red"/></svg>')], "session_id string, svg_id string, markup string")
    key = spark.createDataFrame([("s", "v")], "session_id string, svg_id string")
    out = edit_markup(a, key.withColumn("element_id", F.lit("svg-el-0")), key.withColumn("color", F.lit("#ff0000")))
    rows = vector_elements(out).orderBy("element_no").collect()
    assert [(r["tag"], r["fill"], r["stroke"]) for r in rows] == [("path", "none", None), ("line", "#000000", "none")]
