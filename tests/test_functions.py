import pytest
from pyspark.sql import functions as F

from drawlog.functions import color, geometry, rules, sizing, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_fmt4(spark):
    values = [10.0, 1.23456, -0.00001, 0.00005, -0.00005, float("nan"), float("inf"), None, 100.5, -2.50004]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(text.fmt4(F.col("v"))).collect()]
    assert got == ["10", "1.2346", "0", "0.0001", "-0.0001", "0", "0", None, "100.5", "-2.5"]


@pytest.mark.parametrize(
    "paint,rgb,hex_color",
    [
        ("#ffffff", (1, 1, 1), "#FFFFFF"),
        ("#000", (0, 0, 0), "#000000"),
        ("rgb(255, 0, 0)", (1, 0, 0), "#FF0000"),
        (" White ", (1, 1, 1), "#FFFFFF"),
        ("green", (0, 1, 0), "#008000"),
        ("none", None, None),
        ("transparent", None, None),
        ("#12", None, None),
        ("rebeccapurple", (0, 0, 0), "#663399"),
        ("hsl(120, 100%, 50%)", (0, 0, 0), "#00FF00"),
        ("rgb(50%, 0%, 100%)", (0.5, 0, 1), "#8000FF"),
        ("currentColor", (0, 0, 0), None),
        ("var(--x)", (0, 0, 0), None),
    ],
)
def test_paints(spark, paint, rgb, hex_color):
    r = one(spark, color.parse_paint_rgb(F.lit(paint)).alias("c"), color.normalize_paint_hex(F.lit(paint)).alias("h"))
    assert (None if r["c"] is None else tuple(r["c"])) == rgb
    assert r["h"] == hex_color


def test_names(spark):
    names = ["a/b.svg", "x", "..", "", "c:d.SVG", "n.eps", "dir/"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    c = F.col("n")
    rows = df.select(
        text.safe_filename(c), text.safe_filename(c, "eps"), text.safe_filename(c, "eps", chosen=True)
    ).collect()
    assert [r[0] for r in rows] == ["b.svg", "x.svg", "vectorized-result.svg", "vectorized-result.svg", "c_d.SVG", "n.eps.svg", "dir.svg"]
    assert [r[1] for r in rows] == ["b.eps", "x.eps", "vectorized-result.eps", "vectorized-result.eps", "c_d.eps", "n.eps", "dir.eps"]
    assert rows[5][2] == "n.eps"


def test_artboards(spark):
    cases = [
        (100.0, 100.0, "4:3", 15e6, 65e6), (100.0, 50.0, "14:10", 15e6, 65e6), (100.0, 50.0, "1:1", 10_000.0, 10_000.0),
        (100.0, 100.0, "source", 15e6, 65e6), (9000.0, 9000.0, "bad", 1e6, 2e6),
    ]
    df = spark.createDataFrame(cases, "width double, height double, ratio string, min_pixels double, max_pixels double")
    a, b, c, d, e = sizing.with_artboard(df).collect()
    assert a["art_width"] * 3 == a["art_height"] * 4 and a["art_ratio"] == "4:3"
    assert b["art_ratio"] == "7:5" and 15e6 <= b["art_width"] * b["art_height"] <= 65e6
    # A maximum that is not above the minimum falls back, so the nearest step to the minimum is taken.
    assert (c["art_width"], c["art_height"], c["art_ratio"]) == (100, 100, "1:1")
    assert (d["art_width"], d["art_ratio"]) == (3873, "source")
    assert e["art_width"] * e["art_height"] <= 2e6


def test_validation_of_settings_and_assets(spark):
    bad = spark.createDataFrame(
        [("a", 1.0, 1.0, 1, "f", " <svg/>"), ("", 1.0, 1.0, 1, "f", "<svg/>"), ("a", 0.0, 1.0, 1, "f", "<svg/>"), ("a", 1.0, 1.0, 100_001, "f", "<svg/>"), ("a", 1.0, 1.0, 1, "f", "x")],
        "svg_id string, width double, height double, shapes long, filename string, markup string",
    )
    assert [r["reason"] for r in rules.validate_vector_asset(bad).collect()] == [None, "id", "dimensions", "payload", "payload"]


def test_arc_text(spark):
    args = F.array(*[F.lit(v) for v in (0.0, 0.0, 5.0, 0.0, 6.283185307179586)])
    got = one(spark, geometry.render_path_command(F.lit("arc"), args, F.lit(False)).alias("d"))["d"]
    assert got == "M 5 0 A 5 5 0 1 1 -5 0 A 5 5 0 1 1 5 0"


def test_fmt4_writes_whole_numbers_as_it_writes_others(spark):
    values = [0.0, -0.0, 7.0, -7.0, 120.0, 99999999999.0, 1e11, 123456789012345.0, -1e15, 1e-9, float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(text.fmt4(F.col("v"))).collect()]
    assert got == ["0", "0", "7", "-7", "120", "99999999999", "100000000000", "123456789012345", "-1000000000000000", "0", "0"]
