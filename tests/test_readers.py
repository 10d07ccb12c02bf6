"""Reading batches: every line and element is either a log row or a refused row with its reason."""

import json

from drawlog.sources import readers
from drawlog.sources.staging import stage_path


def test_bad_lines_have_a_reason(spark):
    good = {"session_id": "s", "frame_id": "f", "canvas_id": "c", "sequence": 1, "type": "fill_rect", "args": [1, 2.5, 3e0, 4], "transform": [1, 0, 0, 1, 0, 0], "context_type": "2d", "value": True}
    other = {**good, "sequence": 2, "width": None, "transform": [1, 2], "command": {"type": "move_to", "args": [0, 1]}, "value": {"source_path_id": "p"}}
    lines = [
        json.dumps([good, other]),
        "not json",
        '{"a": 1}',
        "[]",
        "",
        "   ",
        json.dumps([good, 7, None, "x", {**good, "sequence": "three"}, {**good, "args": ["a"], "width": "w"}, {}]),
        "[1, 2",
        '"text"',
    ]
    path = stage_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    log = readers.read_draw_log(spark, path)
    got = {(r.position, r.sequence, r.type, tuple(r.args or ()), tuple(r.transform or ()), r.value) for r in log.collect()}
    assert got == {
        (0, 1, "fill_rect", (1.0, 2.5, 3.0, 4.0), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "true"),
        (1, 2, "fill_rect", (1.0, 2.5, 3.0, 4.0), (), '{"source_path_id":"p"}'),
        (6, None, None, (), (), None),
    }
    assert log.count() == 4
    bad = sorted((r.reason, r.position if r.position is not None else -1, r.text) for r in readers.rejected_draw_log(spark, path).collect())
    assert [(r, p) for r, p, _ in bad] == [("not JSON", -1), ("not JSON", -1), ("not an array", -1), ("not an array", -1), ("not an object", 1), ("not an object", 2), ("not an object", 3), ("type of sequence", 4), ("type of width, args", 5)]
    assert {t for r, p, t in bad if p < 0} == {"not json", "[1, 2", '{"a": 1}', '"text"'}


def test_an_event_is_parsed_once_for_all_its_fields(spark, tmp_path):
    (tmp_path / "log.txt").write_text('[{"session_id": "s", "width": true}, {"session_id": "s", "sequence": 1}]\n')
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        log = readers.read_draw_log(spark, str(tmp_path))
        plan = log._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("parse_json") + plan.count("parseJson") <= 4, plan
    assert [r["sequence"] for r in log.collect()] == [1]
