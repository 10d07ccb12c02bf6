"""Vector asset, feed and admission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.operators import assets as av
from drawlog.operators import feed as fd
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.sources import readers
from drawlog.sources.staging import stage_path

# Markup with six paint elements, one definition and one broken form.
MARKUP = """
SELECT 'rec-' || CAST(doc_id % 15 AS VARCHAR(10)) AS session_id, 'svg-' || CAST(doc_id AS VARCHAR(20)) AS svg_id, doc_id, CAST(100 + doc_id % 50 AS DOUBLE) AS width, CAST(50 AS DOUBLE) AS height, source || '.svg' AS filename,
  CASE WHEN doc_id % 19 = 0 THEN '<svg><path d=' ELSE '<svg xmlns="http://www.w3.org/2000/svg"><defs><path id="hidden" d="M 0 0"/></defs><g fill="#f00" stroke="blue"><path id="p' || CAST(n_chars % 5 AS VARCHAR(10)) || '" d="M 0 0 L ' || CAST(n_chars % 100 AS VARCHAR(10)) || ' 5 Z"/><rect width="5" height="5"/><circle r="2" fill="none"/></g><path d="M 1 1 L 2 2" fill="green" transform="matrix(1 0 0 1 3 4)"/><line id="l" stroke="rgb(1, 2, 3)"/><mask><path d="M 9 9 L 8 8"/></mask></svg>' END AS markup FROM {documents}
"""
ELEMENTS = """SELECT session_id, svg_id, e.n AS element_no, e.tag,
  CASE e.n WHEN 1 THEN 'p' || CAST(n_chars % 5 AS VARCHAR(10)) WHEN 5 THEN 'l' END AS dom_id, e.fill, e.stroke, e.hid AS hidden
FROM (SELECT 'rec-' || CAST(doc_id % 15 AS VARCHAR(10)) AS session_id, 'svg-' || CAST(doc_id AS VARCHAR(20)) AS svg_id, n_chars FROM documents WHERE doc_id % 19 <> 0) m,
 (VALUES (1, 'path', '#f00', 'blue', FALSE), (2, 'rect', '#f00', 'blue', FALSE), (3, 'circle', 'none', 'blue', FALSE), (4, 'path', 'green', NULL, FALSE), (5, 'line', '#000000', 'rgb(1, 2, 3)', FALSE), (6, 'path', '#000000', NULL, TRUE)) e(n, tag, fill, stroke, hid)"""


def markup_assets(spark, sf_dir):
    return spark.sql(MARKUP.format(documents=fx._table(sf_dir, "documents")))


def _updates(spark, sf_dir):
    return fx.view(spark, sf_dir, "svg_asset_updates")


def read_vector_assets(spark, sf_dir):
    path = stage_path(spark, "assets")
    a = _updates(spark, sf_dir)
    a.select(
        F.col("svg_id").alias("svgId"), "width", "height", "shapes", "filename", "markup", F.col("arrival").alias("extraField")
    ).write.json(path)
    return readers.read_vector_assets(spark, path)


def asset_revisions(spark, sf_dir):
    return av.asset_revisions(_updates(spark, sf_dir)).select("svg_id", "arrival", "changed", "revision")


def vector_catalog(spark, sf_dir):
    return av.vector_catalog(_updates(spark, sf_dir))


def vector_elements(spark, sf_dir):
    e = av.vector_elements(markup_assets(spark, sf_dir))
    return e.select("session_id", "svg_id", "element_no", "tag", "dom_id", "fill", "stroke", "hidden")


def element_ids(spark, sf_dir):
    return av.element_ids(av.vector_elements(markup_assets(spark, sf_dir))).select("svg_id", "element_no", "tag", "element_id")


def edit_markup(spark, sf_dir):
    a = markup_assets(spark, sf_dir)
    ids = a.where("doc_id % 3 = 0").select("session_id", "svg_id", F.lit("svg-el-0").alias("element_id"))
    colors = a.where("doc_id % 2 = 0").select("session_id", "svg_id", F.lit("#FF0000").alias("color"))
    edited = av.edit_markup(a.select("session_id", "svg_id", "doc_id", "markup"), ids, colors)
    return av.vector_elements(edited).select("session_id", "svg_id", "element_no", "tag", "dom_id", "fill", "stroke")


def filename_override(spark, sf_dir):
    docs = av.vector_catalog(_updates(spark, sf_dir)).select("session_id", "svg_id", "filename")
    names = docs.where("length(svg_id) % 2 = 0").select("session_id", "svg_id", F.concat(F.lit("my-"), "svg_id").alias("filename"))
    return av.filename_override(docs, names, ["session_id", "svg_id"])


def allocate_unique_filenames(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("row_no"), F.concat("source", F.lit(".svg")).alias("filename"))
    # Files already there: every source's plain name and its number 3.
    stored = d.select(
        F.explode(F.array(F.concat("source", F.lit(".svg")), F.concat("source", F.lit("_3.svg")))).alias("filename")
    ).distinct()
    return av.allocate_unique_filenames(asked, stored)


def _feed(spark, sf_dir):
    return fx.view(spark, sf_dir, "feed_items")


def _seen(spark, sf_dir):
    return _feed(spark, sf_dir).where("position % 8 = 0").select("id")


def load_feed(spark, sf_dir):
    item = F.struct("id", "title", "sort_order", "created_at", "link", F.lit("x").alias("unknown"))
    bodies = (
        _feed(spark, sf_dir)
        .groupBy(F.floor(F.col("position") / 50).alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("position", item.alias("i")))).alias("a"))
        .select(
            "page",
            F.when(F.col("page") % 7 == 3, F.to_json(F.struct(F.lit(False).alias("success"))))
            .when(F.col("page") % 7 == 5, F.lit("no json"))
            .otherwise(F.to_json(F.struct(F.lit(True).alias("success"), F.transform("a", lambda x: x["i"]).alias("data"))))
            .alias("body"),
        )
    )
    return readers.load_feed(bodies).select("page", "position", "id", "title", "sort_order", "created_at", "link")


def feed_dedup(spark, sf_dir):
    return fd.feed_dedup(_feed(spark, sf_dir)).select("id", "title", "position", "sort_order", "created_at")


def feed_order(spark, sf_dir):
    return fd.feed_order(fd.feed_dedup(_feed(spark, sf_dir))).select("id", "sort_order", "created_at", "position")


def unseen_items(spark, sf_dir):
    announced = _feed(spark, sf_dir).where("position % 10 = 1").select("id")
    feed = fd.feed_dedup(_feed(spark, sf_dir))
    return fd.unseen_items(feed, _seen(spark, sf_dir), announced).select("id", "position")


def unread_badge(spark, sf_dir):
    return fd.unread_badge(fd.feed_dedup(_feed(spark, sf_dir)), _seen(spark, sf_dir))


def device_admission(spark, sf_dir):
    d = fd.device_admission(fx.view(spark, sf_dir, "device_log"), max_devices=2)
    return d.select("event_id", "license_key", "device_id", "admitted")


QUERIES = {
    f.__name__: f
    for f in (
        read_vector_assets, asset_revisions, vector_catalog, vector_elements, element_ids, edit_markup, filename_override,
        allocate_unique_filenames, load_feed, feed_dedup, feed_order, unseen_items, unread_badge, device_admission,
    )
}

_REV = [
    ("va", "SELECT * FROM svg_asset_updates WHERE markup LIKE '<svg%'"),
    (
        "vc",
        """SELECT *, coalesce(markup <> lag(markup) OVER w OR width <> lag(width) OVER w OR height <> lag(height) OVER w OR filename <> lag(filename) OVER w, TRUE) AS changed
FROM va WINDOW w AS (PARTITION BY svg_id ORDER BY arrival)""",
    ),
    ("vr", "SELECT *, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY svg_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision FROM vc"),
    ("vl", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY svg_id ORDER BY arrival DESC) AS rn FROM vr WHERE changed) t WHERE rn = 1"),
]
_ELS = [("el", ELEMENTS)]
_FEED = [
    ("fv", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) AS rn FROM feed_items WHERE title IS NOT NULL"),
    ("fdd", "SELECT * FROM fv WHERE rn = 1"),
    ("seen", "SELECT id FROM feed_items WHERE position % 8 = 0"),
]

ORACLE = {
    "read_vector_assets": check_sql("SELECT svg_id, width, height, shapes, filename, markup FROM svg_asset_updates", ["svg_asset_updates"]),
    "asset_revisions": check_sql("SELECT svg_id, arrival, changed, revision FROM vr", ["svg_asset_updates"], _REV),
    "vector_catalog": check_sql(
        "SELECT session_id, svg_id, arrival, width, height, shapes, filename, markup, revision FROM vl", ["svg_asset_updates"], _REV
    ),
    "vector_elements": check_sql("SELECT session_id, svg_id, CAST(element_no AS BIGINT) AS element_no, tag, dom_id, fill, stroke, hidden FROM el", [], _ELS),
    "element_ids": check_sql(
        "SELECT svg_id, CAST(element_no AS BIGINT) AS element_no, tag, coalesce(dom_id, 'svg-el-' || CASE element_no WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END) AS element_id FROM el", [], _ELS
    ),
    "edit_markup": check_sql(
        """SELECT session_id, svg_id, CAST(row_number() OVER (PARTITION BY svg_id ORDER BY element_no) AS BIGINT) AS element_no, tag, dom_id,
  CASE WHEN id % 2 = 0 AND element_no IN (1, 2) THEN 'none' ELSE fill END AS fill, stroke
FROM (SELECT *, CAST(substr(svg_id, 5) AS BIGINT) AS id FROM el) t WHERE NOT (id % 3 = 0 AND element_no = 2)""",
        [],
        _ELS,
    ),
    "filename_override": check_sql(
        "SELECT session_id, svg_id, CASE WHEN length(svg_id) % 2 = 0 THEN 'my-' || svg_id ELSE filename END AS filename FROM vl", ["svg_asset_updates"], _REV
    ),
    "allocate_unique_filenames": """SELECT doc_id AS row_no, source || '.svg' AS filename, source || '_' || CASE WHEN rn >= 3 THEN rn + 1 ELSE rn END || '.svg' AS stored_name
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t""",
    "load_feed": check_sql(
        """SELECT page, position % 50 AS position, id, title, CAST(sort_order AS DOUBLE) AS sort_order, created_at, link FROM (SELECT *, position // 50 AS page FROM feed_items) t WHERE page % 7 NOT IN (3, 5)""",
        ["feed_items"],
    ),
    "feed_dedup": check_sql("SELECT id, title, position, sort_order, created_at FROM fdd", ["feed_items"], _FEED),
    "feed_order": check_sql("SELECT id, sort_order, created_at, position FROM fdd", ["feed_items"], _FEED),
    "unseen_items": check_sql(
        "SELECT id, position FROM fdd WHERE id NOT IN (SELECT id FROM seen) AND id NOT IN (SELECT id FROM feed_items WHERE position % 10 = 1)", ["feed_items"], _FEED
    ),
    "unread_badge": check_sql(
        "SELECT n AS unread, CASE WHEN n > 9 THEN '9+' ELSE CAST(n AS VARCHAR) END AS badge, n = 0 AS hidden FROM (SELECT count(*) AS n FROM fdd WHERE id NOT IN (SELECT id FROM seen)) t", ["feed_items"], _FEED
    ),
    "device_admission": check_sql(
        "SELECT d.event_id, d.license_key, d.device_id, a.n <= 2 AS admitted FROM device_log d JOIN a ON a.license_key = d.license_key AND a.device_id = d.device_id",
        ["device_log"],
        [
            ("f", "SELECT license_key, device_id, min((ts, event_id)) AS first FROM device_log GROUP BY ALL"),
            ("a", "SELECT *, row_number() OVER (PARTITION BY license_key ORDER BY first) AS n FROM f"),
        ],
    ),
}
