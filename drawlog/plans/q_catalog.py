"""Catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlog.operators import catalog as ct
from drawlog.operators import paths
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.plans.q_surface import ERRORS, PAINT_STEPS
from drawlog.sources.staging import stage


def canvas_catalog(spark, sf_dir):
    return ct.canvas_catalog(stage(fx.draw_log(spark, sf_dir), "log"))


def catalog_order(spark, sf_dir):
    return ct.catalog_order(canvas_catalog(spark, sf_dir), only_painted=True)


def primary_surface(spark, sf_dir):
    return ct.primary_surface(canvas_catalog(spark, sf_dir), by=["session_id"])


def asset_counts(spark, sf_dir):
    from drawlog.operators.assets import vector_catalog

    vectors = vector_catalog(fx.view(spark, sf_dir, "svg_asset_updates"))
    return ct.asset_counts(canvas_catalog(spark, sf_dir), vectors)


def path_lineage(spark, sf_dir):
    log = stage(fx.lineage_log(spark, sf_dir), "lineage-log")
    return paths.path_lineage(log)


QUERIES = {f.__name__: f for f in (canvas_catalog, catalog_order, primary_surface, asset_counts, path_lineage)}

_CAT = PAINT_STEPS + [
    ERRORS(5000),
    (
        "cat",
        """SELECT s.session_id, s.canvas_id, s.width, 100.0::DOUBLE AS height, s.revision, count(CASE WHEN p.kind = 'shape' THEN 1 END) AS shapes, count(CASE WHEN p.kind = 'stroke' THEN 1 END) AS gap_fillers, s.errors, 'RECORDING' AS state
FROM (SELECT c0.session_id, c0.canvas_id, arg_max(now_width, sequence) AS width, count(*) AS revision, any_value(er.errors) AS errors,
        coalesce(arg_max(k % 2 = 0, CASE WHEN type = 'canvas_visibility' THEN sequence END), TRUE) AS visible
      FROM c0 JOIN er ON er.canvas_id = c0.canvas_id GROUP BY c0.session_id, c0.canvas_id) s LEFT JOIN cur p ON p.canvas_id = s.canvas_id WHERE s.visible GROUP BY ALL""",
    ),
]
_CAT_COLS = "session_id, canvas_id, width, height, revision, shapes, gap_fillers, errors, state"
_VALID_ASSETS = "SELECT svg_id FROM svg_asset_updates WHERE arrival % 29 <> 0"

ORACLE = {
    "canvas_catalog": check_sql(f"SELECT {_CAT_COLS} FROM cat", ["rec_log"], _CAT),
    "catalog_order": check_sql(f"SELECT {_CAT_COLS} FROM cat WHERE shapes > 0 OR gap_fillers > 0", ["rec_log"], _CAT),
    "primary_surface": check_sql(
        f"SELECT {_CAT_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY width * height DESC, shapes + gap_fillers DESC, canvas_id) AS rn FROM cat) t WHERE rn = 1", ["rec_log"], _CAT
    ),
    "asset_counts": check_sql(
        "SELECT c AS canvases, v AS vectors, c + v AS total FROM (SELECT (SELECT count(*) FROM cat WHERE shapes > 0 OR gap_fillers > 0) AS c, (SELECT count(DISTINCT svg_id) FROM va) AS v) t",
        ["rec_log", "svg_asset_updates"],
        _CAT + [("va", _VALID_ASSETS)],
    ),
}
