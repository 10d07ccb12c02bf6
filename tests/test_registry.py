import re

import duckdb

import __spark_entry__ as entry
from drawlog.plans import registry

# Keys whose result is only pinned by unit tests.
ROWS_ONLY = {"flatten_arcs", "path_lineage", "eps_documents", "wrapped_vector_documents", "tile_paint_order"}


def test_every_query_has_a_check_or_is_pinned_elsewhere():
    assert set(registry.QUERIES) - set(registry.ORACLE) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_check_sql_is_readable():
    con = duckdb.connect()
    for t in "events documents part orders lineitem pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in registry.ORACLE.items():
        con.execute("EXPLAIN " + sql)
        assert not re.search(r"\bLIMIT\b", sql), name


def test_flagship_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "canvas_id", "width", "height", "revision", "shapes", "gap_fillers", "errors", "state"]
    rows = df.collect()
    assert rows and all(r["state"] == "RECORDING" for r in rows)
