"""Ingest queries: reading, gate, prefix, gaps, cap, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlog.operators import ingest
from drawlog.plans import fixtures as fx
from drawlog.plans.compose import check_sql
from drawlog.sources import readers
from drawlog.sources.staging import stage_path

LOG_COLS = "session_id, frame_id, canvas_id, sequence, type, path_id, k"
MAX_EVENTS = 15
CAP = 500
LIMIT = 300


def write_batches(spark: SparkSession, rec, name: str, per_batch: int = 40) -> str:
    """Write a log as text files of JSON batches, ``per_batch`` events of one frame each."""
    path = stage_path(spark, name)
    rows = fx.as_events(rec, keep=("k",))
    event = F.struct(*[c for c in rows.columns if c not in ("k",)], F.col("k").alias("context_type"))
    (
        rows.groupBy("session_id", "frame_id", F.floor((F.col("sequence") - 1) / per_batch).alias("b"))
        .agg(F.array_sort(F.collect_list(F.struct("sequence", event.alias("e")))).alias("a"))
        .select(F.to_json(F.transform("a", lambda x: x["e"])).alias("value"))
        .write.text(path)
    )
    return path


def read_draw_log(spark, sf_dir) -> DataFrame:
    path = write_batches(spark, fx.rec_log(spark, sf_dir), "batches")
    log = readers.read_draw_log(spark, path)
    return log.select(
        "session_id",
        "frame_id",
        "canvas_id",
        "sequence",
        "type",
        "width",
        "height",
        "path_id",
        F.col("command.type").alias("cmd"),
        F.get("args", F.lit(0)).alias("arg1"),
        F.get("command.args", F.lit(1)).alias("carg2"),
        "line_width",
        "value",
    )


def accepted_prefix(spark, sf_dir) -> DataFrame:
    log = fx.rec_batches(spark, sf_dir)
    return ingest.accepted_prefix(log).select(*[c.strip() for c in LOG_COLS.split(",")])


def sequence_gaps(spark, sf_dir) -> DataFrame:
    return ingest.sequence_gaps(fx.rec_batches(spark, sf_dir))


def _gate(spark, sf_dir, **kw) -> DataFrame:
    log = fx.as_events(fx.rec_batches(spark, sf_dir), keep=("batch_id", "arrival"))
    return ingest.batch_gate(log, max_events=MAX_EVENTS, event_limit=LIMIT, **kw)


def batch_gate(spark, sf_dir) -> DataFrame:
    return _gate(spark, sf_dir)


def session_event_cap(spark, sf_dir) -> DataFrame:
    batches = (
        fx.rec_batches(spark, sf_dir)
        .groupBy("session_id", "batch_id", "arrival")
        .agg(F.count(F.lit(1)).alias("new_events"))
    )
    return ingest.session_event_cap(batches, n=CAP)


def control(spark, sf_dir) -> DataFrame:
    rec = fx.table(spark, sf_dir, "events")
    return rec.where("event_id % 487 = 0 OR event_id % 1999 = 7 OR event_id % 4001 = 11").select(
        F.concat(F.lit("rec-"), (F.col("user_id") % 15).cast("string")).alias("session_id"),
        F.col("event_id").alias("arrival"),
        F.expr(
            "CASE WHEN event_id % 487 = 0 THEN 'clear_surfaces' WHEN event_id % 1999 = 7 THEN 'stop' ELSE 'clear' END"
        ).alias("action"),
    )


def session_lifecycle(spark, sf_dir) -> DataFrame:
    log = fx.rec_log(spark, sf_dir).withColumn("arrival", F.col("event_id"))
    return ingest.session_lifecycle(log, control(spark, sf_dir)).select(
        "session_id", "frame_id", "sequence", "arrival", "on_surface"
    )


def session_generations(spark, sf_dir) -> DataFrame:
    starts = fx.table(spark, sf_dir, "events").where("event_id % 811 = 3").select(
        F.concat(F.lit("rec-"), (F.col("user_id") % 15).cast("string")).alias("session_id"),
        F.col("event_id").alias("arrival"),
        F.lit("start").alias("action"),
    )
    log = fx.rec_log(spark, sf_dir).withColumn("arrival", F.col("event_id"))
    kept = ingest.session_lifecycle(log, control(spark, sf_dir).unionByName(starts))
    return ingest.generations_apart(kept).select("session_id", "frame_id", "sequence", "arrival", "on_surface", "generation")


QUERIES = {
    "read_draw_log": read_draw_log,
    "accepted_prefix": accepted_prefix,
    "sequence_gaps": sequence_gaps,
    "batch_gate": batch_gate,
    "session_event_cap": session_event_cap,
    "session_lifecycle": session_lifecycle,
    "session_generations": session_generations,
}

_GATE_STEPS = [
    ("sz", "SELECT batch_id, min(session_id) AS session_id, min(frame_id) AS frame_id, min(arrival) AS arrival, count(*) AS events FROM rec_batches GROUP BY batch_id"),
    ("ev", "SELECT r.*, max(sequence) OVER (PARTITION BY batch_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM rec_batches r"),
    ("need", "SELECT batch_id, max(CASE WHEN pm IS NULL OR sequence > pm + 1 THEN sequence - 1 END) AS need, max(sequence) AS hi FROM ev GROUP BY batch_id"),
    ("o", "SELECT sz.*, need, hi, row_number() OVER (PARTITION BY session_id ORDER BY arrival, batch_id) AS i FROM sz JOIN need USING (batch_id)"),
    # One batch after the other, with the sequences and the count of its session.
    (
        "st",
        f"""SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(map([], []) AS MAP(VARCHAR, BIGINT)) AS reached, CAST(0 AS BIGINT) AS used,
  CAST(NULL AS VARCHAR) AS batch_id, CAST(0 AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS events, CAST(0 AS BIGINT) AS fresh, CAST(NULL AS VARCHAR) AS reason FROM o
UNION ALL
SELECT session_id, i, CASE WHEN reason IS NULL THEN map_concat(reached, map([frame_id], [greatest(x, hi)])) ELSE reached END,
  CASE WHEN reason IS NULL THEN used + fresh ELSE used END, batch_id, arrival, events, CASE WHEN reason IS NULL THEN fresh ELSE 0 END, reason
FROM (SELECT *, CASE WHEN events > {MAX_EVENTS} THEN 'size' WHEN need > x THEN 'sequence' WHEN used + fresh > {LIMIT} THEN 'limit' END AS reason
  FROM (SELECT *, greatest(hi - x, 0) AS fresh
    FROM (SELECT o.*, st.reached, st.used, coalesce(st.reached[o.frame_id], 0) AS x FROM st JOIN o ON o.session_id = st.session_id AND o.i = st.i + 1) a) b) c""",
    ),
]

ORACLE = {
    "read_draw_log": check_sql(
        """SELECT session_id, frame_id, canvas_id, sequence, type, width, height, path_id, cmd,
  CASE WHEN type IN ('fill_rect','stroke_rect') THEN CAST(k AS DOUBLE)
       WHEN type='clear_rect' THEN CASE WHEN k % 10 = 1 THEN 0.0 ELSE CAST(k AS DOUBLE) END END AS arg1,
  CASE WHEN cmd IS NOT NULL AND cmd <> 'begin_path' THEN CAST(event_id % 100 AS DOUBLE) END AS carg2,
  CASE WHEN type IN ('fill','fill_rect','stroke_rect') THEN CAST(k % 5 AS DOUBLE) END AS line_width,
  CASE WHEN type='canvas_visibility' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END END AS value
FROM rec_log""",
        ["rec_log"],
    ),
    "accepted_prefix": check_sql(
        f"""SELECT {LOG_COLS} FROM d WHERE sequence = rn""",
        ["rec_batches"],
        [
            ("u", f"SELECT DISTINCT {LOG_COLS} FROM rec_batches"),
            ("d", "SELECT *, row_number() OVER (PARTITION BY session_id, frame_id ORDER BY sequence) AS rn FROM u"),
        ],
    ),
    "sequence_gaps": check_sql(
        "SELECT session_id, frame_id, last_good, sequence AS next_seen, sequence - last_good - 1 AS missing FROM g WHERE sequence > last_good + 1",
        ["rec_batches"],
        [
            ("u", "SELECT DISTINCT session_id, frame_id, sequence FROM rec_batches"),
            ("g", "SELECT *, coalesce(lag(sequence) OVER (PARTITION BY session_id, frame_id ORDER BY sequence), 0) AS last_good FROM u"),
        ],
    ),
    "batch_gate": check_sql(
        "SELECT batch_id, session_id, arrival, events, CAST(fresh AS BIGINT) AS new_events, reason FROM st WHERE i > 0",
        ["rec_batches"],
        _GATE_STEPS,
        recursive=True,
    ),
    "session_event_cap": check_sql(
        "SELECT session_id, batch_id, arrival, new_events, used AS session_events FROM st WHERE fits",
        ["rec_batches"],
        [
            ("b", "SELECT session_id, batch_id, arrival, count(*) AS new_events FROM rec_batches GROUP BY ALL"),
            ("o", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival, batch_id) AS i FROM b"),
            (
                "st",
                f"""SELECT o.*, (new_events <= {CAP}) AS fits, CASE WHEN new_events <= {CAP} THEN new_events ELSE 0 END AS used FROM o WHERE i = 1
UNION ALL
SELECT o.*, (st.used + o.new_events <= {CAP}) AS fits, CASE WHEN st.used + o.new_events <= {CAP} THEN st.used + o.new_events ELSE st.used END AS used
FROM st JOIN o ON o.session_id = st.session_id AND o.i = st.i + 1""",
            ),
        ],
        recursive=True,
    ),
    "session_lifecycle": check_sql(
        """SELECT l.session_id, frame_id, sequence, event_id AS arrival,
  NOT EXISTS (SELECT 1 FROM ctl c WHERE c.session_id = l.session_id AND action = 'clear_surfaces' AND c.arrival >= l.event_id) AS on_surface
FROM rec_log l
WHERE NOT EXISTS (SELECT 1 FROM ctl c WHERE c.session_id = l.session_id AND action = 'clear')
  AND NOT EXISTS (SELECT 1 FROM ctl c JOIN ctl d ON c.session_id = d.session_id AND c.arrival > d.arrival
                  WHERE c.session_id = l.session_id AND c.action = 'clear_surfaces' AND d.action = 'stop')
  AND NOT EXISTS (SELECT 1 FROM ctl c WHERE c.session_id = l.session_id AND action = 'stop' AND c.arrival <= l.event_id)""",
        ["rec_log"],
        [
            (
                "ctl",
                """SELECT 'rec-' || CAST(user_id % 15 AS VARCHAR) AS session_id, event_id AS arrival,
  CASE WHEN event_id % 487 = 0 THEN 'clear_surfaces' WHEN event_id % 1999 = 7 THEN 'stop' ELSE 'clear' END AS action
FROM events WHERE event_id % 487 = 0 OR event_id % 1999 = 7 OR event_id % 4001 = 11""",
            )
        ],
    ),
    # Places in the order of the log: stop, start, row, clear_surfaces, clear.
    "session_generations": check_sql(
        """SELECT CASE WHEN generation > 1 THEN session_id || '#' || generation ELSE session_id END AS session_id, frame_id, sequence, event_id AS arrival,
  NOT EXISTS (SELECT 1 FROM ct WHERE ct.session_id = r.session_id AND ct.since = r.since AND NOT idle AND action = 'clear_surfaces' AND ct.p > r.p) AS on_surface, generation
FROM r
WHERE since >= 0
  AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.session_id = r.session_id AND action IN ('stop', 'clear') AND ct.p BETWEEN r.since AND r.p)
  AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.session_id = r.session_id AND (action = 'clear' OR action = 'clear_surfaces' AND idle) AND ct.p > r.p)""",
        ["rec_log"],
        [
            (
                "ctl",
                """SELECT *, arrival * 5 + CASE action WHEN 'stop' THEN 0 WHEN 'start' THEN 1 WHEN 'clear_surfaces' THEN 3 ELSE 4 END AS p
FROM (SELECT 'rec-' || CAST(user_id % 15 AS VARCHAR) AS session_id, event_id AS arrival, unnest(list_concat(
    CASE WHEN event_id % 487 = 0 THEN ['clear_surfaces'] WHEN event_id % 1999 = 7 THEN ['stop'] WHEN event_id % 4001 = 11 THEN ['clear'] ELSE [] END,
    CASE WHEN event_id % 811 = 3 THEN ['start'] ELSE [] END)) AS action FROM events) t""",
            ),
            ("sn", "SELECT session_id, min(p) AS p0 FROM ctl WHERE action = 'start' GROUP BY session_id"),
            (
                "cs",
                """SELECT c.session_id, c.action, c.p, coalesce(max(s.p), CASE WHEN c.session_id IN (SELECT session_id FROM sn) THEN -1 ELSE 0 END) AS since
FROM ctl c LEFT JOIN ctl s ON s.session_id = c.session_id AND s.action = 'start' AND s.p <= c.p GROUP BY c.session_id, c.action, c.p""",
            ),
            (
                "ct",
                """SELECT *, since < 0 OR EXISTS (SELECT 1 FROM ctl h WHERE h.session_id = cs.session_id AND h.action IN ('stop', 'clear') AND h.p >= cs.since AND h.p < cs.p) AS idle FROM cs""",
            ),
            (
                "r",
                """SELECT l.session_id, l.frame_id, l.sequence, l.event_id, l.event_id * 5 + 2 AS p,
  coalesce(max(s.p), CASE WHEN l.session_id IN (SELECT session_id FROM sn) THEN -1 ELSE 0 END) AS since,
  count(s.p) + CASE WHEN l.session_id IN (SELECT session_id FROM sn) THEN 0 ELSE 1 END AS generation
FROM rec_log l LEFT JOIN ctl s ON s.session_id = l.session_id AND s.action = 'start' AND s.p <= l.event_id * 5 + 2
GROUP BY l.session_id, l.frame_id, l.sequence, l.event_id""",
            ),
        ],
    ),
}
