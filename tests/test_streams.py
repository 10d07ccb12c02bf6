"""Streams: state that grows with what is new only, and results that do not depend on how the input was cut."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from drawlog.operators.assets import asset_revisions
from drawlog.sources.staging import stage_path
from drawlog.streaming import ingest, tables
from drawlog.streaming.buckets import Buckets

LOG = "session_id string, frame_id string, sequence long, type string"


def deliver(spark, rows, cuts, schema=LOG):
    """A stream of one file per delivery, in order."""
    path = stage_path(spark, "deliveries")
    step = -(-len(rows) // cuts)
    for i in range(cuts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, stream, out=None):
    out = out or stage_path(spark, "out")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", stage_path(spark, "progress"))
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("session_id string, frame_id string, sequence long, event string, status string").parquet(out), query


def plain(rows):
    """The rule, one event after the other: (session, frame) -> accepted (sequence, type)."""
    first = {}
    for s, f, q, kind in rows:
        if q is not None and q >= 1:
            first.setdefault((s, f or "main"), {}).setdefault(q, kind)
    out = set()
    for (s, f), held in first.items():
        q = 1
        while q in held:
            out.add((s, f, q, held[q]))
            q += 1
    return out


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_ingest_does_not_depend_on_the_cuts(spark, cuts):
    r = random.Random(7)
    rows = [(s, f, q, f"{q}-{n}") for s, f in (("s", None), ("s", "g"), ("t", "g")) for n in range(2) for q in range(1, 90) if r.random() < 0.93]
    rows += [("s", "g", None, "none"), ("s", "g", 0, "zero"), ("t", "g", -3, "low")]
    r.shuffle(rows)
    out, _ = finish(spark, ingest.stream_ingest(deliver(spark, rows, cuts)))
    got = out.where("status = 'accepted'").select("session_id", "frame_id", "sequence", F.get_json_object("event", "$.type")).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == plain(rows)


def test_overflow_gives_out_the_highest(spark):
    rows = [("s", "f", q, "x") for q in (1, 2, 5, 9, 7, 4, 8)]
    out, _ = finish(spark, ingest.stream_ingest(deliver(spark, rows, 1), max_pending=2))
    got = {(x.sequence, x.status) for x in out.collect()}
    assert got == {(1, "accepted"), (2, "accepted"), (7, "overflow"), (8, "overflow"), (9, "overflow")}


def state_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(os.path.join(folder, "state")) for f in files)


def test_state_written_grows_with_new_rows_only(spark):
    """20,000 events wait behind a gap; later micro-batches of 10 events write a small part of what the first one wrote."""
    waiting = 20_000
    first = [("s", "f", q, "x" * 50) for q in range(2, waiting + 2)]
    path = stage_path(spark, "deliveries")
    progress = stage_path(spark, "progress")
    out = stage_path(spark, "out")
    stream = spark.readStream.schema(LOG).parquet(path) if os.path.exists(path) else None
    sizes = []
    batches = [first, *[[("s", "f", waiting + 2 + 10 * i + j, "y") for j in range(10)] for i in range(3)], [("s", "f", 1, "z")]]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
        stream = ingest.stream_ingest(spark.readStream.schema(LOG).parquet(path))
        before = state_bytes(progress)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(state_bytes(progress) - before)
    assert max(sizes[1:4]) < sizes[0] / 5
    got = spark.read.parquet(out)
    assert got.count() == waiting + 31 and got.agg(F.max("sequence")).first()[0] == waiting + 31


def test_a_gap_that_stays_open_is_reported(spark):
    path, out = stage_path(spark, "deliveries"), stage_path(spark, "out")
    spark.createDataFrame([("s", "f", q, "x") for q in (1, 3, 4)], LOG).coalesce(1).write.parquet(path)
    stream = ingest.stream_ingest(spark.readStream.schema(LOG).parquet(path), report_after=200)
    query = stream.writeStream.format("memory").queryName("reported").outputMode("append").trigger(processingTime="300 milliseconds")
    query = query.option("checkpointLocation", stage_path(spark, "progress")).start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = {(r.sequence, r.status) for r in spark.table("reported").collect()}
            if (2, "missing") in got:
                break
    finally:
        query.stop()
    assert got == {(1, "accepted"), (2, "missing")}


KEYED = "owner string, name long, value long"


def test_keyed_state_touches_its_buckets_only(spark):
    root = stage_path(spark, "keyed")
    t = Buckets(spark, root, "t", KEYED, ["owner", "name"], ["owner"], buckets=16, deltas=3)
    rows = spark.range(20_000).select(F.concat(F.lit("o"), (F.col("id") % 2000).cast("string")).alias("owner"), F.col("id").alias("name"), F.col("id").alias("value"))
    t.put(rows, 0)
    want = {(r.owner, r.name): r.value for r in rows.collect()}

    def files():
        return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/t/") for f in fs if f.endswith(".parquet")}

    r = random.Random(2)
    for epoch in range(1, 9):
        few = [(f"o{r.randrange(2000)}", r.randrange(30_000), epoch) for _ in range(3)]
        changed = spark.createDataFrame(few, KEYED).dropDuplicates(["owner", "name"])
        changed = spark.createDataFrame(changed.collect(), KEYED)
        own = set(t.numbers(changed))
        before = files()
        t.put(changed, epoch)
        t.put(changed, epoch)  # a retry
        touched = {int(f.split("bucket=")[1].split("/")[0]) for f, _ in set(files().items()) ^ set(before.items())}
        assert touched <= own or epoch > 3  # later also buckets that are rewritten
        seen = {(x.owner, x.name): x.value for x in t.read(changed, epoch).collect()}
        assert seen == {k: v for k, v in want.items() if k[0] in {c.owner for c in changed.collect()}}
        want |= {(x.owner, x.name): x.value for x in changed.collect()}
    assert {(x.owner, x.name): x.value for x in t.read().collect()} == want
    for b in range(16):
        base, folders = t._folders(b, None)
        assert len(folders) <= 5


def test_retry_of_a_micro_batch_leaves_the_same_tables(spark):
    """The same assets, cut in three, with one micro-batch run twice over the state it left."""
    schema = "session_id string, svg_id string, arrival long, width double, height double, shapes long, filename string, markup string"
    r = random.Random(3)
    rows = [("s", f"a{r.randrange(12)}", i, 10.0, 10.0, 1, "f.svg", f"<svg>{r.randrange(3)}</svg>") for i in range(90)]
    whole = asset_revisions(spark.createDataFrame(rows, schema)).where("changed")
    want = {(x.svg_id, x.revision, x.markup) for x in whole.collect()}
    last = {}
    for s, rev, m in sorted(want, key=lambda x: x[1]):
        last[s] = (rev, m)
    sink = stage_path(spark, "assets")
    parts = [spark.createDataFrame(rows[i : i + 30], schema) for i in (0, 30, 60)]
    held = []

    class Stream:
        """The parts as micro-batches, the second one twice."""

        schema, columns = parts[0].schema, parts[0].columns

        @property
        def writeStream(self):
            return self

        def foreachBatch(self, take):
            held.append(take)

    tables.stream_assets(Stream(), sink)
    for epoch in (0, 1, 1, 2):
        held[0](parts[epoch], epoch)
    changes = tables.read_table(spark, sink, "changes", tables.stored_asset_schema(parts[0].schema))
    assert {(x.svg_id, x.revision, x.markup) for x in changes.collect()} == want and changes.count() == len(want)
    assert {x.svg_id: (x.revision, x.markup) for x in tables.current_assets(spark, sink, parts[0].schema).collect()} == last
