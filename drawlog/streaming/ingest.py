"""Keyed streaming state: gap-free ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from drawlog import schema as S

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = "session_id string, frame_id string, sequence long, event string, status string"
_COLUMNS = ["session_id", "frame_id", "sequence", "event", "status"]


class _FrameState(StatefulProcessor):
    """State of one (session, frame): how far it has come, and one entry for every event that waits.

    ``place`` holds the last accepted sequence, the number of events that
    wait, and a bound that none of them is below.  A micro-batch that closes
    no gap writes its own early events and this one row, however many wait.
    """

    def __init__(self, max_pending: int | None, report_after: int | None):
        self._most, self._patience = max_pending, report_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        long = T.LongType()
        self._place = handle.getValueState("place", T.StructType([T.StructField(n, long) for n in ("last", "waiting", "lowest")]))
        self._held = handle.getMapState("held", T.StructType([T.StructField("sequence", long)]), T.StructType([T.StructField("event", T.StringType())]))

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=_COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, waiting, lowest = self._place.get() if self._place.exists() else (0, 0, 0)
        before = last
        early: dict[int, str] = {}  # what this micro-batch brought and no event before it has released
        for pdf in rows:
            for sequence, event in zip(pdf["sequence"], pdf["event"]):
                if pd.notna(sequence) and sequence > last:
                    early.setdefault(int(sequence), event)
            ready = []
            while True:
                at = last + 1
                # The copy that arrived first counts: what waits goes before what has just come.
                if waiting and at >= lowest and self._held.containsKey((at,)):
                    ready.append((at, self._held.getValue((at,))[0], "accepted"))
                    self._held.removeKey((at,))
                    early.pop(at, None)
                    waiting -= 1
                elif at in early:
                    ready.append((at, early.pop(at), "accepted"))
                else:
                    break
                last = at
            if ready:
                yield self._rows(key, ready)
        lowest = max(lowest, last + 1)
        for sequence in sorted(early):
            if not (waiting and self._held.containsKey((sequence,))):
                lowest = min(lowest, sequence) if waiting else sequence
                self._held.updateValue((sequence,), (early[sequence],))
                waiting += 1
        if self._most is not None and waiting > self._most:
            over = sorted(k[0] for k in self._held.keys())[self._most :]
            yield self._rows(key, [(s, self._held.getValue((s,))[0], "overflow") for s in over])
            for s in over:
                self._held.removeKey((s,))
            waiting -= len(over)
        self._place.update((last, waiting, lowest))
        if self._patience is not None and (last > before or not self._timed()):
            for t in self._handle.listTimers():
                self._handle.deleteTimer(t)
            if waiting:
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._patience)

    def _timed(self) -> bool:
        return any(True for _ in self._handle.listTimers())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, waiting, _ = self._place.get()
        if waiting:
            yield self._rows(key, [(last + 1, None, "missing")])
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._patience)

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which writes changes only; a provider set by the user must be one that knows named states."""
    if spark.conf.get(_PROVIDER) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def stream_ingest(log: DataFrame, max_pending: int | None = None, report_after: int | None = None) -> DataFrame:
    """Accept every event of a frame once, in sequence, from an at-least-once stream.

    State per (session, frame): the last accepted sequence and, one entry per
    sequence, the events that arrived ahead of a gap.  A resend is dropped (the
    first copy counts); a held event is released when the gap closes, however
    many wait, and a micro-batch that closes none writes only what it brought.
    Only where ``max_pending`` is given, events beyond that number are given
    out with status ``overflow``, highest sequences first, for a producer that
    resends what was not accepted; where ``report_after`` (milliseconds) is
    given, a gap that stays open that long is reported, again and again, by a
    row of status ``missing`` with the sequence waited for and no event.
    Events without a sequence or with one below 1 are not taken.  Result: the
    input columns as JSON in ``event``, plus session_id, frame_id, sequence,
    status.  The session's state store is set to RocksDB.
    """
    keyed_state(log.sparkSession)
    packed = log.select(
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("frame_id", F.lit(S.DEFAULT_FRAME)).alias("frame_id"),
        "sequence",
        F.to_json(F.struct(*log.columns)).alias("event"),
    )
    return packed.groupBy("session_id", "frame_id").transformWithStateInPandas(
        statefulProcessor=_FrameState(max_pending, report_after),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None" if report_after is None else "ProcessingTime",
    )
