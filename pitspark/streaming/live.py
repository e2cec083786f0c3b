"""Live match states on a stream of events, with the forecasts that batch replays make, and session logs.

State is kept for each match, or for each expected entry of a session, and ends with it: a timer on event time clears it
once nothing has come for a while. The state store must be RocksDB's; a session with another one is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import inplay

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What counts of a match: (kind, name).
COUNTED = (("goal", "goals"), ("red", "reds"))
COUNTS = tuple(f"{name}_{side}" for _, name in COUNTED for side in "ab")


def _needs_rocks_db(spark: SparkSession) -> None:
    if not str(spark.conf.get(STORE, None)).endswith(ROCKS_DB.rsplit(".", 1)[1]):
        raise ValueError(f"live states need {STORE} = {ROCKS_DB}")


def _micros(x: pd.Timestamp) -> int:
    return x.value // 1000


def _event_key(ts: int, minute: int | None, kind: str | None, side: str | None) -> tuple:
    """The order in which Spark compares such rows: nulls come first."""
    return ts, minute is not None, minute or 0, kind is not None, kind or "", side is not None, side or ""


class MatchState(StatefulProcessor):
    """The events of a match, each in its earliest version, and their sums; cleared by a timer ``keep_ms`` after the last event."""

    def __init__(self, keep_ms: int, types: dict[str, str]):
        self.keep_ms, self.types = keep_ms, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", f"event_id {self.types['event_id']}", "ts long, minute int, kind string, side string")
        self.timer = handle.getValueState("timer", "at long")
        self.sums = handle.getValueState("sums", ", ".join(f"{c} int" for c in COUNTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums, last, again = list(self.sums.get() or (0,) * len(COUNTS)), None, False
        for frame in rows:
            for event_id, ts, minute, kind, side in zip(frame["event_id"], frame["event_ts"], frame["minute"], frame["kind"], frame["side"]):
                minute = None if pd.isna(minute) else int(minute)
                new, old = (_micros(ts), minute, kind, side), self.events.getValue((event_id,))
                last = max(last or new[0], new[0])
                if old is not None and _event_key(*old) <= _event_key(*new):
                    continue
                for event, sign in ((old, -1), (new, 1)):
                    for i, (what, _) in enumerate(COUNTED):
                        for j, whose in enumerate("ab"):
                            if event is not None and (event[2], event[3]) == (what, whose):
                                sums[2 * i + j] += sign
                self.events.updateValue((event_id,), new)
                again = True
        if last is not None:
            self._wait(last // 1000 + self.keep_ms)
        if again:
            self.sums.update(tuple(sums))
            yield self._told(key, sums, False)

    def _wait(self, at: int) -> None:
        """The timer of a match is that of its last event."""
        now = self.timer.get()
        if now is None or now[0] < at:
            if now is not None:
                self.handle.deleteTimer(now[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _told(self, key, sums: list[int], ended: bool) -> pd.DataFrame:
        events = [v for _, v in self.events.iterator()]
        minutes = [v[1] for v in events if v[1] is not None]
        row = {"match": key[0], "minute": max(minutes, default=None), "source_ts": pd.Timestamp(max(v[0] for v in events) * 1000), **dict(zip(COUNTS, sums)), "ended": ended}
        return pd.DataFrame([row]).astype({"minute": "Int32", "source_ts": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, list(self.sums.get()), True)
        for state in (self.events, self.timer, self.sums):
            state.clear()

    def close(self) -> None:
        pass


def earliest_events(events: DataFrame, time: str = "ts") -> DataFrame:
    """Each event once: of repeats that differ the earliest, then the least by minute, kind, side and match, nulls first."""
    rest = [c for c in ("minute", "kind", "side", "match") if c in events.columns]
    first = events.groupBy("event_id").agg(F.min(F.struct(time, *rest)).alias("_e"))
    return first.select("event_id", *(F.col(f"_e.{c}").alias(c) for c in (time, *rest)))


def live_states(stream: DataFrame, time: str = "ts", horizon: str = "1 day", keep_minutes: int = 1440) -> DataFrame:
    """(match, minute, goals_a, .., reds_b, source_ts) so far, from events (event_id, match, ts, minute, kind, side) on a stream or in batch.

    An event delivered again counts once, in its earliest version (``earliest_events``; on a stream an event belongs to one
    match). A stream gives a match's state whenever it changes (output mode update, with ``ended`` false) and once more when
    nothing has come for ``keep_minutes`` of event time: then ``ended`` is true and the match is forgotten. Events later than the horizon are
    dropped, so they don't bring a forgotten match back.
    """
    if not stream.isStreaming:
        sums = [F.count_if((F.col("kind") == kind) & (F.col("side") == side)).cast("int").alias(f"{name}_{side}") for kind, name in COUNTED for side in "ab"]
        return earliest_events(stream, time).groupBy("match").agg(F.max("minute").alias("minute"), F.max(time).alias("source_ts"), *sums)
    _needs_rocks_db(stream.sparkSession)
    types = dict(stream.dtypes)
    out = f"match {types['match']}, minute int, source_ts timestamp, {', '.join(f'{c} int' for c in COUNTS)}, ended boolean"
    rows = stream.select("event_id", "match", F.col(time).cast("timestamp").alias("event_ts"), F.col("minute").cast("int").alias("minute"), "kind", "side").withWatermark("event_ts", horizon)
    return rows.groupBy("match").transformWithStateInPandas(MatchState(keep_minutes * 60_000, types), StructType.fromDDL(out), "Update", "EventTime")


def live_records(stream: DataFrame, matches: DataFrame, time: str = "ts", horizon: str = "1 day", keep_minutes: int = 1440) -> DataFrame:
    """Live states with matches' (match, delta, decision_ts) and the forecast; a source later than its decision fails the query."""
    states = live_states(stream, time, horizon, keep_minutes).join(matches, "match")
    return inplay.prediction_records(states, F.col("source_ts"), F.col("decision_ts"))


class SessionEntry(StatefulProcessor):
    """One key of a session: logged once, repeats told as such; missed if it was expected and has not come by the end of its grace."""

    def __init__(self, grace_ms: int, keep_ms: int):
        self.grace_ms, self.keep_ms = grace_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: when its window ends, whether it has come or was missed, and when it is forgotten
        self.entry = handle.getValueState("entry", "due long, done boolean, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, done, until = self.entry.get() or (None, False, 0)
        out, came = [], pd.concat(list(rows)).sort_values(["entry_at", "event"], kind="stable")
        for event, at, window in zip(came["event"], came["entry_at"], came["due"]):
            until = max(until, _micros(at) // 1000 + self.keep_ms)
            if not pd.isna(window):
                if due is None:
                    due = _micros(window) // 1000 + self.grace_ms
                continue
            out.append((*key, event if not done else "duplicate", at))
            done = True
        until = max(until, (due or 0) + 1)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if due is not None and not done:
            self.handle.registerTimer(due)
        self.handle.registerTimer(until)
        self.entry.update((due, done, until))
        if out:
            yield self._told(out)

    @staticmethod
    def _told(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session", "event_key", "event", "at"]).astype({"at": "datetime64[us]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, done, until = self.entry.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at == due and not done:
            self.entry.update((due, True, until))
            yield self._told([(*key, "missed", pd.Timestamp(at, unit="ms"))])
        if at >= until:
            self.entry.clear()

    def close(self) -> None:
        pass


def session_log(stream: DataFrame, grace_minutes: int, keep_minutes: int = 1440, late: str = "0 seconds") -> DataFrame:
    """(session, event_key, event, at) from a stream of (session, event_key, event, at, due).

    Rows with ``due``, the end of a window, announce a key; the others are what happened. The first entry of a key is logged with its event, later ones as ``duplicate``; a key that was announced is ``missed`` when event time
    passes its window and the grace, and what comes later for it is a duplicate. A key is forgotten when nothing has come for it for ``keep_minutes``.
    """
    _needs_rocks_db(stream.sparkSession)
    types = dict(stream.dtypes)
    rows = stream.select("session", "event_key", "event", F.col("at").cast("timestamp").alias("entry_at"), F.col("due").cast("timestamp").alias("due")).withWatermark("entry_at", late)
    out = f"session {types['session']}, event_key {types['event_key']}, event string, at timestamp"
    return rows.groupBy("session", "event_key").transformWithStateInPandas(SessionEntry(grace_minutes * 60_000, keep_minutes * 60_000), StructType.fromDDL(out), "Append", "EventTime")


def session_counts(log: DataFrame, expected: DataFrame) -> DataFrame:
    """(event, n) of a session: entries (event, event_key) once for each key, repeats as duplicate, and keys that were expected but never logged as missed."""
    keys = log.groupBy("event_key").agg(F.min_by("event", "at").alias("event"), F.count("*").alias("times"))
    missed = expected.select("event_key").distinct().join(keys, "event_key", "left_anti").select(F.lit("missed").alias("event"), F.lit(1).alias("times"))
    rows = keys.select("event", F.lit(1).alias("n")).unionByName(keys.where("times > 1").select(F.lit("duplicate").alias("event"), (F.col("times") - 1).alias("n"))).unionByName(missed.select("event", F.col("times").alias("n")))
    return rows.groupBy("event").agg(F.sum("n").alias("n"))
