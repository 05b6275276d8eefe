"""Conversion jobs and their progress as streams.

The transitions are plain functions, so batch queries and streams share them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.service import HEARTBEAT, JOB_TTL, LONGEST

STATE = "status string, queue string, result string, error string, created_at double, updated_at double"
JOB = "job_id string, " + STATE
UPDATE = "job_id string, status string, queue string, result string, error string, ts double"
TERMINAL = ("complete", "completed", "failed", "callback_failed")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def apply_update(state: tuple | None, update: dict) -> tuple:
    """The state after an update: the first time stays, absent fields keep theirs; an unknown job begins as queued."""
    old = dict(zip(("status", "queue", "result", "error", "created_at", "updated_at"), state or ("queued", None, None, None, update["ts"], update["ts"]), strict=True))
    for k in ("status", "queue", "result", "error"):
        if update.get(k) is not None and not (isinstance(update[k], float) and update[k] != update[k]):
            old[k] = update[k]
    old["updated_at"] = max(old["updated_at"], update["ts"])
    return tuple(old.values())


class JobState(StatefulProcessor):
    """The latest state of each job, forgotten a while after its last update."""

    def __init__(self, ttl: int = JOB_TTL):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE, ttlDurationMs=self.ttl * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else None
        for part in rows:
            for u in part.sort_values("ts", kind="stable").to_dict("records"):
                now = apply_update(now, u)
        if now is not None:
            self.state.update(now)
            yield pd.DataFrame([(key[0], *now)], columns=["job_id", "status", "queue", "result", "error", "created_at", "updated_at"])

    def close(self) -> None:
        pass


def job_states(updates: DataFrame, ttl: int = JOB_TTL) -> DataFrame:
    """A stream of updates as a stream of job states. Needs the RocksDB state store (``PROVIDER``)."""
    return updates.groupBy("job_id").transformWithStateInPandas(JobState(ttl), JOB, "Update", "ProcessingTime")


EVENT = "job_id string, kind string, status string, stage string, pct int, message string"


class ProgressRelay(StatefulProcessor):
    """Relays a job's events until a final one; a heartbeat after silence, and an end after the longest wait."""

    def __init__(self, beat: int = HEARTBEAT, longest: int = LONGEST):
        self.beat, self.longest = beat * 1000, longest * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "started long, timer long, done boolean")

    def _row(self, key, kind, event=None) -> tuple:
        e = event or {}
        return key[0], kind, e.get("status"), e.get("stage"), e.get("pct"), e.get("message")

    def _timer(self, started: int, now: int, old: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        at = min(now + self.beat, started + self.longest)
        self.handle.registerTimer(at)
        self.since.update((started, at, False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.since.get() if self.since.exists() else None
        done, out = bool(held and held[2]), []
        for part in rows:
            for e in part.to_dict("records"):
                if not done:
                    out.append(self._row(key, "event", e))
                    done = e["status"] in TERMINAL
        if done:
            if held and not held[2]:
                self.handle.deleteTimer(held[1])
            self.since.update((held[0] if held else now, 0, True))
        else:
            self._timer(held[0] if held else now, now, held[1] if held else None)
        if out:
            yield pd.DataFrame(out, columns=["job_id", "kind", "status", "stage", "pct", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.since.get()
        if now - held[0] >= self.longest:
            self.since.update((held[0], 0, True))
            kind = "timeout"
        else:
            at = min(now + self.beat, held[0] + self.longest)
            self.handle.registerTimer(at)
            self.since.update((held[0], at, False))
            kind = "heartbeat"
        yield pd.DataFrame([self._row(key, kind)], columns=["job_id", "kind", "status", "stage", "pct", "message"])

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, beat: int = HEARTBEAT, longest: int = LONGEST) -> DataFrame:
    """A stream of (job_id, status, stage, pct, message) as what listeners get."""
    return events.groupBy("job_id").transformWithStateInPandas(ProgressRelay(beat, longest), EVENT, "Update", "ProcessingTime")


def windowed_progress(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events counted by status in windows of event time (``ts`` a timestamp); later ones than ``late`` fall out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count("*").alias("n"))


def convert_arrivals(files: DataFrame, write, options=None):
    """A stream of (doc_id, source, ext, content), converted batch by batch; ``write`` gets (results, batch number)."""
    from folioflow.plans.convert import Options, convert_sources

    own = options or Options()

    def one(batch: DataFrame, number: int) -> None:
        write(convert_sources(batch, own), number)

    return files.writeStream.foreachBatch(one)
