"""Segmentation of frame streams in batches and in Structured Streaming, and idempotent ingest."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.streaming.folds import Job, Segmenter, auto_stop, coalesce_requests, recycle_epochs, replay, segment_frames

SEGMENT_DDL = "key string, start_ms double, stop_ms double, has_speech boolean, reason string"
STATE_DDL = "start double, length double, quiet double, speech boolean"


def _frames(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["at", "energy"], kind="stable")


def segment_batch(frames: DataFrame) -> DataFrame:
    """Segments of ``key, at, energy, duration`` frames; a key's frames are folded in one task."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = _frames(frame)
        rows = [(key[0], *s) for s in segment_frames(zip(ordered["energy"], ordered["duration"], strict=True))]
        return pd.DataFrame(rows, columns=["key", "start_ms", "stop_ms", "has_speech", "reason"])

    return frames.groupBy("key").applyInPandas(fold, SEGMENT_DDL)


def segment_stream(frames: DataFrame, time_col: str | None = None, late: str = "10 seconds", idle_ms: int = 30_000) -> DataFrame:
    """The same over a stream: open segments are state, closed ones come out at once.

    With an event time, frames of a key are folded in its order as far as they come in
    one batch, ``late`` bounds how late a frame may be, and a key from which nothing came
    for ``idle_ms`` is over: its open segment comes out as a last one and its state goes.
    Without one a key's open segment stays until more of it comes.
    """

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Segmenter()
        if state.exists:
            held.start, held.length, held.quiet, held.speech = state.get
        rows = []
        if state.hasTimedOut:
            last = held.close()
            rows += [(key[0], *last)] if last else []
            state.remove()
        else:
            latest = 0
            for chunk in chunks:
                ordered = _frames(chunk)
                done = (held.add(e, d) for e, d in zip(ordered["energy"], ordered["duration"], strict=True))
                rows += [(key[0], *s) for s in done if s]
                if time_col:
                    latest = max(latest, int(ordered[time_col].max().timestamp() * 1000))
            state.update((held.start, held.length, held.quiet, held.speech))
            if time_col:
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows, columns=["key", "start_ms", "stop_ms", "has_speech", "reason"])

    timed = frames.withWatermark(time_col, late) if time_col else frames
    timeout = GroupStateTimeout.EventTimeTimeout if time_col else GroupStateTimeout.NoTimeout
    return timed.groupBy("key").applyInPandasWithState(fold, SEGMENT_DDL, STATE_DDL, "append", timeout)


def ingest_stream(chunks: DataFrame, keys: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    """A stream of chunks without repeats of a key within the time that a repeat may come late."""
    return chunks.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def stops(frames: DataFrame) -> DataFrame:
    """``key, stop_ms``: when each recording stops by itself, null if it does not."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = _frames(frame)
        at = auto_stop(zip(ordered["at"], ordered["energy"], ordered["duration"], strict=True))
        return pd.DataFrame({"key": [key[0]], "stop_ms": pd.Series([at], dtype="float64")})

    return frames.groupBy("key").applyInPandas(fold, "key string, stop_ms double")


def replay_schedule(jobs: DataFrame, slots: int = 1, capacity: int = 8) -> DataFrame:
    """``lane, step, at, job, event`` of each lane's submissions ``lane, at, job, priority, cost, preemptible``."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows: Any = frame.sort_values(["at", "job"]).itertuples()
        log = replay(((r.at, Job(r.job, r.priority, n, r.cost, bool(r.preemptible))) for n, r in enumerate(rows)), slots, capacity)
        return pd.DataFrame([(key[0], n, *entry) for n, entry in enumerate(log)], columns=["lane", "step", "at", "job", "event"])

    return jobs.groupBy("lane").applyInPandas(fold, "lane string, step int, at double, job string, event string")


def coalesced_runs(requests: DataFrame, cost: float) -> DataFrame:
    """``lane, at, until, requests``: the runs that a lane's ``lane, at`` requests come to if one worker drains them."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        runs = [(key[0], *run) for run in coalesce_requests(frame["at"].sort_values(), cost)]
        return pd.DataFrame(runs, columns=["lane", "at", "until", "requests"])

    return requests.groupBy("lane").applyInPandas(fold, "lane string, at double, until double, requests int")


def runner_epochs(requests: DataFrame) -> DataFrame:
    """``lane, at, epoch``: how often a lane's runner was replaced before each of its requests."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["at", "until"])
        epochs = list(recycle_epochs(zip(ordered["at"], ordered["until"], strict=True)))
        return pd.DataFrame({"lane": key[0], "at": ordered["at"].to_numpy(), "epoch": epochs})

    return requests.groupBy("lane").applyInPandas(fold, "lane string, at double, epoch int")


def event_frames(events: DataFrame) -> DataFrame:
    """Events as frames: a user is a key, a value's tenth of a hundredth an energy, a frame half a second."""
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("double").alias("at"), (F.col("value") / 4000).alias("energy"), F.lit(500.0).alias("duration")
    )
