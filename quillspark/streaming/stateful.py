"""Operators with keyed state over streams, each with the batch form that it equals.

``in_order`` is what most of them stand on: rows wait in their key's state until the
watermark has passed them, then they are folded in the order of their times. So neither
the order in which rows come nor the cuts between micro-batches show in a result, and a
row that comes twice counts once. ``assembled`` joins numbered pieces of a text instead.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillspark.functions import guard

#: ``step(held, row)`` changes the state of a key (a dict of JSON values) and yields rows to send.
Step = Callable[[dict, dict], Iterator[tuple]]


def _ordered(rows: list[dict]) -> list[dict]:
    """Rows by time and id, the first of those with one id."""
    seen: set = set()
    return [r for r in sorted(rows, key=lambda r: (r["at"], r["id"])) if not (r["id"] in seen or seen.add(r["id"]))]


def _listed(chunk: pd.DataFrame) -> list[dict]:
    return json.loads(chunk.to_json(orient="records", date_unit="ms"))


def in_order_batch(rows: DataFrame, keys: list[str], step: Step, out: str) -> DataFrame:
    """The fold of each key's rows ``keys, at (ms), id, ...`` in order of time; a key's rows meet in one task."""
    names = StructType.fromDDL(out).names

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        return pd.DataFrame([x for r in _ordered(_listed(frame)) for x in step(held, r)], columns=names, dtype=object)

    return rows.groupBy(*keys).applyInPandas(fold, out)


def in_order(rows: DataFrame, keys: list[str], time_col: str, step: Step, out: str, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """The same fold over a stream of rows whose event time ``time_col`` is that of ``at``.

    A row counts once the watermark, ``late`` behind the latest time seen, has passed it;
    rows that come later than that are dropped by the watermark. Held are rows that wait,
    ids as recent as repeats of them may still come, and what ``step`` keeps; a key that
    was idle for ``idle_ms`` loses its state.
    """
    names = StructType.fromDDL(out).names

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"wait": [], "done": {}, "kept": {}, "last": 0}
        timed_out = state.hasTimedOut
        if not timed_out:
            for chunk in chunks:
                held["wait"] += _listed(chunk.drop(columns=[time_col]) if time_col not in ("at", "id") else chunk)
        now = state.getCurrentWatermarkMs()
        ready, sent = [], []
        waiting = _ordered(held["wait"])
        held["wait"] = [r for r in waiting if r["at"] > now]
        ready = [r for r in waiting if r["at"] <= now and str(r["id"]) not in held["done"]]
        for r in ready:
            sent += step(held["kept"], r)
            held["done"][str(r["id"])] = r["at"]
        # A repeat has its first one's time, so the watermark drops it once it has passed that time.
        held["done"] = {k: at for k, at in held["done"].items() if at > now}
        held["last"] = max([held["last"], now, *(r["at"] for r in waiting)])
        if timed_out and not held["wait"] and now >= held["last"] + idle_ms:
            state.remove()
        else:
            state.update((json.dumps(held),))
            due = min((r["at"] for r in held["wait"]), default=held["last"] + idle_ms)
            state.setTimeoutTimestamp(max(due, now + 1))
        yield pd.DataFrame(sent, columns=names, dtype=object)

    timed = rows.withWatermark(time_col, late)
    return timed.groupBy(*keys).applyInPandasWithState(fold, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


# Late results: a result counts against what its key was when it came ------------------------------

VERDICTS = "key string, id long, verdict string"


def verdict_step(held: dict, row: dict) -> Iterator[tuple]:
    """Rows ``key, at, id, kind, token, revision``; kind ``state`` says what job and revision the key now has."""
    if row["kind"] == "state":
        held["token"], held["revision"] = row["token"], row["revision"]
    elif "token" not in held:
        yield row["key"], row["id"], "unknown"
    elif row["token"] != held["token"]:
        yield row["key"], row["id"], "other-job"
    else:
        yield row["key"], row["id"], "stale" if row["revision"] < held["revision"] else "applied"


# Claims: the first that fits a unit has it ----------------------------------------------------------

GRANTS = "key string, id long, granted boolean"


def claim_step(held: dict, row: dict) -> Iterator[tuple]:
    """Rows ``key, at, id, kind, revision, language``; kind ``unit`` opens (or renews) a unit, others claim it."""
    if row["kind"] == "unit":
        held["revision"], held["language"] = row["revision"], row["language"]
    else:
        fits = not held.get("won") and (row["revision"], row["language"]) == (held.get("revision"), held.get("language"))
        if fits:
            held["won"] = row["id"]
        yield row["key"], row["id"], fits


# Telemetry in bounded memory ------------------------------------------------------------------------

TELEMETRY = "key string, id long, evicted_id long, n_seen long, n_held long, tracked long, latency_ms double"


def telemetry_step(events: int = 50, samples: int = 20, tracked: int = 10) -> Step:
    """Rows ``key, at, id, kind, item``: kind ``start`` tracks an item, ``end`` gives its latency.

    A key remembers its last ``events`` ids, its last ``samples`` latencies and the
    ``tracked`` items that were started last; what came first goes first. Each event tells
    which id it drove out, and the mean latency of the samples that are held.
    """

    def step(held: dict, row: dict) -> Iterator[tuple]:
        held["n"] = held.get("n", 0) + 1
        log, open_items, taken = held.setdefault("log", []), held.setdefault("open", []), held.setdefault("samples", [])
        log.append(row["id"])
        evicted = log.pop(0) if len(log) > events else None
        if row["kind"] == "start":
            open_items[:] = [x for x in open_items if x[0] != row["item"]] + [[row["item"], row["at"]]]
            del open_items[: max(0, len(open_items) - tracked)]
        else:
            begun = next((at for item, at in open_items if item == row["item"]), None)
            if begun is not None:
                open_items[:] = [x for x in open_items if x[0] != row["item"]]
                taken.append(row["at"] - begun)
                del taken[: max(0, len(taken) - samples)]
        mean = sum(taken) / len(taken) if taken else None
        yield row["key"], row["id"], evicted, held["n"], len(log), len(open_items), mean

    return step


# Sentences of a growing text ------------------------------------------------------------------------

UNITS = "session string, ordinal long, text string, key string, id string, pending boolean"
_MARKS, _CLOSERS = ".!?。！？…", "\"'”’»)"
_RUN = re.compile(f"[^{_MARKS}]+[{_MARKS}]+[{re.escape(_CLOSERS)}]*")


class Assembly:
    """What a session's text has come to: settled units are sent, open ones wait for what follows them."""

    def __init__(self, held: dict[str, Any] | None = None) -> None:
        held = held or {}
        self.next, self.early = held.get("next", 0), held.get("early", {})
        self.rest, self.finished, self.ordinal = held.get("rest", ""), held.get("finished", False), held.get("ordinal", 0)
        self.counts, self.open, self.over = held.get("counts", {}), held.get("open", []), held.get("over", False)

    def add(self, seq: int, text: str | None, last: bool) -> None:
        """Takes a piece in; one that was there before is ignored, one that comes early waits for those before it."""
        if seq < self.next or self.over:
            return
        self.early.setdefault(str(seq), [text or "", bool(last)])
        while (piece := self.early.pop(str(self.next), None)) is not None:
            self.rest, self.next, self.over = self.rest + piece[0], self.next + 1, piece[1]

    def advance(self) -> list[tuple]:
        """``ordinal, text, key, id, pending`` of the units that nothing can change any more."""
        settled, at = [], 0
        found: list[str] = []
        for m in _RUN.finditer(self.rest):
            # More marks or closing quotes may follow a sentence at the very end.
            if m.end() == len(self.rest) and not self.over:
                found.append(m[0])
                continue
            settled.append(m[0])
            at = m.end()
        finished = self.finished or bool(settled) or bool(found)
        end = _RUN.sub("", self.rest[at:])
        tail = guard.squeeze(end.lstrip(_MARKS).lstrip(_CLOSERS) if finished else end)
        done = [s for s in map(guard.squeeze, settled) if s]
        still = [(s, False) for s in map(guard.squeeze, found) if s] + [(tail, True)] * bool(tail)
        if self.over:
            done, still, pending = done + [s for s, _ in still], [], {len(done)} if tail else set()
        else:
            pending = set()
        before, out, counts = {u[1]: u for u in self.open}, [], dict(self.counts)
        named = []
        for k, (text, _) in enumerate([*((s, False) for s in done), *still]):
            mark = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]
            named.append((self.ordinal + k, text, f"{mark}:{counts.get(mark, 0)}", mark))
            counts[mark] = counts.get(mark, 0) + 1
        taken = {before[key][2] for _, _, key, _ in named if key in before}
        places = {u[0]: u[2] for u in self.open if u[2] not in taken}
        ids = [before[key][2] if key in before else places.get(ordinal, key) for ordinal, _, key, _ in named]
        for k, (ordinal, text, key, mark) in enumerate(named[: len(done)]):
            out.append((ordinal, text, key, ids[k], k in pending))
            self.counts[mark] = self.counts.get(mark, 0) + 1
        self.open = [[ordinal, key, ids[k]] for k, (ordinal, _, key, _) in enumerate(named) if k >= len(done)]
        self.ordinal += len(done)
        self.rest, self.finished = "" if self.over else self.rest[at:], self.finished or bool(settled)
        return out

    def held(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("next", "early", "rest", "finished", "ordinal", "counts", "open", "over")}


def assembled(pieces: DataFrame) -> DataFrame:
    """Units of the texts that ``session, seq, text, last`` pieces make, as a stream.

    Pieces are numbered from 0; they may come in any order and again. A sentence is sent
    once the piece after it shows that it has ended, with the key that the same sentence
    has in the batch form and the id under which it was first seen, also unfinished. The
    piece with ``last`` ends a session: its open end is a unit too (``pending``), and later
    pieces are ignored. State is the open end, pieces that came early, and a count for
    each different sentence. Null texts are empty.
    """

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Assembly(json.loads(state.get[0]) if state.exists else None)
        for chunk in chunks:
            for seq, text, last in zip(chunk["seq"], chunk["text"], chunk["last"], strict=True):
                own.add(int(seq), text, last)
        rows = [(key[0], *u) for u in own.advance()]
        if own.over:
            own = Assembly({"over": True, "next": own.next})
        state.update((json.dumps(own.held()),))
        yield pd.DataFrame(rows, columns=names, dtype=object)

    names = StructType.fromDDL(UNITS).names
    named = pieces.select(F.col("session").cast("string").alias("session"), "seq", "text", F.coalesce("last", F.lit(False)).alias("last"))
    return named.groupBy("session").applyInPandasWithState(fold, UNITS, "held string", "append", GroupStateTimeout.NoTimeout)
