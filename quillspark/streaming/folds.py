"""Stateful folds over frames of one key, shared by batch and streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

# Fixed values, in milliseconds, and the energy from which a frame is speech.
MIN_MS, SILENCE_MS, MAX_MS, SPEECH = 1200.0, 650.0, 14_000.0, 0.015
AUTO_STOP_MS, MEANINGFUL_MS = 60_000.0, 250.0


@dataclass
class Segmenter:
    """Cuts a stream of frames at silences after speech, or when a segment gets too long."""

    min_ms: float = MIN_MS
    silence_ms: float = SILENCE_MS
    max_ms: float = MAX_MS
    threshold: float = SPEECH
    start: float = 0.0
    length: float = 0.0
    quiet: float = 0.0
    speech: bool = False

    def add(self, energy: float, duration: float) -> tuple | None:
        """The segment ``start, stop, has_speech, reason`` that a frame closes, if any."""
        self.length += duration
        if energy >= self.threshold:
            self.speech, self.quiet = True, 0.0
        elif self.speech:
            self.quiet += duration
        if self.length >= max(self.min_ms, self.max_ms):
            return self.close("max-duration")
        if self.speech and self.length >= self.min_ms and self.quiet >= self.silence_ms:
            return self.close("speech-boundary")
        return None

    def close(self, reason: str = "stop") -> tuple | None:
        if not self.length:
            return None
        out = (self.start, self.start + self.length, self.speech, reason)
        self.start, self.length, self.quiet, self.speech = self.start + self.length, 0.0, 0.0, False
        return out


def segment_frames(frames: Iterable[tuple[float, float]], **options: float) -> Iterator[tuple]:
    """Segments of ``energy, duration`` frames, the rest as a last one."""
    state = Segmenter(**options)
    for energy, duration in frames:
        if done := state.add(energy, duration):
            yield done
    if done := state.close():
        yield done


def auto_stop(frames: Iterable[tuple[float, float, float]], timeout: float = AUTO_STOP_MS, meaningful: float = MEANINGFUL_MS, threshold: float = SPEECH) -> float | None:
    """When a recording of ``time, energy, duration`` frames stops by itself, or None.

    It arms after enough speech in a row and stops once that many milliseconds pass
    without any.
    """
    heard, armed, deadline = 0.0, False, None
    for time, energy, duration in frames:
        if deadline is not None and time >= deadline:
            return deadline
        if energy >= threshold:
            heard += duration
            armed = armed or heard >= meaningful
            deadline = None if armed else deadline
        elif not armed:
            heard = 0.0
        elif deadline is None:
            deadline = time + timeout
    return deadline


def coalesce_requests(requests: Iterable[float], cost: float) -> Iterator[tuple[float, float, int]]:
    """Runs ``start, end, requests`` of one worker: what is asked while it runs makes one more run, at once after it."""
    start = end = float("-inf")
    now = waiting = 0
    for at in requests:
        while waiting and at >= end:
            yield start, end, now
            start, end, now, waiting = end, end + cost, waiting, 0
        if at < end:
            waiting += 1
            continue
        if now:
            yield start, end, now
        start, end, now = at, at + cost, 1
    if now:
        yield start, end, now
    if waiting:
        yield end, end + cost, waiting


@dataclass
class Job:
    key: str
    priority: int
    sequence: int
    cost: float
    preemptible: bool = False
    started: float = 0.0


@dataclass
class Scheduler:
    """A replay of a bounded priority queue: duplicates join, the least urgent gives way."""

    slots: int = 1
    capacity: int = 8
    queue: list[Job] = field(default_factory=list)
    active: list[Job] = field(default_factory=list)
    log: list[tuple[float, str, str]] = field(default_factory=list)

    def submit(self, now: float, job: Job) -> None:
        self.advance(now)
        if any(x.key == job.key for x in self.queue + self.active):
            self.log.append((now, job.key, "joined"))
            return
        if len(self.queue) >= self.capacity:
            # Of those no more urgent: the least urgent, and of these the oldest.
            victims = [x for x in self.queue if x.priority >= job.priority]
            if not victims:
                self.log.append((now, job.key, "refused"))
                return
            victim = max(victims, key=lambda x: (x.priority, -x.sequence))
            self.queue.remove(victim)
            self.log.append((now, victim.key, "displaced"))
        self.queue.append(job)
        if len(self.active) >= self.slots:
            # Of those that may be interrupted and are less urgent: the least urgent, and of these the newest.
            weaker = [x for x in self.active if x.preemptible and x.priority > job.priority]
            if weaker:
                victim = max(weaker, key=lambda x: (x.priority, x.sequence))
                self.active.remove(victim)
                self.queue.append(victim)
                self.log.append((now, victim.key, "preempted"))
        self._fill(now)

    def _fill(self, now: float) -> None:
        while self.queue and len(self.active) < self.slots:
            job = min(self.queue, key=lambda x: (x.priority, x.sequence))
            self.queue.remove(job)
            job.started = now
            self.active.append(job)
            self.log.append((now, job.key, "started"))

    def advance(self, now: float) -> None:
        """Finishes what ends until ``now``."""
        while self.active and (first := min(self.active, key=lambda x: (x.started + x.cost, x.sequence))).started + first.cost <= now:
            self.active.remove(first)
            self.log.append((first.started + first.cost, first.key, "finished"))
            self._fill(first.started + first.cost)


def replay(jobs: Iterable[tuple[float, Job]], slots: int = 1, capacity: int = 8) -> list[tuple[float, str, str]]:
    state = Scheduler(slots, capacity)
    for now, job in jobs:
        state.submit(now, job)
    state.advance(float("inf"))
    return state.log


def recycle_epochs(requests: Iterable[tuple[float, float]], most: int = 25, age_ms: float = 300_000.0) -> Iterator[int]:
    """For each ``start, end`` request the number of resets before it: after so many requests or so much time, when idle."""
    epoch, count, born, busy = 0, 0, None, float("-inf")
    for start, end in requests:
        idle = start >= busy
        if born is not None and idle and (count >= most or start - born >= age_ms):
            epoch, count, born = epoch + 1, 0, None
        born = start if born is None else born
        count += 1
        busy = max(busy, end)
        yield epoch
