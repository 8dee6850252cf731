"""The processed anchor of a stream and its liveness: when positions are written, and when a silent stream is stuck."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from tidemark.operators.resume import StreamStuckError
from tidemark.plans.spec import CheckpointPolicy
from tidemark.streaming.metrics import NoMetrics


class ProcessedAnchor:
    """Writes the last settled token when ``save_every`` settlements are owed or, if any is, when ``flush`` comes by.

    What is owed is counted from the last confirmed write. A write that fails is reported and stays owed; it never stops the stream. A closed
    anchor writes nothing: what a stopped generation still has at hand must not overwrite its successor's position.
    """

    def __init__(self, stream: str, store: Any, policy: CheckpointPolicy, metrics: Any = None):
        self.stream, self.store, self.policy, self.metrics = stream, store, policy, metrics or NoMetrics()
        self.latest: tuple[str, datetime] | None = None
        self.confirmed: str | None = None
        self.owed = 0
        self.closed = False
        self.before_write: Callable[[], None] = lambda: None
        self._lock = threading.RLock()

    def _write(self) -> bool:
        if self.closed:
            return False
        token, at = self.latest
        try:
            self.before_write()
            self.store.save_processed(self.stream, token, at)
        except Exception as error:
            self.metrics.on_checkpoint_failed(self.stream, error)
            return False
        self.confirmed, self.owed = token, 0
        self.metrics.on_checkpoint(self.stream, token)
        return True

    def settle(self, token: str, at: datetime) -> None:
        with self._lock:
            self.latest = (token, at)
            self.owed = 0 if token == self.confirmed else self.owed + 1
            if self.owed >= self.policy.save_every:
                self._write()

    def flush(self) -> bool:
        with self._lock:
            return not self.closed and self.latest is not None and self.latest[0] != self.confirmed and self._write()

    def save_now(self, token: str, at: datetime) -> bool:
        """The early acknowledgement of a handler; tells whether it is durable."""
        with self._lock:
            self.latest = (token, at)
            return self._write()

    def close(self, flush: bool = True) -> None:
        with self._lock:
            if flush:
                self.flush()
            self.closed = True


class Turns:
    """How far a strict query has come inside a micro-batch: after each ``events`` settled events their last number, as an empty file's name.

    A micro-batch costs Spark a good part of a second however small it is, so a long backlog is planned in large ones; a query that starts again
    gets its last one whole, and goes on after the last turn that ended. The files lie in the query's checkpoint location; two at most are kept.
    """

    def __init__(self, spark: SparkSession, location: str, events: int):
        self.events = events
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._folder = f"{location.rstrip('/')}/turns"
        folder = self._path(self._folder)
        self._store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._store.mkdirs(folder)
        self._kept = sorted(name for status in self._store.listStatus(folder) if (name := status.getPath().getName()).isdigit())

    @property
    def last(self) -> int | None:
        return int(self._kept[-1]) if self._kept else None

    def ended(self, seq: int) -> None:
        self._store.createNewFile(self._path(f"{self._folder}/{seq:019d}"))
        self._kept.append(f"{seq:019d}")
        while len(self._kept) > 2:
            self._store.delete(self._path(f"{self._folder}/{self._kept.pop(0)}"), False)


class LivenessGate:
    """Who may act on a stream: a handler, the stuck verdict or a repair; one at a time."""

    def __init__(self):
        self.state = "IDLE"
        self._free = threading.Condition()

    def enter(self) -> bool:
        """Before an event is handled. A repair makes it wait; a stuck generation drops it, to be delivered again."""
        with self._free:
            while self.state == "REPAIRING":
                self._free.wait()
            if self.state == "STUCK":
                return False
            self.state = "HANDLING"
            return True

    def leave(self) -> None:
        with self._free:
            if self.state == "HANDLING":
                self.state = "IDLE"
                self._free.notify_all()

    def drained(self, seconds: float | None = None) -> bool:
        """Wait until no handler is at work."""
        with self._free:
            return self._free.wait_for(lambda: self.state != "HANDLING", seconds)

    def _claim(self, state: str) -> bool:
        with self._free:
            if self.state != "IDLE":
                return False
            self.state = state
            return True

    def claim_stuck(self) -> bool:
        return self._claim("STUCK")

    def begin_repair(self) -> bool:
        return self._claim("REPAIRING")

    def end_repair(self) -> None:
        with self._free:
            if self.state == "REPAIRING":
                self.state = "IDLE"
                self._free.notify_all()


class IdleHeartbeat:
    """Probes a stream that makes no progress, and certifies its position.

    ``probe`` takes the position and returns (EMPTY, certified token), (EVENT_PENDING, None) or (FAILED, None). A certified position is
    written before it is published, and only if no event has moved the position meanwhile. ``stuck_after_probes`` sights of
    waiting events at one position, with no handler at work, are a stuck stream. While ``working`` tells that the stream starts or fetches,
    its silence means nothing and it isn't probed.
    """

    def __init__(self, stream: str, store: Any, policy: CheckpointPolicy, probe: Callable[[str | None], tuple[str, str | None]], gate: LivenessGate, metrics: Any = None, clock: Callable[[], float] = time.monotonic, now: Callable[[], datetime] = datetime.now):
        self.stream, self.store, self.policy, self.probe, self.gate = stream, store, policy, probe, gate
        self.metrics, self.clock, self.now = metrics or NoMetrics(), clock, now
        self.working: Callable[[], bool] = lambda: False
        self.position: str | None = None
        self.moved_at = self.probed_at = clock()
        self.abstentions = self.failures = 0
        self.cancelled = False
        self._lock = threading.Lock()

    def seed(self, token: str | None) -> None:
        """The resume position starts the chain; it isn't a settlement."""
        self.position, self.moved_at = token, self.clock()

    def progress(self, token: str) -> None:
        with self._lock:
            self.position, self.moved_at, self.abstentions = token, self.clock(), 0

    def tick(self) -> str | None:
        """Probe if the stream has been idle for the interval; the outcome, or None when there was no need."""
        wait, now = self.policy.heartbeat_seconds, self.clock()
        if self.working():
            with self._lock:
                self.moved_at = now
            return None
        if self.cancelled or wait == 0 or now - self.moved_at < wait or now - self.probed_at < wait:
            return None
        self.probed_at = now
        asked = self.position
        outcome, token = self.probe(asked)
        if self.cancelled or self.working():  # meanwhile
            return None
        if outcome == "EMPTY":
            self.failures = self.abstentions = 0
            self._certify(asked, token)
        elif outcome == "EVENT_PENDING":
            self.failures = 0
            self.abstentions = self.abstentions + 1 if asked == self.position else 0
            if self.policy.stuck_after_probes and self.abstentions >= self.policy.stuck_after_probes and self.gate.claim_stuck():
                raise StreamStuckError(self.stream, self.abstentions, self.clock() - self.moved_at)
        else:
            self.failures += 1
            self.metrics.on_probe_failed(self.stream, None)
        return outcome

    def _certify(self, asked: str | None, token: str | None) -> None:
        if token is None or token == asked:
            self.store.save_heartbeat(self.stream, self.now())
            return
        at = self.now()
        self.store.save_seen(self.stream, token, at, at)
        with self._lock:
            if self.position == asked:
                self.position = token

    def repair(self, move: Callable[[], str | None]) -> bool:
        """Move the position in place while no handler is at work; False if one is. ``move`` gives the new position."""
        if not self.gate.begin_repair():
            return False
        try:
            self.seed(move())
            return True
        finally:
            self.gate.end_repair()

    def cancel(self) -> None:
        self.cancelled = True
