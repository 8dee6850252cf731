"""From a definition to a running stream: resume decision, feed, runner, heartbeat, reports, supervision, and leadership where asked for."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import instance_id
from tidemark.operators.resume import Position, Resume, is_valid, positions, probe, resolve
from tidemark.plans.spec import CheckpointPolicy, Sources, StreamSpec
from tidemark.sources.feed import stream_feed
from tidemark.stores.memory import MemoryCheckpoints, MemoryDeadLetters
from tidemark.streaming.anchors import IdleHeartbeat
from tidemark.streaming.manager import LeaderElection, Supervisor
from tidemark.streaming.metrics import NoMetrics
from tidemark.streaming.runner import Flusher, StillAtWorkError, StrictRunner, utc_now

# Fixed: seconds between reports of backlog and history.
REPORT_SECONDS = 60
# Fixed: seconds between attempts to record a position that has been proven.
ESTABLISH_SECONDS = 5
# A query that takes longer to start, or a batch to give its first row, counts as silent.
START_SECONDS = 60
TAIL_SECONDS, STOP_SECONDS = 1, 30
ROLES = ("stream", "heartbeat", "resume-validation")


@contextmanager
def attributed(spark: SparkSession, role: str, stream: str) -> Iterator[None]:
    """Spark jobs inside carry the stream's name and what they are for."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(f"tidemark:{stream}" if role == "stream" else f"tidemark-{role}:{stream}")
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


def position_of(feed: DataFrame, oldest: str | None = None, now: Callable[[], datetime] = utc_now) -> Position:
    """What the resume cascade asks, answered by a feed in batch form; ``oldest``: the first token still kept."""
    kept = feed if oldest is None else feed.where(F.col("resume_token") >= oldest)

    def bounds() -> Any:
        return positions(kept).first()

    def first() -> tuple[str, datetime] | None:
        row = bounds()
        return None if row.oldest_token is None else (row.oldest_token, row.oldest_time)

    def valid(token: str) -> bool:
        return bool(positions(kept).select(is_valid(F.lit(token), F.col("oldest_token"), F.col("head_token"))).first()[0])

    return Position(lambda: bounds().head_token, first, valid, now)


@dataclass
class Launcher:
    """Starts streams over one feed table.

    ``feed`` gives the feed in batch form, for positions and probes; ``shape`` brings the source's rows into its form. Without an anchor
    to go on from, a generation starts where the cascade says; Spark's own offset log, under ``folder``, has the last word once there is one.
    ``current`` gives a stream's collection as it is now, for UPDATE_LOOKUP; ``locks`` and ``instance`` hold leases of SINGLE_LEADER streams.
    """

    spark: SparkSession
    path: str
    folder: str
    feed: Callable[[], DataFrame]
    shape: Callable[[DataFrame], DataFrame]
    checkpoints: Any = None
    letters: Any = None
    metrics: Any = None
    batch_events: int = 10_000
    sleep: Callable[[float], None] | None = None
    current: Callable[[StreamSpec], DataFrame] | None = None
    locks: Any = None
    instance: str | None = None

    def __post_init__(self):
        self.checkpoints = self.checkpoints or MemoryCheckpoints()
        self.letters = self.letters or MemoryDeadLetters()
        self.metrics = self.metrics or NoMetrics()

    def decide(self, spec: StreamSpec, allow_oldest: bool = True) -> Resume:
        policy = spec.checkpoint
        if policy is None or policy.start == "LATEST":
            return Resume("LATEST")
        with attributed(self.spark, "resume-validation", spec.name):
            return resolve(spec.name, self.checkpoints, position_of(self.feed()), policy.on_history_lost, spec.reconcile, allow_oldest, self.metrics)

    def run(self, spec: StreamSpec, generation: int = 1, supervisor: Supervisor | None = None, tail: bool = False, stop: threading.Event | None = None, at_work: Callable[[StrictRunner], None] = lambda r: None) -> StrictRunner:
        """One generation: until the feed's end, or with ``tail`` until ``stop`` is set; raises what ends it early."""
        start = self.decide(spec, not (supervisor and supervisor.from_oldest_failed))
        options: dict[str, Any] = {"path": self.path, "maxEventsPerBatch": self.batch_events}
        if start.token is not None:
            options["startAfter"] = int(start.token)
        elif start.decision == "LATEST":
            options["latest"] = "true"
        fresh = start.decision in ("LATEST", "FROM_NOW", "FROM_OLDEST", "BOOTSTRAP")
        location = f"{self.folder.rstrip('/')}/{spec.name}" + (f"-{uuid.uuid4()}" if fresh or generation > 1 else "")
        current = self.current and (lambda: self.current(spec))
        runner = StrictRunner(spec, self.checkpoints, self.letters, self.metrics, current=current, **({"sleep": self.sleep} if self.sleep else {}))
        beat = self.heartbeat(spec, runner)
        beat.seed(start.token)
        at_work(runner)
        unproven, tried = start.dead_token is not None, -ESTABLISH_SECONDS

        def settled(token: str) -> None:
            nonlocal unproven, tried
            if unproven and time.monotonic() - tried >= ESTABLISH_SECONDS:  # the new position is proven by what came through
                tried = time.monotonic()
                try:
                    self.checkpoints.reset_after_history_lost(spec.name, start.dead_token, token, utc_now())
                    unproven = False
                except Exception as error:
                    self.metrics.on_checkpoint_failed(spec.name, error)
            if supervisor is not None:
                supervisor.prove()
            beat.progress(token)

        runner.on_settled = settled
        flusher = None
        with attributed(self.spark, "stream", spec.name):
            query = runner.start(self.shape(stream_feed(self.spark, location, **options)), location, seconds=TAIL_SECONDS if tail else 0)
            began = time.monotonic()

            def working() -> bool:
                since = runner.fetching or (None if runner.batches or query.lastProgress else began)
                return since is not None and time.monotonic() - since < START_SECONDS

            beat.working = working
            if runner.anchor is not None:
                waits = [s for s in (spec.checkpoint.save_seconds, spec.checkpoint.heartbeat_seconds) if s]
                flusher = Flusher(runner.anchor, min(waits, default=60), beat)
                flusher.start()
            try:
                if tail:
                    self._watch(query, spec, runner, flusher, stop or threading.Event())
                else:
                    query.processAllAvailable()
            finally:
                beat.cancel()
                if flusher is not None:
                    flusher.stop()
                runner.halt(STOP_SECONDS)
                try:
                    self._leave(query, runner)
                finally:
                    query.stop()
                    if runner.anchor is not None:
                        runner.anchor.close()
        return runner

    def _leave(self, query: Any, runner: StrictRunner) -> None:
        """Until no batch is at work; an error if one can't be ended."""
        try:
            runner.left(STOP_SECONDS)
        except StillAtWorkError:  # it waits for its first row
            self.spark.sparkContext.cancelJobGroup(query.runId)
            runner.left(STOP_SECONDS)

    def _watch(self, query: Any, spec: StreamSpec, runner: StrictRunner, flusher: Flusher | None, stop: threading.Event) -> None:
        """Until the stream is stopped, is found stuck, or ends by itself; reports meanwhile."""
        reported = time.monotonic()
        while not query.awaitTermination(0.5):
            if stop.is_set():
                return
            if flusher is not None and flusher.error is not None:
                raise flusher.error
            if time.monotonic() - reported >= REPORT_SECONDS:
                reported = time.monotonic()
                with suppress(Exception):
                    self.report(spec)

    def heartbeat(self, spec: StreamSpec, runner: StrictRunner) -> IdleHeartbeat:
        """An idle heartbeat whose probes use the stream's own compiled pipeline."""
        pipeline = spec.compiled()

        def ask(at: str | None) -> tuple[str, str | None]:
            with attributed(self.spark, "heartbeat", spec.name):
                return probe(self.feed(), pipeline, at)

        beat = IdleHeartbeat(spec.name, self.checkpoints, spec.checkpoint or CheckpointPolicy(), ask, runner.gate, self.metrics)
        beat.seed(runner.anchor.latest[0] if runner.anchor and runner.anchor.latest else None)
        return beat

    def report(self, spec: StreamSpec) -> None:
        """Backlog and history held, as reported every REPORT_SECONDS."""
        self.metrics.on_backlog(spec.name, self.letters.count_pending(spec.name))
        from tidemark.operators.resume import window_stats

        row = window_stats(self.feed()).first()
        self.metrics.on_oplog_stats(row.window_hours, row.status)

    def launch(self, spec: StreamSpec, tail: bool = True) -> Running | Elected:
        """The stream at work, until it is stopped; a SINGLE_LEADER stream only while this instance holds its lease."""
        if spec.deployment == "SINGLE_LEADER" and self.locks is not None:
            return Elected(self, spec, self.instance or instance_id(spec.name, os.getpid()), tail)
        return Running(self, spec, tail)


def launch_from(sources: Sources) -> Callable[[StreamSpec], Running | Elected]:
    """For a manager: each stream is launched by the launcher of its source."""
    return lambda spec: sources.get(spec.source).launch(spec)


class Running:
    """A stream at work in a thread of its own, as the manager holds it."""

    def __init__(self, launcher: Launcher, spec: StreamSpec, tail: bool = True):
        self.runner: StrictRunner | None = None
        self.error: BaseException | None = None
        self._ended = threading.Event()
        run = lambda n: launcher.run(spec, n, self.supervisor, tail, self._ended, self._hold)
        self.supervisor = Supervisor(spec.name, run, spec.restart, launcher.metrics, launcher.sleep or (lambda s: self._ended.wait(s)))
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _hold(self, runner: StrictRunner) -> None:
        self.runner = runner
        if self._ended.is_set():
            runner.halt(0)

    def _run(self) -> None:
        try:
            self.supervisor.run()
        except Exception as error:
            self.error = error

    @property
    def last_event_time(self) -> datetime | None:
        return self.runner and self.runner.last_event_time

    def is_running(self) -> bool:
        return self._thread.is_alive()

    def join(self, seconds: float | None = None) -> None:
        self._thread.join(seconds)

    def stop(self) -> None:
        """Ends the query. When this returns no handler is at work any more, unless it takes longer than STOP_SECONDS."""
        self.supervisor.stop()
        self._ended.set()
        if self.runner is not None:
            self.runner.halt(STOP_SECONDS)
        self.join(STOP_SECONDS)


def elected(launcher: Launcher, spec: StreamSpec, locks: Any, instance: str, tail: bool = True) -> LeaderElection:
    """Leader election for a SINGLE_LEADER stream: it runs while this instance holds the lease."""
    election = LeaderElection(spec.name, locks, instance, lambda: None, lambda: None, launcher.metrics)
    election.held = None

    def lead() -> None:
        election.held = Running(launcher, spec, tail)

    def lose() -> None:
        held, election.held = election.held, None
        if held is not None:
            held.stop()

    election.on_lead, election.on_lose = lead, lose
    return election


class Elected:
    """A SINGLE_LEADER stream: takes its turns in the election, and runs while it leads."""

    def __init__(self, launcher: Launcher, spec: StreamSpec, instance: str, tail: bool = True):
        self.election = elected(launcher, spec, launcher.locks, instance, tail)
        self.error: BaseException | None = None
        self._ended = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        wait, turn = 0.0, time.monotonic()
        try:
            while not self._ended.wait(min(1.0, max(0.0, turn + wait - time.monotonic()))):
                held = self.election.held
                if held is not None and not held.is_running():  # ended for good
                    self.error = held.error
                    return
                if time.monotonic() >= turn + wait:
                    turn, wait = time.monotonic(), self.election.step()
        except Exception as error:
            self.error = error
        finally:
            self.election.resign()

    @property
    def last_event_time(self) -> datetime | None:
        return self.election.held and self.election.held.last_event_time

    def is_running(self) -> bool:
        """At work, or standing by."""
        return self._thread.is_alive()

    def join(self, seconds: float | None = None) -> None:
        self._thread.join(seconds)

    def stop(self) -> None:
        self._ended.set()
        self.join(2 * STOP_SECONDS)
