"""Runs a stream definition over a feed: strictly in order, by key in parallel, or with a vectorised handler."""

from __future__ import annotations

import contextlib
import hashlib
import inspect
import math
import threading
import time
import traceback
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import canonical_json, document_key_json, expiry
from tidemark.operators.resume import StreamStuckError
from tidemark.plans.spec import DeadLetterPolicy, StreamSpec, resolve_error, takes
from tidemark.sources.envelope import LIFECYCLE
from tidemark.stores.memory import ErrorInfo, FailedEvent, NoCheckpoints, NoDeadLetters
from tidemark.streaming.anchors import LivenessGate, ProcessedAnchor, Turns
from tidemark.streaming.metrics import NoMetrics

BACKLOG_SECONDS = 5
STACKS = 1000
KEYED_EVENTS = 50_000
META = ("seq", "resume_token", "operation_type", "db", "coll", "document_key", "cluster_time", "wall_time", "before", "update_description", "lsid", "txn_number")


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None, microsecond=0)


class ManualDlq(Exception):
    """What a handler's own request is recorded as."""


class StoppedError(RuntimeError):
    """The runner was told to stop; the batch at work isn't settled and comes again."""


class StillAtWorkError(RuntimeError):
    """A batch is at work after the time it had to end; nothing may run in its place."""


class DisorderError(RuntimeError):
    """The source's partitions aren't in the feed's order."""


class ActionUnavailableError(RuntimeError):
    """A manual action of a stream without the policy it needs."""


def as_values(document: Any) -> Any:
    """A typed document as the plain values that a letter holds."""
    return document if document is None or isinstance(document, dict) else document._asdict() if hasattr(document, "_asdict") else dict(vars(document))


@dataclass
class Context:
    """One event as its handler sees it."""

    row: Row
    stream: str
    runner: Any = None
    attempt: int = 1
    document_type: Any = dict
    metadata: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name == "row":
            raise AttributeError(name)
        try:
            return self.row[name]
        except (ValueError, KeyError):
            if name in META:
                return None
            raise AttributeError(name) from None

    @property
    def document(self) -> Any:
        """Null after a DELETE. A dict, or an object of the stream's document type."""
        if self.row["operation_type"] == "DELETE":
            return None
        values = self.row.asDict(recursive=True)
        if "document" in values:  # by the stream's full-document mode
            return self.typed(values["document"])
        whole = values.get("full_document")
        return self.typed(whole if whole is not None else {k: v for k, v in values.items() if k not in META and k not in ("full_document", "_accepted")})

    def typed(self, values: dict[str, Any] | None) -> Any:
        """The document as the stream's document type, which is called with those values that it takes."""
        if values is None or self.document_type in (dict, None):
            return values
        names = inspect.signature(self.document_type).parameters
        takes_all = any(p.kind is p.VAR_KEYWORD for p in names.values())
        return self.document_type(**{k: v for k, v in values.items() if takes_all or k in names})

    @property
    def transaction(self) -> tuple[str, int] | None:
        both = (self.lsid, self.txn_number)
        return both if None not in both else None

    @property
    def event_id(self) -> str:
        return hashlib.sha256(f"{self.stream}|{self.row['resume_token']}".encode()).hexdigest()

    def add_metadata(self, key: str, value: Any) -> None:
        self.metadata[key] = value

    def save_checkpoint_now(self) -> bool:
        return self.runner.save_now(self)

    def send_to_dead_letters(self, reason: str) -> None:
        self.runner.send_manually(self, reason)


class Attempts:
    """The attempt loop of one event: handler, error action, retries, dead letter."""

    def __init__(self, spec: StreamSpec, letters: Any = None, metrics: Any = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = utc_now):
        self.spec, self.letters, self.metrics, self.sleep, self.now = spec, letters or NoDeadLetters(), metrics or NoMetrics(), sleep, now
        self.counted: float | None = None
        self._forms: dict[int, tuple[Callable, str]] = {}  # with the handler, so that no other one gets its number
        self._stacks: dict[tuple, str] = {}

    def call(self, handler: Callable, context: Context) -> None:
        known = self._forms.get(id(handler))
        if known is None:
            known = self._forms[id(handler)] = (handler, takes(handler))
        form = known[1]
        if form == "context":
            handler(context)
        elif form == "document":
            handler(context.document)
        else:
            handler(context.document, context)

    def stack(self, error: BaseException) -> str:
        """As traceback.format_exception has it; the frames of errors from one place are formatted once."""
        at, places = error.__traceback__, []
        while at is not None:
            places.append((at.tb_frame.f_code, at.tb_lasti))
            at = at.tb_next
        if not places or error.__cause__ is not None or error.__context__ is not None or isinstance(error, (BaseExceptionGroup, SyntaxError)):
            return "".join(traceback.format_exception(error))
        places = tuple(places)
        if places not in self._stacks:
            if len(self._stacks) >= STACKS:
                self._stacks.clear()
            self._stacks[places] = "".join(traceback.format_tb(error.__traceback__))
        return "".join(["Traceback (most recent call last):\n", self._stacks[places], *traceback.format_exception_only(error)])

    def run(self, handler: Callable, context: Context) -> str:
        """HANDLED, SKIPPED or DEAD_LETTER. An interrupted wait leaves the event unsettled: it escapes as it is."""
        spec, first = self.spec, self.now()
        while True:
            started = time.perf_counter_ns()
            try:
                self.call(handler, context)
                self.metrics.on_event_processed(spec.name, time.perf_counter_ns() - started, True)
                return "HANDLED"
            except Exception as caught:
                error = caught
            self.metrics.on_event_processed(spec.name, time.perf_counter_ns() - started, False)
            action = resolve_error(spec.errors, error, context)
            if action == "RETRY":
                again = spec.retry is not None and context.attempt < spec.retry.max_attempts
            else:
                again = action == "RETHROW" and spec.retry is not None and spec.retry.should_retry(error, context.attempt)
            self.metrics.on_event_error(spec.name, error, again, context.attempt)
            if again:
                self.sleep(spec.retry.delay_ms(context.attempt) / 1000)
                context.attempt += 1
                continue
            if action == "SKIP":
                return "SKIPPED"
            self.dead_letter(context, error, first)
            return "DEAD_LETTER"

    def letter(self, context: Context, error: BaseException, first: datetime, policy: DeadLetterPolicy, stack: bool) -> FailedEvent:
        now = self.now()
        trace = self.stack(error) if stack else None
        return FailedEvent(
            id=context.event_id, stream_name=self.spec.name, operation_type=context.operation_type, document_key=document_key_json(context.document_key), full_document=canonical_json(as_values(context.document)) if policy.include_document else None,
            resume_token=context.resume_token, error=ErrorInfo(type(error).__name__, str(error), trace), attempts=context.attempt, first_attempt_at=first, last_attempt_at=now, created_at=now,
            expires_at=expiry(now, policy.retention_days), metadata={k: str(v) for k, v in context.metadata.items()},
        )

    def dead_letter(self, context: Context, error: BaseException, first: datetime) -> None:
        """Write a letter if the stream has the policy. A store that fails is reported; the event is settled all the same."""
        policy = self.spec.dead_letters
        if policy is None or not policy.enabled:
            return
        try:
            self.letters.save(self.letter(context, error, first, policy, policy.include_stack))
        except Exception as failure:
            self.metrics.on_dead_letter_failed(self.spec.name, failure)
            return
        self.metrics.on_event_dead_lettered(self.spec.name)
        self.backlog()

    def backlog(self) -> None:
        """The gauge of waiting letters, counted at most every BACKLOG_SECONDS, if anything takes it; a count that fails says nothing of the letters."""
        if type(self.metrics) is NoMetrics:
            return
        if self.counted is None or time.monotonic() - self.counted >= BACKLOG_SECONDS:
            self.counted = time.monotonic()
            with contextlib.suppress(Exception):
                self.metrics.on_backlog(self.spec.name, self.letters.count_pending(self.spec.name))


class StopStream(Exception):
    """A lifecycle event ended the stream. ``restart``: whether it may start afresh."""

    def __init__(self, cause: str, restart: bool):
        super().__init__(cause)
        self.cause, self.restart = cause, restart


class StrictRunner:
    """One event at a time, in order; every event is settled before the next, and only settlements move the processed anchor.

    A micro-batch is bounded by its source and read partition by partition. If an event is not settled (its handler's wait was
    interrupted, a filter failed), the batch fails there and is delivered again, with ``turn_events`` from the last turn on: dead letters
    have ids that a replay repeats. A store of letters that holds some back (it has ``flush``) writes them before an anchor or a turn passes them.
    """

    def __init__(self, spec: StreamSpec, checkpoints: Any = None, letters: Any = None, metrics: Any = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = utc_now, current: Callable[[], DataFrame] | None = None):
        self.spec, self.metrics, self.now, self.current = spec, metrics or NoMetrics(), now, current
        self.letters = letters or NoDeadLetters()
        self.attempts = Attempts(spec, self.letters, self.metrics, sleep, now)
        self.anchor = ProcessedAnchor(spec.name, checkpoints or NoCheckpoints(), spec.checkpoint, self.metrics) if spec.checkpoint else None
        self.flush_letters: Callable[[], None] = getattr(self.letters, "flush", lambda: None)
        if self.anchor is not None:
            self.anchor.before_write = self.flush_letters
        self.gate = LivenessGate()
        self.turns: Turns | None = None
        self.pipeline = spec.compiled()
        self.cause: str | None = None
        self.last_event_time: datetime | None = None
        self.outcomes: dict[str, int] = {}
        self.stopped = threading.Event()
        self._at_work = threading.Lock()
        self.batches = 0
        self.fetching: float | None = None
        self.on_settled: Callable[[str], None] = lambda token: None

    def save_now(self, context: Context) -> bool:
        if self.anchor is None:
            raise ActionUnavailableError(f"{self.spec.name} has no checkpoint policy")
        if context.operation_type in LIFECYCLE:
            return False
        return self.anchor.save_now(context.resume_token, self.now())

    def send_manually(self, context: Context, reason: str) -> None:
        """A handler's own letter: no stack, kept for ever unless the stream has a policy. A store's error reaches the handler."""
        if self.anchor is None:
            raise ActionUnavailableError(f"{self.spec.name} has no checkpoint policy")
        policy = self.spec.dead_letters or DeadLetterPolicy(retention_days=0)
        self.letters.save(self.attempts.letter(context, ManualDlq(reason), self.now(), policy, False))
        self.metrics.on_event_dead_lettered(self.spec.name)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Pipeline, and a Column filter as a flag, so that both run in the scan; then the images that the stream asks for."""
        out = with_images(self.spec, self.pipeline(df), self.current)
        return out.withColumn("_accepted", F.coalesce(self.spec.filter, F.lit(False))) if isinstance(self.spec.filter, Column) else out

    def event(self, row: Row) -> str:
        if self.stopped.is_set():
            raise StoppedError(self.spec.name)
        context = Context(row, self.spec.name, self, document_type=self.spec.document_type)
        self.metrics.on_event_received(self.spec.name, context)
        operation = row["operation_type"]
        if operation in ("DROP", "DROP_DATABASE", "RENAME"):
            self.cause = operation
        if operation == "INVALIDATE":
            cause = self.cause or "DROP"
            strategy = self.spec.checkpoint.on_history_lost if self.spec.checkpoint else "RESUME_FROM_NOW"
            self.metrics.on_stream_invalidated(self.spec.name, cause)
            raise StopStream(cause, cause != "RENAME" and strategy != "FAIL")
        if not self.gate.enter():
            return "DROPPED"
        try:
            if self.stopped.is_set():  # meanwhile
                raise StoppedError(self.spec.name)
            handler = self.spec.handler(operation)
            if handler is None:
                outcome = "NO_HANDLER"
            elif not self.accepts(row, context):
                outcome = "FILTERED"
            else:
                outcome = self.attempts.run(handler, context)
        finally:
            self.gate.leave()
        self.last_event_time, token = self.now(), row["resume_token"]
        if self.anchor is not None and operation not in LIFECYCLE:
            self.anchor.settle(token, row["cluster_time"] or self.last_event_time)
        self.on_settled(token)
        return outcome

    def accepts(self, row: Row, context: Context) -> bool:
        if self.spec.filter is None:
            return True
        return bool(row["_accepted"]) if isinstance(self.spec.filter, Column) else bool(self.spec.filter(context))

    def batch(self, df: DataFrame, batch_id: int = 0) -> None:
        """foreachBatch function."""
        with self._at_work:
            if self.stopped.is_set():
                raise StoppedError(self.spec.name)
            self.fetching = time.monotonic()
            if self.turns is not None and not self.batches and self.turns.last is not None:  # of this batch or an earlier one
                df = df.where(F.col("seq") > self.turns.last)
            last, done, rows = None, 0, self.prepared(df)
            for row in (rows.orderBy("seq") if looks_up(self.spec, self.current) else rows.sortWithinPartitions("seq")).toLocalIterator():
                seq = row["seq"]
                if last is not None and seq < last:
                    raise DisorderError(f"{self.spec.name}: event {seq} after {last}; the source must give its partitions in the feed's order")
                last = seq
                outcome = self.event(row)
                self.outcomes[outcome] = self.outcomes.get(outcome, 0) + 1
                if outcome != "DROPPED" and self.turns is not None:
                    done += 1
                    if done % self.turns.events == 0:
                        self.flush_letters()
                        self.turns.ended(last)
            self.flush_letters()
            self.batches, self.fetching = self.batches + 1, None

    def halt(self, seconds: float | None = None) -> bool:
        """No event is delivered any more; waits for the handler at work, if any."""
        self.stopped.set()
        return self.gate.drained(seconds)

    def left(self, seconds: float) -> None:
        """After ``halt``: wait until no batch is at work; an error if one still is. A query stopped while its batch talks to Spark may leave both waiting for each other."""
        if not self._at_work.acquire(timeout=seconds):
            raise StillAtWorkError(f"{self.spec.name}: a batch is still at work after {seconds} s")
        self._at_work.release()

    def start(self, feed: DataFrame, checkpoint_location: str, available_now: bool = False, seconds: float | None = None, turn_events: int | None = None) -> StreamingQuery:
        """A streaming query named after the stream. LATEST needs a new location for each start, as Spark resumes from an old one."""
        if turn_events is not None:
            self.turns = Turns(feed.sparkSession, checkpoint_location, turn_events)
        if seconds is None:
            seconds = max(self.spec.checkpoint.save_seconds if self.spec.checkpoint else 0, 1)
        writer = feed.writeStream.queryName(self.spec.name).foreachBatch(self.batch).option("checkpointLocation", checkpoint_location)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{int(1000 * seconds)} milliseconds")
        self.metrics.on_stream_started(self.spec.name, self.spec.snapshot())
        return writer.start()


def looks_up(spec: StreamSpec, current: Any) -> bool:
    return spec.full_document == "UPDATE_LOOKUP" and current is not None


def with_images(spec: StreamSpec, events: DataFrame, current: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The events with the document images of the stream's modes.

    DEFAULT: what the event carries. WHEN_AVAILABLE and REQUIRED: the event's own post-image, REQUIRED failing where an update has none.
    UPDATE_LOOKUP: for updates the document in ``current``, the collection as it is now (document_key and the document's columns), else the
    event's. With a before-image mode the event's before-image is passed on, REQUIRED failing where it is missing; OFF takes it away.
    """
    kind, out = F.col("operation_type"), events
    held = "full_document" in events.columns
    fields = [c for c in events.columns if c not in META and c not in ("full_document", "full_document_before_change")]
    if spec.full_document != "DEFAULT" and (held or fields):
        image = F.col("full_document") if held else F.when(kind != "DELETE", F.struct(*fields))
        if looks_up(spec, current):
            now = current()
            now = now.select(F.col("document_key").alias("_key"), (F.col("full_document") if held else F.struct(*(F.col(c) for c in fields))).alias("_current"))
            out = out.join(now, F.col("document_key") == F.col("_key"), "left")
            image = F.when(kind == "UPDATE", F.col("_current")).otherwise(image)
        elif spec.full_document == "REQUIRED":
            image = F.when((kind == "UPDATE") & image.isNull(), F.raise_error(F.concat(F.lit("no document at "), "resume_token"))).otherwise(image)
        out = out.withColumn("document", image).drop("_key", "_current")
    if "full_document_before_change" in events.columns:
        before = F.col("full_document_before_change")
        if spec.before_change == "REQUIRED":
            before = F.when(kind.isin("UPDATE", "REPLACE", "DELETE") & before.isNull(), F.raise_error(F.concat(F.lit("no pre-image at "), "resume_token"))).otherwise(before)
        out = (out.withColumn("before", before) if spec.before_change != "OFF" else out).drop("full_document_before_change")
    return out


def plain_letter(letter: FailedEvent) -> dict[str, Any]:
    return {**vars(letter), "error": vars(letter.error)}


OUTCOME = "seq long, resume_token string, document_key string, outcome string, attempts int, error_type string, error_message string, letter string, manual array<string>"


class KeyedActions:
    """What a handler of a parallel run may ask for: letters of its own, which come back as rows; an anchor of its own there is none."""

    def __init__(self, spec: StreamSpec, attempts: Attempts):
        self.spec, self.attempts, self.manual = spec, attempts, []

    def save_now(self, context: Context) -> bool:
        raise ActionUnavailableError(f"{self.spec.name} runs by key; its anchor is the settled prefix")

    def send_manually(self, context: Context, reason: str) -> None:
        if self.spec.checkpoint is None:
            raise ActionUnavailableError(f"{self.spec.name} has no checkpoint policy")
        policy = self.spec.dead_letters or DeadLetterPolicy(retention_days=0)
        self.manual.append(self.attempts.letter(context, ManualDlq(reason), self.attempts.now(), policy, False))


def run_keyed(feed: DataFrame, spec: StreamSpec, partitions: int | None = None, current: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Keys in parallel, each in order: outcome of every event. Handlers run on the executors; letters come back as rows.

    Rows are dealt by key, sorted, and stream through; no group is held. Retries wait in place and so hold back their partition only.
    Without ``partitions`` the events are counted first: there are as many partitions as make KEYED_EVENTS events each on average, and no
    fewer than Spark's setting, so that a task's work doesn't grow with the feed. Only a key's own events can't be divided.
    """
    import pyarrow as pa

    prepared = with_images(spec, spec.compiled()(feed), current)
    if isinstance(spec.filter, Column):
        prepared = prepared.withColumn("_accepted", F.coalesce(spec.filter, F.lit(False)))
    n = partitions or max(int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(feed.count() / KEYED_EVENTS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, saved = NoDeadLetters(), []
        letters.save = saved.append
        attempts = Attempts(spec, letters)
        for batch in batches:
            rows = []
            for values in batch.to_pylist():
                row = Row(**values)
                saved.clear()
                actions = KeyedActions(spec, attempts)
                context = Context(row, spec.name, actions, document_type=spec.document_type)
                handler = spec.handler(row["operation_type"]) if row["operation_type"] != "INVALIDATE" else None
                accepted = spec.filter is None or (values["_accepted"] if isinstance(spec.filter, Column) else spec.filter(context))
                outcome = "LIFECYCLE" if row["operation_type"] == "INVALIDATE" else "NO_HANDLER" if handler is None else attempts.run(handler, context) if accepted else "FILTERED"
                error = saved[0].error if saved else None
                rows.append((row["seq"], row["resume_token"], str(row["document_key"]), outcome, context.attempt, error and error.type, error and error.message, canonical_json(plain_letter(saved[0])) if saved else None, [canonical_json(plain_letter(m)) for m in actions.manual]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            names = [f.split()[0] for f in OUTCOME.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    # By a hash of the key: a join has dealt rows by the key itself already, and Spark would take its partitions, merged by bytes, for these.
    return prepared.repartition(n, F.xxhash64("document_key")).sortWithinPartitions("document_key", "seq").mapInArrow(run, OUTCOME)


def settled_prefix(outcomes: DataFrame) -> DataFrame:
    """(settled_through): the last event before the first that isn't settled; the anchor of a parallel run may go there and no further."""
    first_open = outcomes.agg(F.min(F.when(F.col("outcome").isNull(), F.col("seq"))).alias("open"))
    return outcomes.join(F.broadcast(first_open)).where("open IS NULL OR seq < open").agg(F.max("seq").alias("settled_through"))  # one row


def run_vectorised(feed: DataFrame, spec: StreamSpec, handler: Callable[[DataFrame], DataFrame], checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """A handler for whole micro-batches, as Spark runs any DataFrame: no order within a batch, no per-event retries."""
    pipeline = spec.compiled()

    def batch(df: DataFrame, batch_id: int) -> None:
        out = pipeline(df)
        handler(out.where(spec.filter) if isinstance(spec.filter, Column) else out)

    writer = feed.writeStream.queryName(spec.name).foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Flusher(threading.Thread):
    """Writes owed anchors every ``save_seconds`` and lets the idle heartbeat look in."""

    def __init__(self, anchor: ProcessedAnchor, seconds: float, heartbeat: Any = None):
        super().__init__(daemon=True)
        self.anchor, self.seconds, self.heartbeat, self._stopped = anchor, seconds, heartbeat, threading.Event()
        self.error: BaseException | None = None

    def run(self) -> None:
        """No tick ends the thread but the verdict that the stream is stuck, which is left in ``error``."""
        while not self._stopped.wait(self.seconds):
            try:
                self.anchor.flush()
                if self.heartbeat is not None:
                    self.heartbeat.tick()
            except StreamStuckError as error:
                self.error = error
                return
            except Exception as error:
                self.anchor.metrics.on_probe_failed(self.anchor.stream, error)

    def stop(self) -> None:
        self._stopped.set()
