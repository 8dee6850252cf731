"""Where a stream resumes: scans, probes, token validation, the resume cascade and the window of lost history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import latest, latest_column, seconds_between

STRATEGIES = ("FAIL", "RESUME_FROM_NOW", "RESUME_FROM_OPLOG_START")


def resume_after(feed: DataFrame, token: str) -> DataFrame:
    """Events strictly after a token."""
    return feed.where(F.col("resume_token") > token)


def start_at(feed: DataFrame, time: datetime) -> DataFrame:
    """Events at an operation time or later."""
    return feed.where(F.col("cluster_time") >= F.lit(time).cast("timestamp_ntz"))


def positions(feed: DataFrame) -> DataFrame:
    """Oldest and newest token and time of the feed: one row."""
    return feed.agg(
        F.min("resume_token").alias("oldest_token"), F.max("resume_token").alias("head_token"), F.min("cluster_time").alias("oldest_time"), F.max("cluster_time").alias("newest_time")
    )


def probe(feed: DataFrame, pipeline: Callable[[DataFrame], DataFrame], token: str | None = None, time: datetime | None = None) -> tuple[str, str | None]:
    """(EVENT_PENDING, None) if the pipeline lets an event through after the position; else (EMPTY, certified position); (FAILED, None) on an error."""
    try:
        head = feed.agg(F.max("resume_token")).first()[0]  # read first: what comes later isn't certified
        ahead = resume_after(feed, token) if token is not None else start_at(feed, time) if time is not None else feed
        if not pipeline(ahead).limit(1).isEmpty():
            return "EVENT_PENDING", None
        return "EMPTY", head
    except Exception:
        return "FAILED", None


def window_stats(feed: DataFrame) -> DataFrame:
    """Hours of history the feed holds and whether it can tell: one row."""
    bounds = positions(feed)
    hours = F.greatest(seconds_between(F.col("oldest_time"), F.col("newest_time")) / F.lit(3600.0), F.lit(0.0))
    return bounds.select("oldest_time", "newest_time", hours.alias("window_hours"), F.when(F.col("oldest_time").isNotNull(), "OK").otherwise("UNAVAILABLE").alias("status"))


def is_valid(token: Column, oldest: Column, head: Column) -> Column:
    """A token from which the feed can go on: its successor hasn't been dropped and it doesn't lie ahead."""
    return F.coalesce((token >= oldest) & (token <= head), F.lit(False))


def cascade(processed: Column, seen: Column, oldest: Column, head: Column, strategy: Column) -> tuple[Column, Column]:
    """(decision, token): processed anchor, else the seen one if it differs, else history is lost; without anchors a bootstrap."""
    by_processed, by_seen = is_valid(processed, oldest, head), is_valid(seen, oldest, head) & ~F.coalesce(seen == processed, F.lit(False))
    lost = F.when(strategy == "FAIL", "FAIL").when(strategy == "RESUME_FROM_NOW", "FROM_NOW").otherwise("FROM_OLDEST")
    decision = F.when(processed.isNull() & seen.isNull(), "BOOTSTRAP").when(by_processed, "PROCESSED").when(by_seen, "SEEN").otherwise(lost)
    token = (
        F.when(decision == "PROCESSED", processed).when(decision == "SEEN", seen).when(decision.isin("BOOTSTRAP", "FROM_NOW"), head).when(decision == "FROM_OLDEST", oldest)
    )
    return decision, token


def lost_window(processed: Column, seen: Column, heartbeat: Column, resumed: Column) -> tuple[Column, Column, Column]:
    """(start, end, seconds) of history that was lost: from the latest sign of life to where the stream goes on."""
    start = latest_column(processed, seen, heartbeat)
    return start, resumed, F.greatest(seconds_between(start, resumed), F.lit(0))


class HistoryLostError(RuntimeError):
    """The stream's history is gone and its strategy is to stop, or recovery failed."""

    def __init__(self, stream: str, last_checkpoint: datetime | None = None):
        super().__init__(f"stream {stream!r} lost its history; last checkpoint: {last_checkpoint}")
        self.stream, self.last_checkpoint = stream, last_checkpoint


class ReconciliationFailedError(HistoryLostError):
    """The reconcile handler failed, or history was lost again while it ran; tokens are kept."""

    def __init__(self, stream: str, attempt: int, last_checkpoint: datetime | None = None):
        super().__init__(stream, last_checkpoint)
        self.attempt = attempt


class StreamStuckError(RuntimeError):
    """Events wait but none is delivered."""

    def __init__(self, stream: str, abstentions: int, seconds: float):
        super().__init__(f"stream {stream!r} is stuck: {abstentions} probes saw waiting events in {seconds:.0f} s")
        self.stream, self.abstentions, self.seconds = stream, abstentions, seconds


# Fixed: server codes of a cursor that can't be resumed.
LOST_CODES = (286, 136, 280)
MAX_CAUSES = 32


def is_history_lost(error: BaseException) -> bool:
    """Whether an error, or one of its first MAX_CAUSES causes, says that history is gone."""
    for _ in range(MAX_CAUSES):
        if error is None:
            return False
        if isinstance(error, HistoryLostError) or getattr(error, "code", None) in LOST_CODES or "NonResumableChangeStreamError" in getattr(error, "labels", ()):
            return True
        error = error.__cause__ or error.__context__
    return False


@dataclass(frozen=True)
class HistoryLost:
    """What a reconcile handler is told."""

    stream: str
    last_processed_time: datetime | None
    last_seen_time: datetime | None
    last_heartbeat_time: datetime | None
    resume_time: datetime | None
    attempt: int = 1
    previous_end: datetime | None = None

    @property
    def start(self) -> datetime | None:
        """Start of the lost window; on a second call only what has been lost since the first."""
        return self.previous_end or latest(self.last_processed_time, self.last_seen_time, self.last_heartbeat_time)

    @property
    def end(self) -> datetime | None:
        return self.resume_time


@dataclass(frozen=True)
class Resume:
    """Where to open the cursor: after ``token``, or at ``time``; ``dead_token``: an anchor to clear once the new position is proven."""

    decision: str
    token: str | None = None
    time: datetime | None = None
    dead_token: str | None = None


@dataclass
class Position:
    """What the cascade asks of a feed."""

    head: Callable[[], str | None]
    oldest: Callable[[], tuple[str, datetime] | None]
    valid: Callable[[str], bool]
    now: Callable[[], datetime]


def resolve(stream: str, store: Any, feed: Position, strategy: str, reconcile: Callable[[HistoryLost], None] | None = None, allow_oldest: bool = True, metrics: Any = None) -> Resume:
    """Decide where a stream starts, and bring its checkpoint in line.

    Processed anchor, then a different seen anchor (counted as a degraded resume unless there was no processed one), then the strategy. A first start
    and RESUME_FROM_NOW persist a fresh certified position before any cursor opens, and fail if they can't. With the
    oldest entry the dead anchors stay until the first certified write proves the new position. The reconcile handler runs before
    anything is written; if the position is lost meanwhile, it runs once more for the rest of the window, and not again.
    """
    saved = store.find(stream)
    processed, seen = (saved.last_processed_token, saved.last_seen_token) if saved else (None, None)
    if processed is None and seen is None:
        return _fresh(stream, store, feed, "BOOTSTRAP", None)
    if processed is not None and feed.valid(processed):
        return Resume("PROCESSED", processed)
    if seen is not None and seen != processed and feed.valid(seen):
        if metrics is not None and processed is not None:
            metrics.on_resume_degraded(stream)
        return Resume("SEEN", seen)
    if metrics is not None:
        metrics.on_history_lost(stream)
    if strategy == "FAIL":
        raise HistoryLostError(stream, latest(saved.last_processed_time, saved.last_seen_time, saved.last_heartbeat_time))
    oldest = feed.oldest() if strategy == "RESUME_FROM_OPLOG_START" and allow_oldest else None
    target = ("FROM_OLDEST", oldest[0], oldest[1]) if oldest else ("FROM_NOW", feed.head(), feed.now())
    if reconcile is not None:
        end = None
        for attempt in (1, 2):
            lost = HistoryLost(stream, saved.last_processed_time, saved.last_seen_time, saved.last_heartbeat_time, target[2], attempt, end)
            try:
                reconcile(lost)
            except Exception as error:
                if metrics is not None:
                    metrics.on_reconciliation_failed(stream, error)
                raise ReconciliationFailedError(stream, attempt, lost.start) from error
            if metrics is not None:
                metrics.on_reconciled(stream, attempt)
            if target[1] is None or feed.valid(target[1]):
                break
            if attempt == 2:
                raise ReconciliationFailedError(stream, attempt, lost.start)
            end = target[2]
            oldest = feed.oldest() if target[0] == "FROM_OLDEST" else None
            target = ("FROM_OLDEST", oldest[0], oldest[1]) if oldest else ("FROM_NOW", feed.head(), feed.now())
    if target[0] == "FROM_OLDEST":
        return Resume("FROM_OLDEST", None, target[2], processed)
    return _fresh(stream, store, feed, "FROM_NOW", processed, target[1])


def _fresh(stream: str, store: Any, feed: Position, decision: str, dead: str | None, token: str | None = None) -> Resume:
    token = token or feed.head()
    store.reset_after_history_lost(stream, dead, token, feed.now())
    return Resume(decision, token)
