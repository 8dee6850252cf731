"""Stores of checkpoints, dead letters and leases: interfaces, in-memory and no-op forms."""

from __future__ import annotations

import threading
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any, Protocol


@dataclass(frozen=True)
class Checkpoint:
    stream_name: str
    instance_id: str | None = None
    last_seen_token: str | None = None
    last_processed_token: str | None = None
    last_seen_time: datetime | None = None
    last_processed_time: datetime | None = None
    last_heartbeat_time: datetime | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ErrorInfo:
    type: str
    message: str | None
    stack_trace: str | None = None


@dataclass(frozen=True)
class FailedEvent:
    id: str
    stream_name: str
    operation_type: str | None
    document_key: str | None
    full_document: str | None
    resume_token: str | None
    error: ErrorInfo
    attempts: int
    status: str = "PENDING"
    first_attempt_at: datetime | None = None
    last_attempt_at: datetime | None = None
    created_at: datetime | None = None
    expires_at: datetime | None = None
    metadata: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Lease:
    stream_name: str
    instance_id: str
    acquired_at: Any
    expires_at: Any


class CheckpointStore(Protocol):
    """One row per stream. The seen and the processed pair have different writers, which never touch each other's fields."""

    def find(self, stream: str) -> Checkpoint | None: ...
    def save(self, checkpoint: Checkpoint) -> None: ...
    def delete(self, stream: str) -> None: ...
    def save_seen(self, stream: str, token: str | None, at: datetime, heartbeat: datetime | None = None) -> None: ...
    def save_processed(self, stream: str, token: str | None, at: datetime, heartbeat: datetime | None = None) -> None: ...
    def save_heartbeat(self, stream: str, at: datetime) -> None: ...
    def reset_after_history_lost(self, stream: str, dead_processed: str | None, seen: str | None, at: datetime | None) -> None: ...


class DeadLetterStore(Protocol):
    def save(self, event: FailedEvent) -> None: ...
    def find(self, event_id: str) -> FailedEvent | None: ...
    def find_by_stream(self, stream: str) -> list[FailedEvent]: ...
    def delete(self, event_id: str) -> None: ...
    def count_pending(self, stream: str) -> int: ...
    def purge(self, now: datetime) -> int: ...


class LockService(Protocol):
    def try_acquire(self, stream: str, instance: str, ttl: Any, now: Any) -> bool: ...
    def renew(self, stream: str, instance: str, ttl: Any, now: Any) -> bool: ...
    def release(self, stream: str, instance: str) -> bool: ...
    def state(self, stream: str, now: Any) -> Lease | None: ...


class MergingCheckpoints:
    """Field-wise writers on top of find and save, for stores without atomic updates of their own."""

    def save_seen(self, stream: str, token: str | None, at: datetime, heartbeat: datetime | None = None) -> None:
        row = self.find(stream) or Checkpoint(stream)
        self.save(replace(row, last_seen_token=token, last_seen_time=at, last_heartbeat_time=heartbeat or row.last_heartbeat_time))

    def save_processed(self, stream: str, token: str | None, at: datetime, heartbeat: datetime | None = None) -> None:
        row = self.find(stream) or Checkpoint(stream)
        self.save(replace(row, last_processed_token=token, last_processed_time=at, last_heartbeat_time=heartbeat or row.last_heartbeat_time))

    def save_heartbeat(self, stream: str, at: datetime) -> None:
        self.save(replace(self.find(stream) or Checkpoint(stream), last_heartbeat_time=at))

    def reset_after_history_lost(self, stream: str, dead_processed: str | None, seen: str | None, at: datetime | None) -> None:
        """Clear the processed pair if it still holds the dead token; set the seen pair and the heartbeat, or clear them with ``seen`` None."""
        row = self.find(stream) or Checkpoint(stream)
        if dead_processed is not None and row.last_processed_token == dead_processed:
            row = replace(row, last_processed_token=None, last_processed_time=None)
        at = at if seen is not None else None
        self.save(replace(row, last_seen_token=seen, last_seen_time=at, last_heartbeat_time=at))


class MemoryCheckpoints(MergingCheckpoints):
    def __init__(self):
        self._rows: dict[str, Checkpoint] = {}
        self._lock = threading.RLock()

    def find(self, stream: str) -> Checkpoint | None:
        return self._rows.get(stream)

    def save(self, checkpoint: Checkpoint) -> None:
        with self._lock:
            self._rows[checkpoint.stream_name] = checkpoint

    def delete(self, stream: str) -> None:
        self._rows.pop(stream, None)

    def reset_after_history_lost(self, stream: str, dead_processed: str | None, seen: str | None, at: datetime | None) -> None:
        with self._lock:
            super().reset_after_history_lost(stream, dead_processed, seen, at)


class MemoryDeadLetters:
    def __init__(self):
        self._rows: dict[str, FailedEvent] = {}

    def save(self, event: FailedEvent) -> None:
        self._rows[event.id] = event

    def find(self, event_id: str) -> FailedEvent | None:
        return self._rows.get(event_id)

    def find_by_stream(self, stream: str) -> list[FailedEvent]:
        return [e for e in self._rows.values() if e.stream_name == stream]

    def delete(self, event_id: str) -> None:
        self._rows.pop(event_id, None)

    def count_pending(self, stream: str) -> int:
        return sum(e.stream_name == stream and e.status == "PENDING" for e in self._rows.values())

    def purge(self, now: datetime) -> int:
        """Remove what has expired; a letter without expiry stays for ever."""
        gone = [k for k, e in self._rows.items() if e.expires_at is not None and e.expires_at <= now]
        for k in gone:
            del self._rows[k]
        return len(gone)


class MemoryLocks:
    """Times and durations only need to be comparable and addable."""

    def __init__(self):
        self._rows: dict[str, Lease] = {}
        self._lock = threading.Lock()

    def try_acquire(self, stream: str, instance: str, ttl: Any, now: Any) -> bool:
        with self._lock:
            held = self._rows.get(stream)
            if held is not None and held.instance_id != instance and not held.expires_at < now:
                return False
            self._rows[stream] = Lease(stream, instance, now, now + ttl)
            return True

    def renew(self, stream: str, instance: str, ttl: Any, now: Any) -> bool:
        """Only the owner of a lease that hasn't run out; the time of acquisition stays."""
        with self._lock:
            held = self._rows.get(stream)
            if held is None or held.instance_id != instance or not held.expires_at > now:
                return False
            self._rows[stream] = replace(held, expires_at=now + ttl)
            return True

    def release(self, stream: str, instance: str) -> bool:
        with self._lock:
            held = self._rows.get(stream)
            if held is None or held.instance_id != instance:
                return False
            del self._rows[stream]
            return True

    def state(self, stream: str, now: Any) -> Lease | None:
        held = self._rows.get(stream)
        return held if held is not None and held.expires_at > now else None

    def is_leader(self, stream: str, instance: str, now: Any) -> bool:
        held = self.state(stream, now)
        return held is not None and held.instance_id == instance


class NoCheckpoints(MergingCheckpoints):
    def find(self, stream: str) -> None:
        return None

    def save(self, checkpoint: Checkpoint) -> None:
        pass

    def delete(self, stream: str) -> None:
        pass


class NoDeadLetters:
    def save(self, event: FailedEvent) -> None:
        pass

    def find(self, event_id: str) -> None:
        return None

    def find_by_stream(self, stream: str) -> list[FailedEvent]:
        return []

    def delete(self, event_id: str) -> None:
        pass

    def count_pending(self, stream: str) -> int:
        return 0

    def purge(self, now: datetime) -> int:
        return 0


class NoLocks:
    """Every instance leads."""

    def try_acquire(self, stream: str, instance: str, ttl: Any, now: Any) -> bool:
        return True

    def renew(self, stream: str, instance: str, ttl: Any, now: Any) -> bool:
        return True

    def release(self, stream: str, instance: str) -> bool:
        return True

    def state(self, stream: str, now: Any) -> None:
        return None
