"""Supervision: restarts with back-off, single-leader election, and the operators' view of all streams."""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable
from datetime import datetime
from typing import Any

from tidemark.functions.policies import RestartPolicy
from tidemark.operators.resume import HistoryLostError, is_history_lost
from tidemark.plans.spec import Registry, StreamSpec
from tidemark.streaming.metrics import NoMetrics
from tidemark.streaming.runner import StillAtWorkError, StopStream

# Fixed: lease length, renewal and standby poll in seconds.
LEASE_TTL, LEASE_RENEW, LEASE_POLL = 60, 15, 20


class Supervisor:
    """Runs ``start`` (which blocks until the stream ends) again and again.

    A generation that has lived for the policy's longest delay is proven: the attempt counter starts anew. Lost history is
    terminal, as is a stream whose lifecycle event forbids a restart; so is the end of the policy's attempts. A generation whose batch can't
    be ended is terminal too, even for a stopped stream: another one would deliver beside it.
    """

    def __init__(self, stream: str, start: Callable[[int], None], policy: RestartPolicy | None = None, metrics: Any = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.stream, self.start, self.policy = stream, start, policy or RestartPolicy()
        self.metrics, self.sleep, self.clock = metrics or NoMetrics(), sleep, clock
        self.attempt = self.generation = 0
        self.stopped = False
        self.proven = False
        self.from_oldest_failed = False

    def prove(self) -> None:
        """An event has come through: the generation lives."""
        self.proven = True
        self.attempt = 0
        self.from_oldest_failed = False

    def stop(self) -> None:
        self.stopped = True
        self.from_oldest_failed = False

    def run(self) -> str:
        """GRACEFUL or CRASHED."""
        from tidemark.functions.scalars import duration_ms

        cause: BaseException | None = None
        while not self.stopped:
            self.generation += 1
            self.proven = False
            began = self.clock()
            try:
                if self.attempt:
                    self.metrics.on_stream_restarted(self.stream, self.attempt, cause)
                self.start(self.generation)
                self.metrics.on_stream_stopped(self.stream, "GRACEFUL", None)
                return "GRACEFUL"
            except Exception as error:
                cause = error
            if isinstance(cause, StillAtWorkError):
                self.metrics.on_stream_stopped(self.stream, "CRASHED", cause)
                raise cause
            if self.stopped:
                break
            root = _root(cause)
            terminal = isinstance(root, StopStream) and not root.restart
            if terminal or isinstance(root, HistoryLostError) or (is_history_lost(cause) and self.from_oldest_failed):
                self.metrics.on_stream_stopped(self.stream, "CRASHED", cause)
                raise cause
            if is_history_lost(cause):
                self.from_oldest_failed = True  # next time from now on
            if self.proven or self.clock() - began >= duration_ms(self.policy.max_delay) / 1000:
                self.attempt = 0
            self.attempt += 1
            if self.policy.exhausted(self.attempt):
                self.metrics.on_stream_stopped(self.stream, "CRASHED", cause)
                raise cause
            self.sleep(self.policy.delay_ms(self.attempt) / 1000)
        self.metrics.on_stream_stopped(self.stream, "GRACEFUL", None)
        return "GRACEFUL"


def _root(error: BaseException) -> BaseException:
    """The first cause of ours in a chain of causes."""
    at: BaseException | None = error
    while at is not None:
        if isinstance(at, (StopStream, HistoryLostError)):
            return at
        at = at.__cause__ or at.__context__
    return error


class LeaderElection:
    """Holds a stream's lease and starts or stops the stream with it. ``step`` is one turn, for a timer or a test."""

    def __init__(self, stream: str, locks: Any, instance: str, on_lead: Callable[[], None], on_lose: Callable[[], None], metrics: Any = None, now: Callable[[], float] = time.time):
        self.stream, self.locks, self.instance = stream, locks, instance
        self.on_lead, self.on_lose, self.metrics, self.now = on_lead, on_lose, metrics or NoMetrics(), now
        self.role = "NONE"

    def _become(self, role: str) -> None:
        if role != self.role:
            self.role = role
            self.metrics.on_leadership_change(self.stream, role, self.instance)

    def step(self) -> float:
        """Renew or try to acquire; seconds until the next turn. A failing renewal is a lost one."""
        if self.role == "LEADER":
            try:
                kept = self.locks.renew(self.stream, self.instance, LEASE_TTL, self.now())
            except Exception:
                kept = False
            if kept:
                return LEASE_RENEW
            with contextlib.suppress(Exception):
                self.on_lose()
            self._become("STANDBY")
            return LEASE_POLL
        try:
            won = self.locks.try_acquire(self.stream, self.instance, LEASE_TTL, self.now())
        except Exception:
            won = False
        if not won:
            self._become("STANDBY")
            return LEASE_POLL
        self._become("LEADER")
        try:
            self.on_lead()
        except Exception as error:
            with contextlib.suppress(Exception):
                self.on_lose()  # what has begun ends before another instance may begin
            self.locks.release(self.stream, self.instance)
            if is_history_lost(error) or isinstance(_root(error), HistoryLostError):
                self._become("NONE")
                raise
            self._become("STANDBY")
            return LEASE_POLL
        return LEASE_RENEW

    def resign(self) -> None:
        if self.role == "LEADER":
            self.on_lose()
            self.locks.release(self.stream, self.instance)
        self._become("NONE")


class StreamManager:
    """Starts and stops registered streams and answers for their state.

    ``launch`` starts one stream and returns an object with stop(), is_running() and last_event_time.
    """

    def __init__(self, registry: Registry, launch: Callable[[StreamSpec], Any], mode: str = "IMPERATIVE", enabled: bool = True):
        self.registry, self.launch, self.mode, self.enabled = registry, launch, mode, enabled
        self._running: dict[str, Any] = {}
        self._lock = threading.RLock()

    def start_all(self) -> list[str]:
        if not self.enabled:
            return []
        return [s.name for s in self.registry.starting() if self.start(s.name)]

    def start(self, name: str) -> bool:
        spec = self.registry.find(name)
        if spec is None:
            raise KeyError(f"no stream named {name!r}")
        with self._lock:
            if not spec.enabled or self.is_running(name):
                return False
            self._running[name] = self.launch(spec)
            return True

    def stop(self, name: str) -> bool:
        with self._lock:
            handle = self._running.pop(name, None)
        if handle is None:
            return False
        handle.stop()
        return True

    def restart(self, name: str) -> bool:
        self.stop(name)
        return self.start(name)

    def is_running(self, name: str) -> bool:
        handle = self._running.get(name)
        return handle is not None and handle.is_running()

    def last_event_time(self, name: str) -> datetime | None:
        handle = self._running.get(name)
        return getattr(handle, "last_event_time", None)

    def status(self) -> dict[str, Any]:
        streams = {
            s.name: {"status": "UP" if self.is_running(s.name) else "DOWN", "mode": self.mode, "collection": s.collection, "last_event_time": self.last_event_time(s.name)} for s in self.registry.all()
        }
        return {"healthy": self.health()["status"] == "UP", "streams": streams}

    def health(self) -> dict[str, Any]:
        """Streams that are disabled or don't start by themselves don't count; without any the answer is UP."""
        counted = self.registry.starting()
        healthy = sum(self.is_running(s.name) for s in counted)
        return {"status": "UP" if healthy == len(counted) else "DOWN", "total": len(counted), "healthy": healthy}

    def act(self, name: str, action: str) -> dict[str, Any]:
        """start, stop or restart, as an operator asks for it."""
        if action not in ("start", "stop", "restart"):
            return {"error": f"unknown action {action!r}: use start, stop or restart"}
        if self.registry.find(name) is None:
            return {"error": f"no stream named {name!r}"}
        return {"stream": name, "action": action, "done": getattr(self, action)(name)}
