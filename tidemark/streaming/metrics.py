"""What a stream reports."""

from __future__ import annotations

import threading
from collections import Counter
from typing import Any

# Fixed: names of the callbacks.
CALLBACKS = (
    "on_stream_started", "on_stream_stopped", "on_stream_restarted", "on_stream_invalidated", "on_event_received", "on_event_processed", "on_event_error", "on_checkpoint", "on_checkpoint_failed",
    "on_resume_degraded", "on_history_lost", "on_reconciled", "on_reconciliation_failed", "on_probe_failed", "on_event_dead_lettered", "on_dead_letter_failed", "on_oplog_stats", "on_backlog", "on_leadership_change",
)


class NoMetrics:
    """Takes every callback and does nothing. A provider derives from this and defines the ones it wants."""


def _ignored(self: NoMetrics, *args: Any, **kwargs: Any) -> None:
    pass


for _name in CALLBACKS:
    setattr(NoMetrics, _name, _ignored)


class CountingMetrics(NoMetrics):
    """Counts callbacks by name and stream and keeps the last arguments."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.last: dict[str, tuple] = {}
        self._lock = threading.Lock()

    def __getattribute__(self, name: str) -> Any:
        if name not in CALLBACKS:
            return super().__getattribute__(name)

        def count(*args: Any, **kwargs: Any) -> None:
            with self._lock:
                self.counts[name, args[0] if args else None] += 1
                self.last[name] = args

        return count
