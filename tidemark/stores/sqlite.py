"""Stores in one SQLite file: each write is one transaction, so the compare-and-clear and the lease rules hold across processes."""

from __future__ import annotations

import json
import sqlite3
from contextlib import contextmanager
from dataclasses import asdict
from datetime import datetime

from tidemark.stores.memory import Checkpoint, ErrorInfo, FailedEvent, Lease

_STAMPS = ("last_seen_time", "last_processed_time", "last_heartbeat_time")


def _out(at: datetime | None) -> str | None:
    return None if at is None else at.isoformat(timespec="milliseconds")


def _in(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


class _Database:
    def __init__(self, path: str):
        self.path = path
        with self.transaction() as db:
            for statement in self.TABLES:
                db.execute(statement)

    @contextmanager
    def transaction(self):
        db = sqlite3.connect(self.path, timeout=30, isolation_level=None)
        try:
            db.execute("BEGIN IMMEDIATE")
            yield db
            db.execute("COMMIT")
        except BaseException:
            if db.in_transaction:
                db.execute("ROLLBACK")
            raise
        finally:
            db.close()


class SqliteCheckpoints(_Database):
    TABLES = (
        """CREATE TABLE IF NOT EXISTS checkpoints (stream_name TEXT PRIMARY KEY, instance_id TEXT, last_seen_token TEXT, last_processed_token TEXT,
           last_seen_time TEXT, last_processed_time TEXT, last_heartbeat_time TEXT, metadata TEXT NOT NULL DEFAULT '{}')""",
    )

    def find(self, stream: str) -> Checkpoint | None:
        with self.transaction() as db:
            row = db.execute("SELECT * FROM checkpoints WHERE stream_name = ?", (stream,)).fetchone()
        return row and Checkpoint(*row[:4], *map(_in, row[4:7]), json.loads(row[7]))

    def save(self, checkpoint: Checkpoint) -> None:
        c = checkpoint
        row = (c.stream_name, c.instance_id, c.last_seen_token, c.last_processed_token, *(_out(getattr(c, s)) for s in _STAMPS), json.dumps(dict(c.metadata)))
        with self.transaction() as db:
            db.execute("INSERT OR REPLACE INTO checkpoints VALUES (?, ?, ?, ?, ?, ?, ?, ?)", row)

    def delete(self, stream: str) -> None:
        with self.transaction() as db:
            db.execute("DELETE FROM checkpoints WHERE stream_name = ?", (stream,))

    def _set(self, stream: str, **values: str | None) -> None:
        with self.transaction() as db:
            db.execute("INSERT OR IGNORE INTO checkpoints (stream_name) VALUES (?)", (stream,))
            db.execute(f"UPDATE checkpoints SET {', '.join(f'{k} = ?' for k in values)} WHERE stream_name = ?", (*values.values(), stream))

    def save_seen(self, stream: str, token: str | None, at: datetime, heartbeat: datetime | None = None) -> None:
        self._set(stream, last_seen_token=token, last_seen_time=_out(at), **({"last_heartbeat_time": _out(heartbeat)} if heartbeat else {}))

    def save_processed(self, stream: str, token: str | None, at: datetime, heartbeat: datetime | None = None) -> None:
        self._set(stream, last_processed_token=token, last_processed_time=_out(at), **({"last_heartbeat_time": _out(heartbeat)} if heartbeat else {}))

    def save_heartbeat(self, stream: str, at: datetime) -> None:
        self._set(stream, last_heartbeat_time=_out(at))

    def reset_after_history_lost(self, stream: str, dead_processed: str | None, seen: str | None, at: datetime | None) -> None:
        stamp = _out(at) if seen is not None else None
        with self.transaction() as db:
            db.execute("INSERT OR IGNORE INTO checkpoints (stream_name) VALUES (?)", (stream,))
            db.execute("UPDATE checkpoints SET last_processed_token = NULL, last_processed_time = NULL WHERE stream_name = ? AND last_processed_token = ?", (stream, dead_processed))
            db.execute("UPDATE checkpoints SET last_seen_token = ?, last_seen_time = ?, last_heartbeat_time = ? WHERE stream_name = ?", (seen, stamp, stamp, stream))


class SqliteDeadLetters(_Database):
    """``tables`` routes a stream's letters to a table of its own; lookups by id go through all tables."""

    TABLES = ()

    def __init__(self, path: str, table: str = "dead_letters", tables: dict[str, str] | None = None):
        self.table, self.tables = table, dict(tables or {})
        super().__init__(path)
        for name in {table, *self.tables.values()}:
            self._create(name)

    def _create(self, name: str) -> None:
        if not name.isidentifier():
            raise ValueError(f"not a table name: {name!r}")
        with self.transaction() as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {name} (id TEXT PRIMARY KEY, stream_name TEXT, status TEXT, expires_at TEXT, body TEXT)")
            db.execute(f"CREATE INDEX IF NOT EXISTS {name}_backlog ON {name} (stream_name, status)")

    def route(self, stream: str, table: str) -> None:
        self._create(table)
        self.tables[stream] = table

    def _all(self) -> list[str]:
        return sorted({self.table, *self.tables.values()})

    def save(self, event: FailedEvent) -> None:
        body = asdict(event) | {k: _out(getattr(event, k)) for k in ("first_attempt_at", "last_attempt_at", "created_at", "expires_at")}
        with self.transaction() as db:
            db.execute(f"INSERT OR REPLACE INTO {self.tables.get(event.stream_name, self.table)} VALUES (?, ?, ?, ?, ?)", (event.id, event.stream_name, event.status, _out(event.expires_at), json.dumps(body)))

    @staticmethod
    def _event(body: str) -> FailedEvent:
        row = json.loads(body)
        stamps = {k: _in(row[k]) for k in ("first_attempt_at", "last_attempt_at", "created_at", "expires_at")}
        return FailedEvent(**{**row, **stamps, "error": ErrorInfo(**row["error"])})

    def find(self, event_id: str) -> FailedEvent | None:
        with self.transaction() as db:
            for name in self._all():
                if row := db.execute(f"SELECT body FROM {name} WHERE id = ?", (event_id,)).fetchone():
                    return self._event(row[0])
        return None

    def find_by_stream(self, stream: str) -> list[FailedEvent]:
        with self.transaction() as db:
            return [self._event(r[0]) for r in db.execute(f"SELECT body FROM {self.tables.get(stream, self.table)} WHERE stream_name = ?", (stream,))]

    def delete(self, event_id: str) -> None:
        with self.transaction() as db:
            for name in self._all():
                db.execute(f"DELETE FROM {name} WHERE id = ?", (event_id,))

    def count_pending(self, stream: str) -> int:
        with self.transaction() as db:
            return db.execute(f"SELECT count(*) FROM {self.tables.get(stream, self.table)} WHERE stream_name = ? AND status = 'PENDING'", (stream,)).fetchone()[0]

    def purge(self, now: datetime) -> int:
        with self.transaction() as db:
            return sum(db.execute(f"DELETE FROM {name} WHERE expires_at IS NOT NULL AND expires_at <= ?", (_out(now),)).rowcount for name in self._all())


class SqliteLocks(_Database):
    """Times are epoch seconds. An error of the store counts as not granted."""

    TABLES = ("CREATE TABLE IF NOT EXISTS leases (stream_name TEXT PRIMARY KEY, instance_id TEXT, acquired_at REAL, expires_at REAL)",)

    def _changed(self, statement: str, values: tuple) -> bool:
        try:
            with self.transaction() as db:
                return db.execute(statement, values).rowcount > 0
        except sqlite3.Error:
            return False

    def try_acquire(self, stream: str, instance: str, ttl: float, now: float) -> bool:
        return self._changed(
            """INSERT INTO leases VALUES (?1, ?2, ?3, ?3 + ?4) ON CONFLICT (stream_name) DO UPDATE SET instance_id = ?2, acquired_at = ?3, expires_at = ?3 + ?4 WHERE instance_id = ?2 OR expires_at < ?3""",
            (stream, instance, now, ttl),
        )

    def renew(self, stream: str, instance: str, ttl: float, now: float) -> bool:
        return self._changed("UPDATE leases SET expires_at = ?3 + ?4 WHERE stream_name = ?1 AND instance_id = ?2 AND expires_at > ?3", (stream, instance, now, ttl))

    def release(self, stream: str, instance: str) -> bool:
        return self._changed("DELETE FROM leases WHERE stream_name = ? AND instance_id = ?", (stream, instance))

    def state(self, stream: str, now: float) -> Lease | None:
        with self.transaction() as db:
            row = db.execute("SELECT * FROM leases WHERE stream_name = ? AND expires_at > ?", (stream, now)).fetchone()
        return row and Lease(*row)

    def is_leader(self, stream: str, instance: str, now: float) -> bool:
        held = self.state(stream, now)
        return held is not None and held.instance_id == instance
