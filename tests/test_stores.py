"""What every checkpoint, dead-letter and lease store must do."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from tidemark.stores import memory, sqlite

NOW = datetime(2024, 5, 1, 12)
LATER = NOW + timedelta(seconds=5)


@pytest.fixture(params=["memory", "sqlite"])
def kind(request):
    return request.param


@pytest.fixture
def checkpoints(kind, tmp_path):
    return memory.MemoryCheckpoints() if kind == "memory" else sqlite.SqliteCheckpoints(str(tmp_path / "c.db"))


@pytest.fixture
def letters(kind, tmp_path):
    return memory.MemoryDeadLetters() if kind == "memory" else sqlite.SqliteDeadLetters(str(tmp_path / "d.db"))


@pytest.fixture
def locks(kind, tmp_path):
    return memory.MemoryLocks() if kind == "memory" else sqlite.SqliteLocks(str(tmp_path / "l.db"))


def test_checkpoint_round_trip(checkpoints):
    row = memory.Checkpoint("s", "pod-a", '{"_data":"r1"}', '{"_data":"r2"}', NOW, LATER, NOW, {"env": "test"})
    checkpoints.save(row)
    assert checkpoints.find("s") == row
    checkpoints.save(replace(row, instance_id="pod-b"))
    assert checkpoints.find("s").instance_id == "pod-b"
    checkpoints.delete("s")
    assert checkpoints.find("s") is None
    checkpoints.delete("s")


def test_writers_leave_each_other_alone(checkpoints):
    checkpoints.save_seen("s", "a", NOW)
    checkpoints.save_processed("s", "b", LATER)
    row = checkpoints.find("s")
    assert (row.last_seen_token, row.last_seen_time, row.last_processed_token, row.last_processed_time, row.last_heartbeat_time) == ("a", NOW, "b", LATER, None)
    checkpoints.save_seen("s", "c", LATER, LATER)
    row = checkpoints.find("s")
    assert (row.last_seen_token, row.last_processed_token, row.last_heartbeat_time) == ("c", "b", LATER)
    checkpoints.save_processed("s", "d", LATER, NOW)
    assert checkpoints.find("s").last_seen_token == "c" and checkpoints.find("s").last_heartbeat_time == NOW
    checkpoints.save_heartbeat("s", LATER)
    assert checkpoints.find("s").last_heartbeat_time == LATER and checkpoints.find("s").last_processed_token == "d"
    checkpoints.save_heartbeat("new", NOW)
    assert checkpoints.find("new").last_seen_token is None


def test_reset_clears_only_a_dead_token(checkpoints):
    checkpoints.save_seen("s", "seen", NOW)
    checkpoints.save_processed("s", "dead", NOW)
    checkpoints.reset_after_history_lost("s", "dead", "fresh", LATER)
    row = checkpoints.find("s")
    assert (row.last_processed_token, row.last_processed_time, row.last_seen_token, row.last_seen_time, row.last_heartbeat_time) == (None, None, "fresh", LATER, LATER)
    checkpoints.save_processed("s", "alive", NOW)
    checkpoints.reset_after_history_lost("s", "dead", None, None)
    row = checkpoints.find("s")
    assert (row.last_processed_token, row.last_seen_token, row.last_seen_time, row.last_heartbeat_time) == ("alive", None, None, None)
    checkpoints.reset_after_history_lost("unknown", None, "x", NOW)
    assert checkpoints.find("unknown").last_seen_token == "x"


def letter(key: str, **more) -> memory.FailedEvent:
    base = memory.FailedEvent(key, "my-stream", "INSERT", '{"_id":"doc"}', '{"amount":42}', '{"_data":"r"}', memory.ErrorInfo("RuntimeError", "boom"), 3, created_at=NOW, expires_at=NOW + timedelta(days=30), metadata={"env": "test"})
    return replace(base, **more)


def test_letters(letters):
    assert letters.count_pending("my-stream") == 0 and letters.find("a") is None
    letters.save(letter("a"))
    letters.save(letter("b", stream_name="other"))
    letters.save(letter("c", status="RESOLVED", document_key=None, full_document=None, resume_token=None, error=memory.ErrorInfo("E", None, "trace"), expires_at=None))
    assert letters.find("a") == letter("a") and letters.find("c").error.stack_trace == "trace"
    assert letters.count_pending("my-stream") == 1 and letters.count_pending("other") == 1
    assert {e.id for e in letters.find_by_stream("my-stream")} == {"a", "c"}
    letters.save(letter("a", attempts=7))
    assert letters.find("a").attempts == 7 and letters.count_pending("my-stream") == 1
    assert letters.purge(NOW) == 0
    assert letters.purge(NOW + timedelta(days=30)) == 2 and letters.find("c") is not None
    letters.delete("c")
    assert letters.find_by_stream("my-stream") == []


def test_letters_in_files(spark, tmp_path):
    from tidemark.stores.files import FileDeadLetters

    folder = f"file://{tmp_path}/letters"
    test_letters(FileDeadLetters(spark, folder))
    store = FileDeadLetters(spark, folder)
    store.save(letter("a", error=memory.ErrorInfo("E", "two\nlines \u00e9\U0001f600", None)))
    assert FileDeadLetters(spark, folder).find("a") is None  # held back
    store.flush()
    store.close()
    assert FileDeadLetters(spark, folder).find("a") == letter("a", error=memory.ErrorInfo("E", "two\nlines \u00e9\U0001f600", None))
    with open(f"{tmp_path}/letters/letters-torn.json", "w") as torn:
        torn.write('{"number": 1, "deleted": false, "id": "b", "stre')
    assert {e.id for e in FileDeadLetters(spark, folder).find_by_stream("my-stream")} == {"a"}


def test_letters_that_cannot_be_written_stay_waiting(spark, tmp_path, monkeypatch):
    from tidemark.stores.files import FileDeadLetters

    class Broken:
        def write(self, data):
            raise OSError("the disk is full")

    store = FileDeadLetters(spark, f"file://{tmp_path}/letters")
    store.save(letter("a"))
    store._out = Broken()
    with pytest.raises(OSError):
        store.flush()
    assert store.find("a") == letter("a")


def test_letters_by_table(tmp_path):
    store = sqlite.SqliteDeadLetters(str(tmp_path / "d.db"), tables={"other": "other_letters"})
    store.save(letter("a"))
    store.save(letter("b", stream_name="other"))
    store.route("third", "third_letters")
    store.save(letter("c", stream_name="third"))
    assert {store.find(k).stream_name for k in "abc"} == {"my-stream", "other", "third"}
    assert store.count_pending("third") == 1
    with pytest.raises(ValueError):
        store.route("x", "bad name; DROP")


def test_leases(locks):
    assert locks.try_acquire("s", "a", 60, 1000.0)
    assert not locks.try_acquire("s", "b", 60, 1059.0)
    assert locks.try_acquire("s", "a", 60, 1010.0)  # again by its owner
    assert locks.is_leader("s", "a", 1011.0) and not locks.is_leader("s", "b", 1011.0)
    assert locks.renew("s", "a", 60, 1030.0)
    assert locks.state("s", 1031.0).acquired_at == 1010.0 and locks.state("s", 1031.0).expires_at == 1090.0
    assert not locks.renew("s", "b", 60, 1031.0)
    assert not locks.renew("s", "a", 60, 1090.0)  # run out
    assert locks.state("s", 1090.0) is None
    assert locks.try_acquire("s", "b", 60, 1091.0)
    assert not locks.release("s", "a") and locks.is_leader("s", "b", 1092.0)
    assert locks.release("s", "b") and locks.state("s", 1093.0) is None


def test_no_op_stores():
    assert memory.NoLocks().try_acquire("s", "a", 1, 1) and memory.NoDeadLetters().count_pending("s") == 0
    memory.NoCheckpoints().save_processed("s", "t", NOW)
    assert memory.NoCheckpoints().find("s") is None
