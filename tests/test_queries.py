"""Every feed query with SQL gives DuckDB's rows; the others give what they must."""

from __future__ import annotations

import hashlib
from datetime import datetime

import math

import duckdb
import pytest

from tidemark.sources.envelope import EVENT_OPERATIONS
from tidemark.plans.queries import ORACLE, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    made = QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in made.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_replay_delivers_the_failed_batch_again(spark, sf_dir):
    rows = {r.seq: r for r in QUERIES["stream_replay"](spark, "/root/testdata/sf0.01").collect()}
    assert sorted(rows) == list(range(len(rows)))
    twice = sorted(s for s, r in rows.items() if r.deliveries == 2)
    assert twice and twice[-1] == 2699 and twice == list(range(twice[0], 2700))
    assert {r.anchor for r in rows.values()} == {f"{len(rows) - 1:019d}"} or int(next(iter(rows.values())).anchor) >= len(rows) - 100


@pytest.mark.parametrize(("name", "most"), [("stream_replay", 2), ("stream_dlq", 1)])
def test_a_backlog_is_planned_at_once_and_delivered_in_batches(spark, monkeypatch, name, most):
    """10,000 events: four batches of 2500 of Spark's own took as many rounds of planning and logging."""
    from tidemark.streaming.runner import StrictRunner

    batch, rounds = StrictRunner.batch, []
    monkeypatch.setattr(StrictRunner, "batch", lambda self, df, n=0: (rounds.append(n), batch(self, df, n))[1])
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert len(rounds) <= most
    if name == "stream_replay":
        assert sorted(r.seq for r in rows if r.deliveries == 2) == list(range(2500, 2700)) and {r.anchor for r in rows} == {f"{9999:019d}"}


def test_replay_that_fails_a_second_time_gives_no_result(spark, monkeypatch):
    from tidemark.streaming.runner import StrictRunner

    event = StrictRunner.event

    def broken(self, row):
        if row["seq"] == 6000:
            raise OSError("the disk is full")
        return event(self, row)

    monkeypatch.setattr(StrictRunner, "event", broken)
    with pytest.raises(Exception, match="the disk is full"):
        QUERIES["stream_replay"](spark, "/root/testdata/sf0.01")


def test_stream_dead_letters(spark, sf_dir):
    """Against a plain loop over the events."""
    want = []
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        operation = EVENT_OPERATIONS[e.event_type]
        letter = hashlib.sha256(f"letters|{e.event_id:019d}".encode()).hexdigest()
        if operation == "REPLACE" and e.value > 90:
            want.append((letter, str(e.user_id), "TimeoutError", 2, "PENDING"))
        if operation == "DELETE":
            want.append((letter, str(e.user_id), "ManualDlq", 1, "PENDING"))
    rows = QUERIES["stream_dlq"](spark, sf_dir).collect()
    got = [(r.id, "".join(c for c in r.document_key if c.isdigit()), r.error_type, r.attempts, r.status) for r in rows]
    assert sorted(got) == sorted(want) and {w[2] for w in want} == {"TimeoutError", "ManualDlq"}


def test_anchor_fold_matches_a_plain_loop(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect()
    state, want = {}, set()
    for e in events:
        second = int((e.ts - __import__("datetime").datetime(1970, 1, 1)).total_seconds())
        n, at = state.get(e.user_id, (0, second))
        n += 1
        if n >= 5 or second - at >= 3600:
            want.add((e.user_id, e.event_id, "COUNT" if n >= 5 else "TIME", n))
            n, at = 0, second
        state[e.user_id] = (n, at)
    got = {(r.document_key, r.seq, r.reason, r.settled) for r in QUERIES["anchor_count_or_time"](spark, sf_dir).collect()}
    assert got == want


def test_lease_fold_matches_a_plain_loop(spark, sf_dir):
    actions = {"signup": "ACQUIRE", "click": "ACQUIRE", "purchase": "RELEASE"}
    held, want = {}, set()
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        now, pod, key = int((e.ts - datetime(1970, 1, 1)).total_seconds()), f"pod-{e.event_id % 2}", e.user_id
        owner, until = held.get(key, (None, 0))
        action = actions.get(e.event_type, "RENEW")
        if action == "ACQUIRE":
            granted = owner in (None, pod) or until < now
        elif action == "RENEW":
            granted = owner == pod and until > now
        else:
            granted = owner == pod
        if granted and action == "RELEASE":
            held.pop(key)
        elif granted:
            held[key] = (pod, now + 7200)
        owner, until = held.get(key, (None, 0))
        want.add((key, e.event_id, action, pod, granted, owner if owner and until > now else None))
    got = {(r.document_key, r.seq, r.action, r.instance, r.granted, r.owner) for r in QUERIES["lease_fold"](spark, sf_dir).collect()}
    assert got == want


def test_ordered_blocks_agree_with_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.ordered import last_known, previous, running_total

    df = spark.range(200).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select("seq", F.lag("v").over(w).alias("p"), F.last("v", True).over(w).alias("l"), F.count("*").over(w).alias("n"))
    got = previous(df, ["k"], "seq", {"p": F.col("v")}, block=16)
    got = last_known(got, "seq", F.col("v"), "l", ["k"], block=16)
    got = running_total(got, "seq", F.lit(1), "n", ["k"], block=16).select("seq", "p", "l", "n")
    assert sorted(got.collect()) == sorted(want.collect(), key=lambda r: r) or {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
