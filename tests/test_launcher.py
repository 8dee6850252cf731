"""A stream from its definition to the feed's end, and what it resumes from."""

from __future__ import annotations

import os
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators.resume import HistoryLostError
from tidemark.plans.spec import CheckpointPolicy, stream
from tidemark.sources import envelope
from tidemark.stores.memory import Checkpoint, MemoryCheckpoints, MemoryLocks
from tidemark.plans.spec import Sources
from tidemark.sources.feed import FeedSource, _Table, drain, parts, stream_feed
from tidemark.streaming.launcher import Launcher, attributed, elected, launch_from, position_of
from tidemark.streaming.metrics import CountingMetrics


@pytest.fixture
def make(spark, sf_dir, tmp_path):
    def shape(df):
        kind = envelope.mapped(F.col("event_type"), envelope.EVENT_OPERATIONS)
        return df.select(F.col("event_id").alias("seq"), envelope.resume_token(F.col("event_id")).alias("resume_token"), kind.alias("operation_type"), F.lit("events").alias("coll"), F.col("user_id").alias("document_key"), F.col("ts").alias("cluster_time"), "value")

    return lambda **more: Launcher(spark, f"{sf_dir}/events.parquet", f"file://{tmp_path}/queries", lambda: envelope.events_feed(spark, sf_dir), shape, batch_events=400, sleep=lambda s: None, **more)


def test_resumes_after_the_processed_anchor(make):
    seen, store = [], MemoryCheckpoints()
    store.save(Checkpoint("s", last_processed_token="0000000000000000700"))
    spec = stream("s").options(checkpoint=CheckpointPolicy(save_every=50)).on_change(lambda ctx: seen.append(ctx.seq)).build()
    make(checkpoints=store).run(spec)
    assert seen == list(range(701, 1000)) and store.find("s").last_processed_token == "0000000000000000999"


def test_lost_history(make):
    store, metrics, calls, seen = MemoryCheckpoints(), CountingMetrics(), [], []
    store.save(Checkpoint("s", last_processed_token="0000000999999999999"))
    fail = stream("s").options(checkpoint=CheckpointPolicy()).on_change(lambda ctx: None).build()
    with pytest.raises(HistoryLostError):
        make(checkpoints=store).run(fail)
    oldest = stream("s").options(checkpoint=CheckpointPolicy(on_history_lost="RESUME_FROM_OPLOG_START")).on_change(lambda ctx: seen.append(ctx.seq)).reconcile(calls.append).build()
    make(checkpoints=store, metrics=metrics).run(oldest)
    assert seen == list(range(1000)) and len(calls) == 1 and metrics.counts["on_history_lost", "s"] == 1
    assert store.find("s").last_processed_token == "0000000000000000999"


def test_first_start_and_latest_begin_at_the_head(make):
    seen, store = [], MemoryCheckpoints()
    for policy in (CheckpointPolicy(), CheckpointPolicy(start="LATEST")):
        make(checkpoints=store).run(stream("s").options(checkpoint=policy).on_change(lambda ctx: seen.append(ctx.seq)).build())
    assert seen == [] and store.find("s").last_seen_token == "0000000000000000999"


def test_running_stream_restarts_after_a_crash(make):
    seen, store, metrics = [], MemoryCheckpoints(), CountingMetrics()
    store.save(Checkpoint("s", last_processed_token="0000000000000000100"))

    def accepts(context):
        if context.seq == 600 and 600 not in seen and not seen.count(-1):
            seen.append(-1)
            raise ConnectionError
        return True

    spec = stream("s").options(checkpoint=CheckpointPolicy()).on_change(lambda ctx: seen.append(ctx.seq)).filter(accepts).build()
    running = make(checkpoints=store, metrics=metrics).launch(spec, tail=False)
    running.join(120)
    assert not running.is_running() and running.error is None and metrics.counts["on_stream_restarted", "s"] == 1
    assert [s for s in seen if s >= 0] == list(range(101, 1000))  # settled events aren't delivered again
    assert running.last_event_time is not None


def test_heartbeat_reports_and_election(make, spark):
    metrics, store = CountingMetrics(), MemoryCheckpoints()
    launcher = make(checkpoints=store, metrics=metrics)
    spec = stream("s").options(checkpoint=CheckpointPolicy(heartbeat_seconds=1), deployment="SINGLE_LEADER").on_change(lambda ctx: None).build()
    runner = launcher.run(spec)
    beat = launcher.heartbeat(spec, runner)
    beat.seed("0000000000000000999")
    clock = {"t": 100.0}
    beat.clock = lambda: clock["t"] + 1e9
    assert beat.tick() == "EMPTY" and store.find("s").last_heartbeat_time is not None
    launcher.report(spec)
    assert metrics.last["on_oplog_stats"][1] == "OK"
    election = elected(launcher, spec, MemoryLocks(), "pod-a")
    election.step()
    assert election.role == "LEADER"
    election.resign()
    with attributed(spark, "heartbeat", "s"):
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "tidemark-heartbeat:s"
    assert position_of(launcher.feed(), "0000000000000000500").oldest()[0] == "0000000000000000500" and not position_of(launcher.feed(), "0000000000000000500").valid("0000000000000000400")


def waited(true, seconds=60):
    end = time.monotonic() + seconds
    while not true() and time.monotonic() < end:
        time.sleep(0.05)
    return true()


def growing(folder, low, high, step=1):
    """A further file of a feed."""
    rows = [(i * step, datetime(2024, 1, 1) + timedelta(seconds=i % 10**6), i % 7, "signup", float(i)) for i in range(low, high)]
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64()]
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["event_id", "ts", "user_id", "event_type", "value"])
    pq.write_table(table, f"{folder}/.{low}.parquet", row_group_size=50)
    os.rename(f"{folder}/.{low}.parquet", f"{folder}/part-{low:09d}.parquet")


@pytest.fixture
def tailing(spark, tmp_path, make):
    folder = tmp_path / "feed"
    folder.mkdir()
    growing(folder, 0, 100)

    def feed():
        events = spark.read.parquet(str(folder))
        return events.select(F.col("event_id").alias("seq"), envelope.resume_token(F.col("event_id")).alias("resume_token"), F.col("ts").alias("cluster_time"), envelope.mapped(F.col("event_type"), envelope.EVENT_OPERATIONS).alias("operation_type"))

    def launcher(name="a", **more):
        one = make(**more)
        one.path, one.folder, one.feed, one.batch_events = str(folder), f"file://{tmp_path}/queries-{name}", feed, 40
        return one

    return folder, launcher


def test_a_running_stream_tails_its_feed_until_it_is_stopped(tailing):
    folder, launcher = tailing
    seen, store = [], MemoryCheckpoints()
    store.save(Checkpoint("s", last_processed_token=f"{9:019d}"))
    spec = stream("s").options(checkpoint=CheckpointPolicy(save_every=1000, save_seconds=1)).on_change(lambda ctx: seen.append(ctx.seq)).build()
    running = launcher(checkpoints=store).launch(spec)
    assert waited(lambda: len(seen) == 90) and running.is_running()
    assert waited(lambda: store.find("s").last_processed_token == f"{99:019d}", 10)  # by time; no count is reached
    growing(folder, 100, 150)
    assert waited(lambda: len(seen) == 140)
    running.stop()
    assert not running.is_running() and running.error is None and seen == list(range(10, 150))
    growing(folder, 150, 160)
    time.sleep(2)
    assert len(seen) == 140 and store.find("s").last_processed_token == f"{149:019d}"


def test_no_delivery_after_the_lease_is_lost(tailing):
    folder, launcher = tailing
    locks, store, log = MemoryLocks(), MemoryCheckpoints(), []
    store.save(Checkpoint("s", last_processed_token=f"{0:019d}"))

    def spec(name):
        return stream("s").options(checkpoint=CheckpointPolicy(), deployment="SINGLE_LEADER").on_change(lambda ctx: (log.append((name, ctx.seq)), time.sleep(0.02))).build()

    first = launcher("a", checkpoints=store, locks=locks, instance="a").launch(spec("a"))
    assert waited(lambda: len(log) > 5)
    second = launcher("b", checkpoints=store, locks=locks, instance="b").launch(spec("b"))
    assert waited(lambda: second.election.role == "STANDBY") and all(n == "a" for n, _ in log)
    locks.release("s", "a")
    locks.try_acquire("s", "b", 60, time.time())
    first.election.step()  # the renewal fails: the query has ended when this returns
    lost = len(log)
    assert first.election.role == "STANDBY" and first.election.held is None
    second.election.step()
    assert waited(lambda: log[-1] == ("b", 99)) and all(n == "b" for n, _ in log[lost:])
    assert {s for _, s in log} == set(range(1, 100))
    first.stop()
    second.stop()
    assert locks.state("s", time.time()) is None


def test_a_stuck_stream_is_started_again(tailing):
    _, launcher = tailing
    store, metrics, generations = MemoryCheckpoints(), CountingMetrics(), []
    store.save(Checkpoint("s", last_processed_token=f"{0:019d}"))
    one = launcher(checkpoints=store, metrics=metrics)
    shape = one.shape
    one.shape = lambda df: shape(df).where(F.lit(bool(generations)))  # the first generation's cursor delivers nothing
    spec = stream("s").options(checkpoint=CheckpointPolicy(save_seconds=1, heartbeat_seconds=1, stuck_after_probes=2)).on_change(lambda ctx: None).build()
    decide = one.decide
    one.decide = lambda *a: (generations.append(1) if metrics.counts.get(("on_stream_restarted", "s")) else None, decide(*a))[1]
    running = one.launch(spec)
    assert waited(lambda: store.find("s").last_processed_token == f"{99:019d}", 90)
    assert metrics.counts["on_stream_restarted", "s"] >= 1
    running.stop()


def test_named_sources(make):
    seen = []
    default, other = make(), make()
    spec = stream("s").options(source="second", checkpoint=CheckpointPolicy(start="LATEST")).on_change(lambda ctx: seen.append(ctx.seq)).build()
    taken = []
    other.launch = taken.append
    launch_from(Sources(default, {"second": other}))(spec)
    assert taken == [spec]


def test_update_lookup_and_document_types(make, spark, sf_dir):
    seen = []

    class Order:
        def __init__(self, value, event_type=None):
            self.value = value

    one = make(current=lambda spec: envelope.events_feed(spark, sf_dir).groupBy("document_key").agg(F.max("value").alias("value")))
    store = one.checkpoints
    store.save(Checkpoint("s", last_processed_token=f"{600:019d}"))
    spec = stream("s", Order).options(checkpoint=CheckpointPolicy(), full_document="UPDATE_LOOKUP").on_update(lambda document, context: seen.append((context.seq, context.document_key, document))).build()
    one.run(spec)
    top = {r.document_key: r.value for r in one.current(spec).collect()}
    updates = [r.seq for r in one.feed().where("operation_type = 'UPDATE' AND seq > 600").orderBy("seq").collect()]
    assert [s for s, _, _ in seen] == updates and all(isinstance(d, Order) and d.value == top[k] for _, k, d in seen)


def test_sparse_numbers_cost_no_empty_parts(spark, tmp_path):
    folder = tmp_path / "sparse"
    folder.mkdir()
    growing(folder, 0, 200, step=10**13)
    growing(folder, 10**5, 10**5 + 100, step=10**13)
    table = _Table({"path": str(folder)})
    ranges = parts(table.groups(), -1, 2 * 10**18)
    assert len(ranges) == 1 and len(ranges[0].files) == 2
    spark.dataSource.register(FeedSource)
    batches = []
    query = stream_feed(spark, f"file://{tmp_path}/q", path=str(folder), maxEventsPerBatch=50).writeStream.foreachBatch(lambda df, n: batches.append([r.event_id for r in df.collect()])).option("checkpointLocation", f"file://{tmp_path}/q").start()
    drain(query)
    assert [e for b in batches for e in b] == [i * 10**13 for i in [*range(200), *range(10**5, 10**5 + 100)]]
    assert len(batches) == 6 and max(map(len, batches)) <= 60
    known = dict(table.seen)
    growing(folder, 10**6, 10**6 + 10)
    assert table.bounds()[1] >= 10**6 and set(known) < set(table.seen)


def test_tokens_of_large_numbers_differ(spark):
    rows = spark.createDataFrame([(1234567890123,), (1234567890124,), (2**63 - 1,)], "n long").select(envelope.resume_token(F.col("n")).alias("t")).collect()
    assert len({r.t for r in rows}) == 3 and all(len(r.t) == 19 for r in rows)
    with pytest.raises(Exception, match="no token"):
        spark.createDataFrame([(-1,)], "n long").select(envelope.resume_token(F.col("n"))).collect()
