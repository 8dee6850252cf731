"""Policies, definitions, resume decisions, the attempt loop, anchors, liveness, supervision and election."""

from __future__ import annotations

import json
import warnings
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.policies import RestartPolicy, RetryPolicy
from tidemark.operators import resume
from tidemark.plans import spec as sp
from tidemark.plans.stages import PipelineError, compile_pipeline, resolve
from tidemark.sources.feed import FeedSource, drain, stream_feed
from tidemark.stores.memory import Checkpoint, MemoryCheckpoints, MemoryDeadLetters, MemoryLocks
from tidemark.streaming import manager as mg
from tidemark.streaming.anchors import IdleHeartbeat, LivenessGate, ProcessedAnchor
from tidemark.streaming.metrics import CountingMetrics
from tidemark.streaming.runner import Attempts, Context, DisorderError, StopStream, StrictRunner, run_keyed, run_vectorised

NOW = datetime(2024, 5, 1)


# Policies


def test_retry_delays():
    policy = RetryPolicy(9, "1s", "60s", 3.0, jitter=False)
    assert [policy.delay_ms(n) for n in range(1, 6)] == [1000, 3000, 9000, 27000, 60000]
    assert RetryPolicy(3, "0ms", "5s").delay_ms(1) == 0
    assert RetryPolicy(3, "1ms", "5s", 0.1, False).delay_ms(3) == 1
    for n, (low, high) in enumerate(((400, 600), (800, 1200), (1600, 2400)), 1):
        assert all(low <= RetryPolicy().delay_ms(n) <= high for _ in range(50))
    assert RetryPolicy(3, "1s", "60s", 10.0, False).delay_ms(400) == 60000


def test_retry_eligibility():
    policy = RetryPolicy(3, retry_on=("LookupError",), no_retry_on=("KeyError",))
    assert not policy.should_retry(KeyError(), 1) and policy.should_retry(IndexError(), 2)
    assert not policy.should_retry(IndexError(), 3) and not policy.should_retry(TimeoutError(), 1)
    assert not RetryPolicy().should_retry(UnicodeError(), 1) and RetryPolicy().should_retry(TimeoutError(), 1)


def test_restart_policy():
    policy = RestartPolicy()
    assert [policy.delay_ms(n) for n in (1, 2, 3, 7, 5000)] == [1000, 2000, 4000, 60000, 60000]
    assert not policy.exhausted(99) and RestartPolicy(2).exhausted(3) and not RestartPolicy(2).exhausted(2)


@pytest.mark.parametrize("bad", [RetryPolicy(0), RetryPolicy(multiplier=0), RetryPolicy(initial_delay="5h"), RestartPolicy(-1), RestartPolicy(multiplier=0.5), RestartPolicy(initial_delay="0s")])
def test_bad_policies(bad):
    with pytest.raises(ValueError):
        bad.validate()


def test_scalars(spark):
    assert [scalars.duration_ms(t) for t in ("500ms", " 1s ", "2m")] == [500, 1000, 120000]
    assert scalars.kebab_case("HTTPFeed") == "h-t-t-p-feed" and scalars.decapitalise("Order") == "order" and scalars.capitalise("INSERT") == "Insert"
    assert scalars.document_key_json("x") == '{"_id":"x"}' and scalars.document_key_json({"b": 1, "a": 2}) == '{"a":2,"b":1}'
    assert scalars.expiry(NOW, 0) is None and scalars.latest(None, NOW) == NOW and scalars.latest(None) is None
    with pytest.raises(Exception, match="not a duration"):
        spark.createDataFrame([("5h",)], "t string").select(scalars.duration_ms_column(F.col("t"))).collect()


# Definitions


def handler(context):
    pass


def test_builder_rules():
    built = sp.stream("orders").on_insert(handler).on_change(handler).build()
    assert built.handler("INSERT") is handler and built.handler("DROP") is handler and built.handler_names() == ["on_insert", "ON_CHANGE"]
    with pytest.raises(sp.AlreadySetError):
        sp.stream("s").on_insert(handler).on_insert(handler)
    with pytest.raises(sp.AlreadySetError):
        sp.stream("s").filter(handler).filter(handler)
    with pytest.raises(sp.DefinitionError):
        sp.stream(" ")
    with pytest.raises(sp.DefinitionError, match="at least one handler"):
        sp.stream("s").build()
    with pytest.raises(sp.DefinitionError, match="filter"):
        sp.stream("s").on_delete(handler).filter(lambda c: True).build()


@pytest.mark.parametrize("make", [
    lambda b: b.reconcile(handler), lambda b: b.options(checkpoint=sp.CheckpointPolicy()).reconcile(handler), lambda b: b.options(checkpoint=sp.CheckpointPolicy(start="LATEST", on_history_lost="RESUME_FROM_NOW")).reconcile(handler),
    lambda b: b.options(checkpoint=sp.CheckpointPolicy(save_every=0)), lambda b: b.options(checkpoint=sp.CheckpointPolicy(save_seconds=-1)), lambda b: b.options(dead_letters=sp.DeadLetterPolicy(retention_days=-1)),
    lambda b: b.on_error(handler, ValueError).on_error(handler, KeyError, ValueError), lambda b: b.on_error(handler).on_error(handler), lambda b: b.options(full_document="SOMETIMES"), lambda b: b.on_change(lambda a, b, c: None),
])
def test_bad_definitions(make):
    with pytest.raises(sp.DefinitionError):
        make(sp.stream("s").on_insert(handler)).build()


def test_warnings():
    with pytest.warns(UserWarning, match="no document"):
        sp.stream("s").on_update(lambda document: None).build()
    with pytest.warns(UserWarning, match="idle heartbeat"):
        sp.stream("s").on_insert(handler).options(checkpoint=sp.CheckpointPolicy(heartbeat_seconds=0)).build()
    with pytest.warns(UserWarning, match="drops DROP"):
        compile_pipeline([{"$match": {"operationType": "insert"}}])


def test_decorated_class_and_registry():
    @sp.change_stream(collection="orders", checkpoint=sp.CheckpointPolicy())
    class HTTPFeed:
        @sp.on_insert
        def added(self, document, context):
            pass

        @sp.event_filter
        def wanted(self, context):
            return True

        @sp.on_error(ValueError)
        def failed(self, error, context):
            return "SKIP"

    built = HTTPFeed.define(HTTPFeed())
    assert built.name == "h-t-t-p-feed" and built.collection == "orders" and set(built.handlers) == {"INSERT"} and built.errors[0].types == (ValueError,)
    registry = sp.Registry()
    registry.contribute(lambda r: r.add(built))
    assert registry.find("h-t-t-p-feed") is built and registry.starting() == [built]
    with pytest.raises(sp.DefinitionError):
        registry.add(built)
    with pytest.raises(sp.DefinitionError, match="known: eu"):
        sp.Sources(1, {"eu": 2}).get("us")


def test_error_specificity():
    bindings = [sp.ErrorBinding((), lambda e, c: "DLQ"), sp.ErrorBinding((LookupError,), lambda e, c: "RETRY"), sp.ErrorBinding((KeyError,), lambda e, c: "SKIP")]
    assert [sp.resolve_error(bindings, e, None) for e in (KeyError(), IndexError(), TimeoutError())] == ["SKIP", "RETRY", "DLQ"]
    assert sp.resolve_error(bindings[1:], TimeoutError(), None) == "RETHROW"
    assert sp.resolve_error([sp.ErrorBinding((), lambda e, c: 1 / 0)], KeyError(), None) == "RETHROW"


# Pipelines


def test_pipeline_errors(spark):
    df = spark.createDataFrame([(1, "a", "x")], "seq long, resume_token string, v string")
    for bad in ([{"$group": {}}], [{"$match": {}, "$set": {}}]):
        with pytest.raises(PipelineError):
            compile_pipeline(bad)
    with pytest.raises(PipelineError, match="token"):
        compile_pipeline([{"$project": {"_id": 0, "v": 1}}])(df)
    with pytest.raises(PipelineError, match="token"):
        compile_pipeline([{"$unset": "_id"}])(df)
    with pytest.raises(PipelineError, match="token"):
        compile_pipeline(lambda d: d.select("v"))(df)
    with pytest.raises(PipelineError):
        resolve(lambda: None, supplier=True)
    with pytest.raises(PipelineError):
        resolve(lambda: 1 / 0, supplier=True)
    assert compile_pipeline([F.col("v") == "x"])(df).count() == 1 and compile_pipeline(None)(df) is df
    assert resolve(lambda: [{"$match": {"v": {"$regex": "^x"}}}], supplier=True)(df).count() == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from tidemark.plans.queries import QUERIES

    plan = QUERIES["match_eq"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1]


# Images


def test_accessors_keep_null_and_absent_apart(spark):
    from tidemark.operators.images import has_field_changed, removed_fields, truncated_arrays, updated_value

    kind = "struct<updated_fields:map<string,variant>,removed_fields:array<string>,truncated_arrays:array<struct<field:string,new_size:int>>>"
    df = spark.sql(f"""SELECT CAST(named_struct('updated_fields', map('status', parse_json('"PAID"'), 'gone', parse_json('null')), 'removed_fields', array('old'), 'truncated_arrays', NULL) AS {kind}) AS d
        UNION ALL SELECT CAST(named_struct('updated_fields', NULL, 'removed_fields', NULL, 'truncated_arrays', NULL) AS {kind})""")
    d = F.col("d")
    first, second = df.select(
        *(has_field_changed(d, p) for p in ("status", "gone", "old", "stat")), updated_value(d, "status", "string"), updated_value(d, "gone", "string"), updated_value(d, "status", "int", strict=False), removed_fields(d), truncated_arrays(d)
    ).collect()
    assert tuple(first) == (True, True, True, False, "PAID", None, None, ["old"], [])
    assert tuple(second) == (False, False, False, False, None, None, None, [], [])
    with pytest.raises(Exception, match="CAST"):
        df.select(updated_value(d, "status", "int")).collect()


def test_required_modes_fail(spark):
    from tidemark.operators.images import full_documents, pre_images
    from tidemark.sources.envelope import operation_type

    df = spark.createDataFrame([(1, "t1", "UPDATE", 7, "a", 1.0, "{}")], "seq long, resume_token string, operation_type string, document_key long, event_type string, value double, props string")
    with pytest.raises(Exception, match="no pre-image"):
        pre_images(df, "REQUIRED").collect()
    assert pre_images(df).first().before is None and full_documents(df, "DEFAULT").first().document is None and full_documents(df, "REQUIRED").first().document.value == 1.0
    names = spark.createDataFrame([("dropDatabase",), (None,)], "w string").select(operation_type(F.col("w")).alias("o")).collect()
    assert [r.o for r in names] == ["DROP_DATABASE", None]
    with pytest.raises(Exception, match="unknown operation"):
        spark.createDataFrame([("drop table",)], "w string").select(operation_type(F.col("w"))).collect()


# Resume


def position(valid=(), head="009", oldest=("001", NOW)):
    return resume.Position(lambda: head, lambda: oldest, lambda t: t in valid, lambda: NOW)


def saved(**values):
    store = MemoryCheckpoints()
    store.save(Checkpoint("s", **values))
    return store


def test_cascade_levels():
    metrics = CountingMetrics()
    assert resume.resolve("s", saved(last_processed_token="5", last_seen_token="6"), position({"5", "6"}), "FAIL").token == "5"
    assert resume.resolve("s", saved(last_processed_token="5", last_seen_token="6"), position({"6"}), "FAIL", metrics=metrics).decision == "SEEN"
    assert metrics.counts["on_resume_degraded", "s"] == 1
    assert resume.resolve("s", saved(last_seen_token="6"), position({"6"}), "FAIL", metrics=metrics).decision == "SEEN"
    assert metrics.counts["on_resume_degraded", "s"] == 1
    store = MemoryCheckpoints()
    assert resume.resolve("s", store, position(), "FAIL").decision == "BOOTSTRAP" and store.find("s").last_seen_token == "009"


def test_lost_history_strategies():
    store = saved(last_processed_token="5", last_processed_time=NOW)
    with pytest.raises(resume.HistoryLostError):
        resume.resolve("s", store, position(), "FAIL")
    assert store.find("s").last_processed_token == "5"
    found = resume.resolve("s", store, position(), "RESUME_FROM_OPLOG_START")
    assert found.decision == "FROM_OLDEST" and found.dead_token == "5" and store.find("s").last_processed_token == "5"
    assert resume.resolve("s", store, position(oldest=None), "RESUME_FROM_OPLOG_START").decision == "FROM_NOW"
    assert store.find("s").last_processed_token is None and store.find("s").last_seen_token == "009"


def test_reconcile_runs_before_writes_and_at_most_twice():
    store, calls = saved(last_processed_token="5", last_processed_time=NOW), []
    resume.resolve("s", store, position({"009"}), "RESUME_FROM_NOW", lambda lost: calls.append((lost.attempt, lost.start, store.find("s").last_processed_token)))
    assert calls == [(1, NOW, "5")] and store.find("s").last_processed_token is None
    store, calls = saved(last_processed_token="5", last_processed_time=NOW), []
    with pytest.raises(resume.ReconciliationFailedError):
        resume.resolve("s", store, position(), "RESUME_FROM_NOW", lambda lost: calls.append(lost.attempt))
    assert calls == [1, 2] and store.find("s").last_processed_token == "5"
    with pytest.raises(resume.ReconciliationFailedError):
        resume.resolve("s", store, position({"009"}), "RESUME_FROM_NOW", lambda lost: 1 / 0)
    assert store.find("s").last_processed_token == "5"


def test_history_lost_classification():
    error = RuntimeError("x")
    error.code = 286
    outer = ValueError("y")
    outer.__cause__ = error
    assert resume.is_history_lost(outer) and not resume.is_history_lost(ValueError())


# Attempts


def context(**values) -> Context:
    row = {"seq": 1, "resume_token": "000000000001", "operation_type": "INSERT", "document_key": 7, "cluster_time": NOW, "value": 1} | values
    return Context(Row(**row), "s")


def attempts(fails: int, error: Exception, **settings):
    calls = []

    def failing(ctx):
        calls.append(ctx.attempt)
        if len(calls) <= fails:
            raise error

    letters = MemoryDeadLetters()
    handlers = settings.pop("errors", ())
    spec = sp.StreamSpec("s", "c", {"INSERT": failing}, errors=tuple(handlers), dead_letters=sp.DeadLetterPolicy(), **settings)
    outcome = Attempts(spec, letters, sleep=lambda s: None, now=lambda: NOW).run(failing, context())
    return outcome, len(calls), [e.attempts for e in letters.find_by_stream("s")]


RETRY3 = RetryPolicy(3, "1ms", "1ms", 1.0, False)


@pytest.mark.parametrize(("fails", "error", "action", "retry", "want"), [
    (2, TimeoutError(), None, RETRY3, ("HANDLED", 3, [])), (9, TimeoutError(), None, RETRY3, ("DEAD_LETTER", 3, [3])), (9, ValueError(), None, RETRY3, ("DEAD_LETTER", 1, [1])), (9, TimeoutError(), None, None, ("DEAD_LETTER", 1, [1])),
    (9, TimeoutError(), "SKIP", RETRY3, ("SKIPPED", 1, [])), (9, TimeoutError(), "DLQ", RETRY3, ("DEAD_LETTER", 1, [1])), (2, ValueError(), "RETRY", RETRY3, ("HANDLED", 3, [])), (9, ValueError(), "RETRY", None, ("DEAD_LETTER", 1, [1])),
])
def test_error_decision_table(fails, error, action, retry, want):
    errors = [sp.ErrorBinding((), lambda e, c: action)] if action else []
    assert attempts(fails, error, errors=errors, retry=retry) == want


def test_letter_follows_the_policy():
    spec = sp.StreamSpec("s", "c", {"INSERT": handler}, dead_letters=sp.DeadLetterPolicy(retention_days=0, include_document=False, include_stack=False))
    letters = MemoryDeadLetters()
    Attempts(spec, letters, now=lambda: NOW).dead_letter(context(), KeyError("k"), NOW)
    one = letters.find_by_stream("s")[0]
    assert one.expires_at is None and one.full_document is None and one.error.stack_trace is None and one.document_key == '{"_id":7}'
    assert one.id == context().event_id


# The strict runner in batch form


def feed(spark, rows):
    full = [(i, f"{i:012d}", op, i % 3, NOW, v) for i, (op, v) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, resume_token string, operation_type string, document_key long, cluster_time timestamp_ntz, value int")


def test_runner_settles_rejections_and_orders_events(spark):
    seen = []
    spec = sp.stream("s").options(checkpoint=sp.CheckpointPolicy(save_every=2)).on_insert(lambda ctx: seen.append(ctx.seq)).filter(F.col("value") > 1).build()
    store, metrics = MemoryCheckpoints(), CountingMetrics()
    runner = StrictRunner(spec, store, metrics=metrics)
    runner.batch(feed(spark, [("INSERT", 1), ("INSERT", 2), ("UPDATE", 9), ("INSERT", 3), ("DROP", 0)]))
    assert seen == [1, 3] and runner.outcomes == {"FILTERED": 1, "HANDLED": 2, "NO_HANDLER": 2}
    assert store.find("s").last_processed_token == "000000000003" and store.find("s").last_seen_token is None


def test_invalidate_ends_the_stream(spark):
    for rows, strategy, cause, restart in (([("RENAME", 0), ("INVALIDATE", 0)], "RESUME_FROM_NOW", "RENAME", False), ([("INVALIDATE", 0)], "RESUME_FROM_NOW", "DROP", True), ([("DROP", 0), ("INVALIDATE", 0)], "FAIL", "DROP", False)):
        spec = sp.stream("s").options(checkpoint=sp.CheckpointPolicy(on_history_lost=strategy)).on_change(handler).build()
        with pytest.raises(StopStream) as stop:
            StrictRunner(spec).batch(feed(spark, rows))
        assert (stop.value.cause, stop.value.restart) == (cause, restart)


def test_unsettled_event_stops_the_batch(spark):
    def interrupted(seconds):
        raise KeyboardInterrupt

    spec = sp.stream("s").options(retry=RETRY3, checkpoint=sp.CheckpointPolicy()).on_insert(lambda ctx: 1 / 0).build()
    store = MemoryCheckpoints()
    with pytest.raises(KeyboardInterrupt):
        StrictRunner(spec, store, sleep=interrupted).batch(feed(spark, [("INSERT", 1), ("INSERT", 2)]))
    assert store.find("s") is None


def test_feed_source_reads_in_order_and_knows_lost_history(spark, sf_dir):
    from tidemark.sources.feed import FeedSource

    spark.dataSource.register(FeedSource)
    load = lambda **o: spark.read.format("feed").options(path=f"{sf_dir}/events.parquet", **o).load()
    everything = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert load().count() == everything.count() and load(startAfter=500).count() == everything.where("event_id > 500").count() and load(startSeq=500).count() == everything.where("event_id >= 500").count()
    with pytest.raises(Exception, match="oldest kept"):
        load(startAfter=10, oldest=500).count()


def test_settled_prefix(spark):
    from tidemark.streaming.runner import settled_prefix

    rows = spark.createDataFrame([(1, "HANDLED"), (2, "FILTERED"), (3, None), (4, "HANDLED")], "seq long, outcome string")
    assert settled_prefix(rows).first()[0] == 2 and settled_prefix(rows.where("seq <> 3")).first()[0] == 4


# Anchors and liveness


class Flaky(MemoryCheckpoints):
    broken = False

    def save_processed(self, *args, **kwargs):
        if self.broken:
            raise OSError("store away")
        super().save_processed(*args, **kwargs)


def test_anchor_counts_from_the_last_confirmed_write():
    store, metrics = Flaky(), CountingMetrics()
    anchor = ProcessedAnchor("s", store, sp.CheckpointPolicy(save_every=3), metrics)
    for t in "ab":
        anchor.settle(t, NOW)
    assert store.find("s") is None and anchor.flush() and store.find("s").last_processed_token == "b" and not anchor.flush()
    for t in "cd":
        anchor.settle(t, NOW)
    assert store.find("s").last_processed_token == "b"
    store.broken = True
    anchor.settle("e", NOW)
    assert metrics.counts["on_checkpoint_failed", "s"] == 1 and store.find("s").last_processed_token == "b"
    store.broken = False
    anchor.settle("f", NOW)
    assert store.find("s").last_processed_token == "f"
    assert anchor.save_now("g", NOW) and not anchor.flush()


def test_letters_are_written_before_an_anchor_or_a_turn_passes_them(spark, tmp_path):
    from tidemark.stores.memory import MemoryDeadLetters
    from tidemark.streaming.anchors import Turns

    log, store = [], MemoryCheckpoints()

    class Held(MemoryDeadLetters):
        def flush(self):
            log.append((len(self._rows), store.find("s") and store.find("s").last_processed_token, turns.last))

    turns = Turns(spark, f"file://{tmp_path}/q", 4)
    runner = StrictRunner(sp.stream("s").options(checkpoint=sp.CheckpointPolicy(save_every=3), dead_letters=sp.DeadLetterPolicy()).on_insert(lambda ctx: 1 / 0).build(), store, Held())
    runner.turns = turns
    runner.batch(feed(spark, [("INSERT", 1)] * 9))
    assert [n for n, _, _ in log] == [3, 4, 6, 8, 9, 9] and [t for _, _, t in log] == [None, None, 3, 3, 7, 7] and log[-1][1] == f"{8:012d}"
    again = StrictRunner(runner.spec, MemoryCheckpoints(), Held())
    again.turns = Turns(spark, f"file://{tmp_path}/q", 4)
    again.batch(feed(spark, [("INSERT", 1)] * 9))
    assert again.outcomes == {"DEAD_LETTER": 1}  # the ninth; two turns had ended


def test_stack_texts_are_those_of_traceback():
    import traceback

    loop = Attempts(sp.stream("s").on_insert(lambda ctx: None).build())

    def fail(how):
        try:
            if how == "chained":
                raise ValueError("inner")
        except ValueError as inner:
            raise TypeError("outer") from inner
        if how == "noted":
            error = KeyError("x")
            error.add_note("a note")
            raise error
        raise OSError(f"no {how}")

    for how in ("first", "second", "chained", "noted"):
        try:
            fail(how)
        except Exception as error:
            assert loop.stack(error) == "".join(traceback.format_exception(error))


def test_gate():
    gate = LivenessGate()
    assert gate.enter() and not gate.claim_stuck() and not gate.begin_repair()
    gate.leave()
    assert gate.claim_stuck() and not gate.enter()
    gate = LivenessGate()
    assert gate.begin_repair() and not gate.claim_stuck()
    gate.end_repair()
    assert gate.enter()


def heartbeat(answers, gate=None, store=None):
    clock = {"t": 0.0}
    beat = IdleHeartbeat("s", store or MemoryCheckpoints(), sp.CheckpointPolicy(heartbeat_seconds=10, stuck_after_probes=3), lambda at: next(answers), gate or LivenessGate(), clock=lambda: clock["t"], now=lambda: NOW)
    beat.seed("1")
    return beat, clock


def test_idle_probe_certifies_a_position():
    store = MemoryCheckpoints()
    beat, clock = heartbeat(iter([("EMPTY", "4"), ("EMPTY", "4")]), store=store)
    assert beat.tick() is None
    clock["t"] = 11
    assert beat.tick() == "EMPTY" and beat.position == "4" and store.find("s").last_seen_token == "4" and store.find("s").last_processed_token is None
    assert beat.tick() is None


def test_a_stream_that_starts_or_fetches_is_not_probed():
    beat, clock = heartbeat(iter([("EVENT_PENDING", None)] * 3))
    work = {"on": True}
    beat.working = lambda: work["on"]
    for clock["t"] in range(11, 111, 11):
        assert beat.tick() is None
    work["on"] = False
    assert beat.tick() is None  # the silence begins only now
    for clock["t"] in (122, 133):
        assert beat.tick() == "EVENT_PENDING"
    with pytest.raises(resume.StreamStuckError):
        clock["t"] = 144
        beat.tick()


def test_stuck_verdict_and_what_defers_it():
    gate = LivenessGate()
    beat, clock = heartbeat(iter([("EVENT_PENDING", None)] * 9), gate)
    for clock["t"] in (11, 22):
        beat.tick()
    beat.progress("2")  # a delivery starts the count anew
    for clock["t"] in (33, 44):
        beat.tick()
    gate.enter()  # a handler is at work
    clock["t"] = 55
    beat.tick()
    gate.leave()
    clock["t"] = 66
    with pytest.raises(resume.StreamStuckError):
        beat.tick()
    beat.cancel()
    clock["t"] = 99
    assert beat.tick() is None


# Supervision and election


def test_supervisor_restarts_until_it_gives_up():
    runs, waits = [], []

    def start(generation):
        runs.append(generation)
        raise ConnectionError

    sup = mg.Supervisor("s", start, RestartPolicy(3), sleep=waits.append, clock=lambda: 0)
    with pytest.raises(ConnectionError):
        sup.run()
    assert runs == [1, 2, 3, 4] and waits == [1, 2, 4]


def test_supervisor_counts_anew_after_proof_and_stops_on_lost_history():
    runs, waits = [], []

    def start(generation):
        runs.append(generation)
        if generation in (2, 3):
            sup.prove()
        if generation == 5:
            raise resume.HistoryLostError("s")
        raise ConnectionError

    sup = mg.Supervisor("s", start, RestartPolicy(2), sleep=waits.append, clock=lambda: 0)
    with pytest.raises(resume.HistoryLostError):
        sup.run()
    assert runs == [1, 2, 3, 4, 5] and waits == [1, 1, 1, 2]
    with pytest.raises(StopStream):
        mg.Supervisor("s", lambda g: (_ for _ in ()).throw(StopStream("RENAME", False)), sleep=waits.append).run()
    ends = iter([StopStream("DROP", True), None])
    assert mg.Supervisor("s", lambda g: (_ for _ in ()).throw(e) if (e := next(ends)) else None, sleep=waits.append).run() == "GRACEFUL"


def test_a_batch_that_does_not_end_is_an_error():
    from tidemark.streaming.manager import Supervisor
    from tidemark.streaming.runner import StillAtWorkError

    runner, metrics = StrictRunner(sp.stream("s").on_change(handler).build()), CountingMetrics()
    runner.left(0.01)
    supervisor = Supervisor("s", lambda n: runner.left(0.01), metrics=metrics)
    with runner._at_work, pytest.raises(StillAtWorkError):
        supervisor.run()
    assert supervisor.generation == 1 and metrics.last["on_stream_stopped"][1] == "CRASHED"


def test_election():
    locks, log, clock = MemoryLocks(), [], {"t": 0}
    make = lambda n: mg.LeaderElection("s", locks, n, lambda: log.append(f"{n}+"), lambda: log.append(f"{n}-"), now=lambda: clock["t"])
    a, b = make("a"), make("b")
    assert a.step() == mg.LEASE_RENEW and b.step() == mg.LEASE_POLL and (a.role, b.role) == ("LEADER", "STANDBY")
    clock["t"] = 61
    b.step()
    a.step()
    assert (a.role, b.role) == ("STANDBY", "LEADER") and log == ["a+", "b+", "a-"]
    locks.renew = lambda *args: 1 / 0
    b.step()
    assert b.role == "STANDBY" and log[-1] == "b-"


def test_manager():
    class Handle:
        last_event_time = NOW

        def __init__(self):
            self.alive = True

        def stop(self):
            self.alive = False

        def is_running(self):
            return self.alive

    registry = sp.Registry()
    for name, settings in (("a", {}), ("b", {"enabled": False}), ("c", {"auto_start": False})):
        registry.add(sp.stream(name).on_insert(handler).options(**settings).build())
    manager = mg.StreamManager(registry, lambda spec: Handle())
    assert manager.health() == {"status": "DOWN", "total": 1, "healthy": 0}
    assert manager.start_all() == ["a"] and manager.health()["status"] == "UP" and manager.last_event_time("a") == NOW
    assert manager.act("c", "start")["done"] and not manager.act("b", "start")["done"] and manager.act("a", "restart")["done"]
    assert "unknown action" in manager.act("a", "pause")["error"] and "no stream" in manager.act("x", "stop")["error"]
    assert manager.stop("a") and not manager.is_running("a") and manager.status()["streams"]["a"]["status"] == "DOWN"
    assert mg.StreamManager(sp.Registry(), lambda s: None).health()["status"] == "UP" and mg.StreamManager(registry, lambda s: Handle(), enabled=False).start_all() == []
    warnings.simplefilter("default")


def test_a_closed_anchor_writes_nothing():
    store = MemoryCheckpoints()
    anchor = ProcessedAnchor("s", store, sp.CheckpointPolicy(save_every=1))
    anchor.settle("5", NOW)
    anchor.close()
    store.save_processed("s", "9", NOW)  # its successor
    anchor.settle("6", NOW)
    assert not anchor.save_now("7", NOW) and not anchor.flush() and store.find("s").last_processed_token == "9"


def test_manual_actions_of_a_parallel_run(spark):
    def refuse(context):
        context.send_to_dead_letters("refused")

    def save(context):
        context.save_checkpoint_now()

    feed = spark.createDataFrame([(1, "1", "INSERT", 7, NOW, 1.5), (2, "2", "DELETE", 7, NOW, 2.5), (3, "3", "UPDATE", 8, NOW, 3.5)], "seq long, resume_token string, operation_type string, document_key long, cluster_time timestamp_ntz, value double")
    keyed = sp.stream("s").options(checkpoint=sp.CheckpointPolicy(), dead_letters=sp.DeadLetterPolicy()).on_delete(refuse).on_update(save).on_insert(lambda document: None).build()
    rows = {r.seq: r for r in run_keyed(feed, keyed).collect()}
    assert rows[1].outcome == "HANDLED" and rows[1].manual == []
    assert rows[2].outcome == "HANDLED" and len(rows[2].manual) == 1 and "ManualDlq" in rows[2].manual[0] and rows[2].letter is None
    assert rows[3].outcome == "DEAD_LETTER" and rows[3].error_type == "ActionUnavailableError"
    without = sp.stream("s").options(dead_letters=sp.DeadLetterPolicy()).on_delete(refuse).build()
    assert {r.error_type for r in run_keyed(feed, without).where("outcome = 'DEAD_LETTER'").collect()} == {"ActionUnavailableError"}


def test_keyed_tasks_do_not_grow_with_the_feed(spark, monkeypatch):
    from tidemark.streaming import runner

    monkeypatch.setattr(runner, "KEYED_EVENTS", 50)
    spec = sp.stream("s").options(dead_letters=sp.DeadLetterPolicy()).on_insert(lambda context: 1 // (context.seq % 10)).build()
    largest = []
    for n in (1000, 4000):
        feed = spark.range(n).selectExpr("id AS seq", "cast(id AS string) AS resume_token", "'INSERT' AS operation_type", f"id % {n // 4} AS document_key", "cast(null AS timestamp_ntz) AS cluster_time")
        rows = run_keyed(feed, spec).withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) == n and all(r.outcome == ("DEAD_LETTER" if r.seq % 10 == 0 else "HANDLED") for r in rows)
        homes = {}
        for r in rows:  # a key's events meet in one task, in order
            homes.setdefault(r.document_key, []).append((r.task, r.seq))
        assert all(len({t for t, _ in h}) == 1 and h == sorted(h) for h in homes.values())
        largest.append(max(sum(r.task == t for r in rows) for t in {r.task for r in rows}))
    assert max(largest) < 150
    letter = json.loads(next(r.letter for r in rows if r.seq == 0))
    assert letter["error"]["type"] == "ZeroDivisionError" and letter["attempts"] == 1 and letter["resume_token"] == "0"


def test_keyed_tasks_are_not_merged_after_a_lookup(spark):
    """A join that Spark plans by sorting and then does by broadcast had taken the place of the keys' own exchange."""
    from tidemark.sources.envelope import events_feed

    feed = events_feed(spark, "/root/testdata/sf0.01").select("seq", "resume_token", "operation_type", "document_key", "cluster_time", "value")
    spec = sp.stream("s").options(full_document="UPDATE_LOOKUP").on_insert(lambda context: None).build()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = run_keyed(feed, spec, current=lambda: feed.groupBy("document_key").agg(F.max_by("value", "seq").alias("value"))).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 10_000 and len({r.task for r in rows}) == n
    assert len({(r.document_key, r.task) for r in rows}) == 150  # a key's events meet in one task


def test_events_out_of_order_are_an_error(spark):
    feed = spark.range(20).selectExpr("20 - id AS seq", "cast(id AS string) AS resume_token", "'INSERT' AS operation_type", "id AS document_key", "cast(null AS timestamp_ntz) AS cluster_time").repartitionByRange(4, F.desc("seq"))
    runner = StrictRunner(sp.stream("s").on_insert(lambda document: None).build())
    with pytest.raises(DisorderError):
        runner.batch(feed)


def test_vectorised_handler(spark, sf_dir, tmp_path):
    spark.dataSource.register(FeedSource)
    feed = stream_feed(spark, f"file://{tmp_path}/v", path=f"{sf_dir}/events.parquet", maxEventsPerBatch=400)
    sums = []
    spec = sp.stream("v").on_change(lambda ctx: None).filter(F.col("value") > 50).build()
    query = run_vectorised(feed, spec, lambda df: sums.append(df.agg(F.count("*"), F.sum("event_id")).first()), f"file://{tmp_path}/v", available_now=False)
    drain(query)
    want = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 50").agg(F.count("*"), F.sum("event_id")).first()
    assert len(sums) > 1 and (sum(r[0] for r in sums), sum(r[1] or 0 for r in sums)) == tuple(want)


def test_before_images_and_required_documents(spark):
    rows = [(1, "1", "UPDATE", "k", None, "{\"a\": 1}", "{\"a\": 0}"), (2, "2", "INSERT", "k", None, "{\"a\": 2}", None)]
    feed = spark.createDataFrame(rows, "seq long, resume_token string, operation_type string, document_key string, cluster_time timestamp_ntz, full_document string, full_document_before_change string")
    seen = []
    spec = sp.stream("s").options(before_change="WHEN_AVAILABLE").on_change(lambda ctx: seen.append(ctx.before)).build()
    StrictRunner(spec).batch(feed)
    StrictRunner(sp.stream("s").on_change(lambda ctx: seen.append(ctx.before)).build()).batch(feed)
    assert seen == ["{\"a\": 0}", None, None, None]
    required = sp.stream("s").options(full_document="REQUIRED").on_change(lambda ctx: None).build()
    StrictRunner(required).batch(feed)
    with pytest.raises(Exception, match="no document at 1"):
        StrictRunner(required).batch(feed.withColumn("full_document", F.lit(None).cast("string")))
