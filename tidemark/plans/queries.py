"""Named queries over the feed, each with DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.policies import RestartPolicy, RetryPolicy
from tidemark.operators import dispatch, images, resume
from tidemark.operators.ordered import previous, running_total
from tidemark.plans.stages import compile_pipeline
from tidemark.sources import envelope
from tidemark.sources.envelope import events_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

FEED = """feed AS (
    SELECT event_id AS seq, lpad(CAST(event_id AS VARCHAR), 19, '0') AS resume_token,
           CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'REPLACE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
           user_id AS document_key, date_trunc('second', ts) AS cluster_time, ts AS wall_time, event_type, value, props FROM events)"""
TIME, SQL_TIME = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql.replace("{feed}", FEED).replace("{time}", SQL_TIME)
        return fn

    return register


def shown(time: str | Column) -> Column:
    return F.date_format(time, TIME)


# Sources and scans


@query("WITH {feed} SELECT seq, resume_token, operation_type, 'testdb' AS db, 'events' AS coll, document_key, strftime(cluster_time, '{time}') AS cluster_time, event_type, value, props FROM feed")
def feed_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed(spark, sf_dir).select("seq", "resume_token", "operation_type", "db", "coll", "document_key", shown("cluster_time").alias("cluster_time"), "event_type", "value", "props")


@query("""WITH {feed} SELECT seq, operation_type, '{"_id":' || document_key || '}' AS document_key, CASE WHEN operation_type <> 'DELETE' THEN event_type END AS doc_type,
    CASE WHEN operation_type <> 'DELETE' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS doc_k FROM feed""")
def feed_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.col("full_document")
    return envelope.enveloped(events_feed(spark, sf_dir)).select("seq", "operation_type", "document_key", F.try_variant_get(document, "$.event_type", "string").alias("doc_type"), F.try_variant_get(document, "$.props.k", "bigint").alias("doc_k"))


@query("WITH {feed} SELECT seq, resume_token, operation_type FROM feed WHERE resume_token > '000000000500'")
def resume_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.resume_after(events_feed(spark, sf_dir), "000000000500").select("seq", "resume_token", "operation_type")


@query("WITH {feed} SELECT seq, strftime(cluster_time, '{time}') AS cluster_time FROM feed WHERE cluster_time >= (SELECT cluster_time FROM feed WHERE seq = 500)")
def start_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events_feed(spark, sf_dir)
    return resume.start_at(feed, feed.where("seq = 500").first().cluster_time).select("seq", shown("cluster_time").alias("cluster_time"))


@query("WITH {feed} SELECT min(resume_token) AS oldest_token, max(resume_token) AS head_token, strftime(min(cluster_time), '{time}') AS oldest_time, strftime(max(cluster_time), '{time}') AS newest_time FROM feed")
def certified_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.positions(events_feed(spark, sf_dir)).select("oldest_token", "head_token", shown("oldest_time").alias("oldest_time"), shown("newest_time").alias("newest_time"))


@query("""WITH {feed}, p AS (SELECT unnest(['000000000000', '000000000400', '000000999999999']) AS token)
    SELECT token, CASE WHEN EXISTS (SELECT 1 FROM feed WHERE resume_token > token AND operation_type = 'DELETE') THEN 'EVENT_PENDING' ELSE 'EMPTY' END AS outcome FROM p""")
def bounded_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, pipeline = events_feed(spark, sf_dir), compile_pipeline([{"$match": {"operationType": {"$in": ["DELETE", "INVALIDATE"]}}}])
    return spark.createDataFrame([(t, resume.probe(feed, pipeline, t)[0]) for t in ("000000000000", "000000000400", "000000999999999")], "token string, outcome string")


@query("""WITH {feed} SELECT strftime(min(cluster_time), '{time}') AS oldest_time, strftime(max(cluster_time), '{time}') AS newest_time,
    round(greatest(date_diff('second', min(cluster_time), max(cluster_time)) / 3600.0, 0), 4) AS window_hours, 'OK' AS status FROM feed""")
def oplog_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.window_stats(events_feed(spark, sf_dir)).select(shown("oldest_time").alias("oldest_time"), shown("newest_time").alias("newest_time"), F.round("window_hours", 4).alias("window_hours"), "status")


@query("""SELECT o_orderkey AS seq, count(l_orderkey) AS n_items, coalesce(round(sum(l_extendedprice), 2), 0) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["l_extendedprice"])
    return envelope.orders_feed(spark, sf_dir).select("seq", F.size("items").cast("long").alias("n_items"), F.round(total, 2).alias("total"))


# Pipelines


def _piped(spark: SparkSession, sf_dir: str, *stages: dict) -> DataFrame:
    return compile_pipeline(list(stages))(events_feed(spark, sf_dir))


@query("WITH {feed} SELECT seq, document_key, value FROM feed WHERE event_type = 'click'")
def match_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piped(spark, sf_dir, {"$match": {"fullDocument.event_type": "click"}}).select("seq", "document_key", "value")


@query("WITH {feed} SELECT seq, operation_type, event_type FROM feed WHERE operation_type IN ('INSERT', 'REPLACE') AND event_type IN ('signup', 'purchase', 'view') AND value > 10")
def match_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piped(spark, sf_dir, {"$match": {"operationType": {"$in": ["INSERT", "REPLACE", "INVALIDATE"]}, "fullDocument.event_type": {"$in": ["signup", "purchase", "view"]}, "fullDocument.value": {"$gt": 10.0}}}).select("seq", "operation_type", "event_type")


@query("""WITH {feed} SELECT seq, value FROM feed WHERE operation_type <> 'DELETE' AND value > 10 AND value <= 50.5
    UNION ALL SELECT seq, value FROM feed WHERE operation_type <> 'DELETE' AND value > 99 AND value NOT IN (99.5, 100)""")
def match_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers against fractional values, in columns and in documents."""
    flat = _piped(spark, sf_dir, {"$match": {"operationType": {"$ne": "DELETE"}, "fullDocument.value": {"$gt": 10, "$lte": 50.5}}}).select("seq", "value")
    held = compile_pipeline([{"$match": {"fullDocument.value": {"$gt": 99, "$nin": [99.5, 100, "100"]}}}])(envelope.enveloped(events_feed(spark, sf_dir)))
    return flat.unionByName(held.select("seq", F.try_variant_get("full_document", "$.value", "double").alias("value")))


@query("WITH {feed} SELECT seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM feed WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 OR operation_type = 'DELETE'")
def match_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _piped(spark, sf_dir, {"$match": {"$or": [{"fullDocument.props.k": {"$gte": 50}}, {"operationType": "DELETE"}]}})
    return found.select("seq", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("WITH {feed} SELECT seq, resume_token, operation_type, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM feed")
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piped(spark, sf_dir, {"$project": {"operationType": 1, "fullDocument.event_type": 1, "fullDocument.props.k": 1}})


@query("WITH {feed} SELECT seq, resume_token, operation_type, value, event_type AS kind, 'eu' AS region FROM feed WHERE event_type = 'view'")
def add_unset_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = ({"$match": {"fullDocument.event_type": "view"}}, {"$set": {"kind": "$fullDocument.event_type", "region": "eu"}}, {"$unset": ["fullDocument.props", "wallTime"]})
    return _piped(spark, sf_dir, *stages).select("seq", "resume_token", "operation_type", "value", "kind", "region")


@query("SELECT o_orderkey AS seq, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS resume_token, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_orderstatus <> 'F'")
def replace_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = envelope.orders_feed(spark, sf_dir).withColumn("full_document", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")))
    return compile_pipeline([{"$match": {"fullDocument.status": {"$ne": "F"}}}, {"$replaceRoot": {"newRoot": "$fullDocument"}}])(orders)


# Images

STATE = """state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY seq DESC) AS rn FROM feed) WHERE rn = 1 AND operation_type <> 'DELETE')"""
BEFORE = """images AS (SELECT *, lag(CASE WHEN operation_type <> 'DELETE' THEN event_type END) OVER w AS before_type, lag(CASE WHEN operation_type <> 'DELETE' THEN value END) OVER w AS before_value,
    lag(CASE WHEN operation_type <> 'DELETE' THEN props END) OVER w AS before_props FROM feed WINDOW w AS (PARTITION BY document_key ORDER BY seq))"""


@query("WITH {feed}, " + STATE + " SELECT document_key, seq, operation_type, event_type, value, props FROM state")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.latest_state(events_feed(spark, sf_dir)).select("document_key", "seq", "operation_type", "event_type", "value", "props")


@query("WITH {feed}, " + BEFORE + " SELECT seq, document_key, operation_type, before_type, before_value, before_props FROM images")
def pre_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.pre_images(events_feed(spark, sf_dir))
    return out.select("seq", "document_key", "operation_type", F.col("before.event_type").alias("before_type"), F.col("before.value").alias("before_value"), F.col("before.props").alias("before_props"))


@query("WITH {feed}, " + STATE + """ SELECT f.seq, f.document_key, CASE WHEN f.operation_type = 'UPDATE' THEN s.event_type WHEN f.operation_type <> 'DELETE' THEN f.event_type END AS doc_type,
    CASE WHEN f.operation_type = 'UPDATE' THEN s.value WHEN f.operation_type <> 'DELETE' THEN f.value END AS doc_value FROM feed f LEFT JOIN state s USING (document_key)""")
def update_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.full_documents(events_feed(spark, sf_dir), "UPDATE_LOOKUP")
    return out.select("seq", "document_key", F.col("document.event_type").alias("doc_type"), F.col("document.value").alias("doc_value"))


@query("""WITH {feed}, """ + STATE + """ SELECT operation_type, count(*) AS events, count(*) FILTER (WHERE operation_type IN ('INSERT', 'REPLACE')) AS by_default,
    count(*) FILTER (WHERE operation_type <> 'DELETE') AS when_available, count(*) FILTER (WHERE CASE WHEN operation_type = 'UPDATE' THEN live ELSE operation_type <> 'DELETE' END) AS by_lookup
    FROM (SELECT f.operation_type, s.document_key IS NOT NULL AS live FROM feed f LEFT JOIN state s USING (document_key)) GROUP BY operation_type""")
def full_document_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events_feed(spark, sf_dir)
    out = images.full_documents(feed, "DEFAULT").withColumnRenamed("document", "d")
    out = images.full_documents(out, "WHEN_AVAILABLE").withColumnRenamed("document", "a")
    out = images.full_documents(out, "UPDATE_LOOKUP")
    return out.groupBy("operation_type").agg(F.count("*").alias("events"), F.count("d").alias("by_default"), F.count("a").alias("when_available"), F.count("document").alias("by_lookup"))


DIFF = """WITH {feed0}, feed AS (SELECT * REPLACE (CASE WHEN event_type <> 'view' THEN value END AS value) FROM feed0), """ + BEFORE + """,
    d AS (SELECT *, before_type IS NOT NULL AND before_type <> event_type AS type_set, value IS NOT NULL AND before_value IS DISTINCT FROM value AS value_set, before_props IS DISTINCT FROM props AS props_set,
                 value IS NULL AND before_value IS NOT NULL AS value_gone FROM images WHERE operation_type = 'UPDATE' AND before_type IS NOT NULL)"""
DIFF = DIFF.replace("{feed0}", FEED.replace("feed AS", "feed0 AS", 1))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events_feed(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    out = images.pre_images(feed).where("operation_type = 'UPDATE' AND before IS NOT NULL")
    updated, removed = images.differences(F.col("before"), F.struct(*images.DOCUMENT), images.DOCUMENT)
    return out.withColumn("updated", updated).withColumn("removed", removed)


@query(DIFF + """ SELECT seq, document_key, concat_ws(',', CASE WHEN type_set THEN 'event_type' END, CASE WHEN value_set THEN 'value' END, CASE WHEN props_set THEN 'props' END) AS updated,
    CASE WHEN value_gone THEN 'value' ELSE '' END AS removed FROM d""")
def update_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir).select("seq", "document_key", F.array_join("updated", ",").alias("updated"), F.array_join("removed", ",").alias("removed"))


@query(DIFF + """ SELECT event_type, count(*) AS updates, count(*) FILTER (WHERE value_set OR value_gone) AS value_changed, count(*) FILTER (WHERE value_gone) AS value_removed FROM d GROUP BY event_type""")
def field_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.map_from_arrays("updated", F.transform("updated", lambda f: F.parse_json(F.lit("1"))))
    described = _described(spark, sf_dir).withColumn("d", F.struct(values.alias("updated_fields"), F.col("removed").alias("removed_fields")))
    changed, gone = images.has_field_changed(F.col("d"), "value"), F.array_contains(images.removed_fields(F.col("d")), "value")
    return described.groupBy("event_type").agg(F.count("*").alias("updates"), F.count_if(changed).alias("value_changed"), F.count_if(gone).alias("value_removed"))


@query("""WITH n AS (SELECT o_orderkey AS seq, o_orderpriority, count(l_orderkey) AS size FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT seq, 'items' AS field, CAST(size - 1 AS INTEGER) AS new_size FROM n WHERE size > 0 AND o_orderpriority = '1-URGENT'""")
def truncated_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = envelope.orders_feed(spark, sf_dir)
    after = F.when(F.col("o_orderpriority") == "1-URGENT", F.slice("items", F.lit(1), F.greatest(F.size("items") - 1, F.lit(0)))).otherwise(F.col("items"))
    found = orders.select("seq", F.explode(images.truncations(F.col("items"), after, "items")).alias("t"))
    return found.select("seq", "t.field", "t.new_size")


@query("""WITH {feed} SELECT 's' || document_key AS lsid, CAST(floor(seq / 10) AS BIGINT) AS txn_number, count(*) AS events, min(seq) AS first_seq FROM feed
    WHERE document_key % 3 = 0 AND seq % 2 = 0 GROUP BY ALL""")
def txn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lsid = F.when(F.col("document_key") % 3 == 0, F.concat(F.lit("s"), F.col("document_key").cast("string")))
    number = F.when(F.col("seq") % 2 == 0, F.floor(F.col("seq") / 10))
    inside = events_feed(spark, sf_dir).withColumn("txn", envelope.transaction(lsid, number)).where("txn IS NOT NULL")
    return inside.groupBy(F.col("txn.lsid").alias("lsid"), F.col("txn.txn_number").alias("txn_number")).agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))


@query("""WITH {feed} SELECT seq, '[' || operation_type || '] events.' || left('user-' || lpad(CAST(document_key AS VARCHAR), 12, '0'), 12) || '… | stream=audit | ' || strftime(cluster_time, '{time}') || chr(10) || '  document: ' || props AS summary FROM feed""")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("user-"), F.lpad(F.col("document_key").cast("string"), 12, "0"))
    return events_feed(spark, sf_dir).select("seq", images.summary("audit", key, F.col("cluster_time"), F.col("props")).alias("summary"))


@query("WITH {feed} SELECT sha256('audit|' || resume_token) AS event_id, operation_type, 'events' AS collection_name, document_key, strftime(cluster_time, '{time}') AS cluster_time FROM feed")
def event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = envelope.event_metadata(events_feed(spark, sf_dir), "audit")
    return out.select("event_id", "operation_type", "collection_name", "document_key", shown("cluster_time").alias("cluster_time"))


# Dispatch, errors, retries

TYPED = {"INSERT": "on_insert", "UPDATE": "on_update", "DELETE": "on_delete"}


@query("""WITH {feed} SELECT operation_type, CASE operation_type WHEN 'INSERT' THEN 'on_insert' WHEN 'UPDATE' THEN 'on_update' WHEN 'DELETE' THEN 'on_delete' ELSE 'on_change' END AS handler,
    CASE operation_type WHEN 'INSERT' THEN 'on_insert' WHEN 'UPDATE' THEN 'on_update' WHEN 'DELETE' THEN 'on_delete' END AS typed_only, count(*) AS events FROM feed GROUP BY ALL""")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events_feed(spark, sf_dir).withColumn("handler", dispatch.route(TYPED, "on_change")).withColumn("typed_only", dispatch.route(TYPED))
    return feed.groupBy("operation_type", "handler", "typed_only").agg(F.count("*").alias("events"))


@query("""WITH {feed} SELECT CASE WHEN operation_type = 'REPLACE' THEN 'NO_HANDLER' WHEN value <= 20 THEN 'FILTERED' ELSE 'DISPATCHED' END AS disposition, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq
    FROM feed WHERE event_type <> 'view' GROUP BY ALL""")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = compile_pipeline([{"$match": {"fullDocument.event_type": {"$ne": "view"}}}])(events_feed(spark, sf_dir))
    feed = feed.withColumn("disposition", dispatch.disposition(dispatch.route(TYPED), F.col("value") > 20))
    return feed.groupBy("disposition").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("""WITH a AS (SELECT CAST(unnest(generate_series(1, 12)) AS BIGINT) AS attempt)
    SELECT 'fixture' AS policy, attempt, CAST(greatest(1, trunc(least(1000 * pow(3.0, attempt - 1), 60000))) AS BIGINT) AS delay_ms FROM a
    UNION ALL SELECT 'default', attempt, CAST(greatest(1, trunc(least(500 * pow(2.0, attempt - 1), 30000))) AS BIGINT) FROM a
    UNION ALL SELECT 'fraction', attempt, CAST(greatest(1, trunc(least(1001 * pow(1.5, attempt - 1), 5000))) AS BIGINT) FROM a
    UNION ALL SELECT 'zero', attempt, 0 FROM a""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = {"fixture": RetryPolicy(9, "1s", "60s", 3.0), "default": RetryPolicy(), "fraction": RetryPolicy(9, "1001ms", "5s", 1.5), "zero": RetryPolicy(9, "0ms", "5s")}
    attempts = spark.range(1, 13).withColumnRenamed("id", "attempt")
    delays = F.array(*(F.struct(F.lit(n).alias("policy"), p.delay_column(F.col("attempt")).alias("delay_ms")) for n, p in policies.items()))
    return attempts.select("attempt", F.inline(delays)).select("policy", "attempt", "delay_ms")


ERRORS = (ValueError, KeyError, TimeoutError, UnicodeDecodeError, ZeroDivisionError)
RETRYING = RetryPolicy(3, "1s", "60s", 3.0, False, (), ("ValueError", "AttributeError", "TypeError"))
LISTING = RetryPolicy(4, "1s", "60s", 3.0, False, ("OSError", "LookupError"), ("TimeoutError",))
KINDS = """kinds(error_type, no, list_ok) AS (VALUES ('ValueError', true, false), ('KeyError', false, true), ('TimeoutError', false, false), ('UnicodeDecodeError', true, false), ('ZeroDivisionError', false, false))"""


@query("WITH " + KINDS + """, a AS (SELECT CAST(unnest([1, 2, 3, 4]) AS BIGINT) AS attempt)
    SELECT error_type, attempt, attempt < 3 AND NOT no AS by_default, attempt < 4 AND list_ok AS by_list FROM kinds, a""")
def retry_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = dispatch.ancestry(spark, ERRORS).groupBy("error_type").agg(F.collect_set("ancestor").alias("ancestry"))
    rows = kinds.withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    return rows.select("error_type", "attempt", RETRYING.eligible_column(F.col("attempt"), F.col("ancestry")).alias("by_default"), LISTING.eligible_column(F.col("attempt"), F.col("ancestry")).alias("by_list"))


ERROR_OF = "CASE seq % 5 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' WHEN 2 THEN 'TimeoutError' WHEN 3 THEN 'UnicodeDecodeError' ELSE 'ZeroDivisionError' END"
RESOLVED = """resolved(error_type, handler, action) AS (VALUES ('ValueError', 'value', 'SKIP'), ('KeyError', 'lookup', 'RETRY'), ('TimeoutError', 'any', 'DLQ'), ('UnicodeDecodeError', 'unicode', 'RETHROW'), ('ZeroDivisionError', 'any', 'DLQ'))"""
BINDINGS = [("lookup", 0, "LookupError", "RETRY"), ("value", 1, "ValueError", "SKIP"), ("any", 2, None, "DLQ"), ("unicode", 3, "UnicodeError", "RETHROW"), ("late", 4, "ValueError", "DLQ")]


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events_feed(spark, sf_dir).withColumn("error_type", F.expr(ERROR_OF)).withColumn("failures", F.floor(F.col("seq") / 5) % 5)
    kinds = dispatch.ancestry(spark, ERRORS)
    bindings = spark.createDataFrame(BINDINGS, "handler string, position int, ancestor string, action string")
    return dispatch.resolve_handlers(feed, kinds, bindings)


@query("WITH {feed}, " + RESOLVED + " SELECT error_type, handler, action, count(*) AS events FROM (SELECT " + ERROR_OF + " AS error_type FROM feed) JOIN resolved USING (error_type) GROUP BY ALL")
def on_error_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failing(spark, sf_dir).groupBy("error_type", "handler", "action").agg(F.count("*").alias("events"))


OUTCOME = "WITH {feed}, " + RESOLVED + """, x AS (SELECT seq, resume_token, document_key, cluster_time, wall_time, event_type, """ + ERROR_OF + """ AS error_type, CAST(floor(seq / 5) AS BIGINT) % 5 AS failures FROM feed),
    t AS (SELECT x.*, action, CASE WHEN action = 'RETRY' THEN 3 WHEN action = 'RETHROW' AND error_type NOT IN ('ValueError', 'UnicodeDecodeError') THEN 3 ELSE 1 END AS tries FROM x JOIN resolved USING (error_type)),
    o AS (SELECT *, CAST(CASE WHEN failures = 0 THEN 1 ELSE least(failures + 1, tries) END AS INTEGER) AS attempts,
                 CASE WHEN failures = 0 OR failures < tries THEN 'HANDLED' WHEN action = 'SKIP' THEN 'SKIPPED' ELSE 'DEAD_LETTER' END AS outcome FROM t)"""


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.broadcast(dispatch.ancestry(spark, ERRORS).groupBy("error_type").agg(F.collect_set("ancestor").alias("ancestry")))
    rows = _failing(spark, sf_dir).join(kinds, "error_type")
    attempts, outcome = dispatch.outcomes(F.col("failures"), F.col("action"), F.col("ancestry"), RETRYING)
    return rows.withColumn("attempts", attempts).withColumn("outcome", outcome)


@query(OUTCOME + " SELECT seq, error_type, action, attempts, outcome FROM o")
def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).select("seq", "error_type", "action", "attempts", "outcome")


@query("""WITH a AS (SELECT CAST(unnest(generate_series(1, 10)) AS BIGINT) AS attempt) SELECT attempt, CAST(trunc(least(1000 * pow(2.0, attempt - 1), 60000)) AS BIGINT) AS delay_ms, attempt > 5 AS bounded_out, false AS unlimited_out FROM a""")
def restart_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("attempt")
    return spark.range(1, 11).withColumnRenamed("id", "attempt").select("attempt", RestartPolicy().delay_column(attempt).alias("delay_ms"), RestartPolicy(5).exhausted_column(attempt).alias("bounded_out"), RestartPolicy().exhausted_column(attempt).alias("unlimited_out"))


# Dead letters

LETTERS = OUTCOME + """, letters AS (SELECT sha256('audit|' || resume_token) AS id, event_type AS stream_name, '{"_id":' || document_key || '}' AS document_key, error_type, attempts, CASE WHEN seq % 7 = 0 THEN 'RESOLVED' ELSE 'PENDING' END AS status,
    cluster_time AS created_at, CASE WHEN event_type <> 'view' THEN cluster_time + INTERVAL 30 DAY END AS expires_at FROM o WHERE outcome = 'DEAD_LETTER')"""


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = _settled(spark, sf_dir).where("outcome = 'DEAD_LETTER'")
    days = F.when(F.col("event_type") == "view", 0).otherwise(30)
    return dead.select(
        envelope.event_id("audit").alias("id"), F.col("event_type").alias("stream_name"), F.to_json(F.struct(F.col("document_key").alias("_id"))).alias("document_key"), "error_type", "attempts",
        F.when(F.col("seq") % 7 == 0, "RESOLVED").otherwise("PENDING").alias("status"), F.col("cluster_time").alias("created_at"), scalars.plus_days(F.col("cluster_time"), days).alias("expires_at"),
    )


@query(LETTERS + " SELECT id, stream_name, document_key, error_type, attempts, status, strftime(created_at, '{time}') AS created_at, strftime(expires_at, '{time}') AS expires_at FROM letters")
def dlq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).withColumns({c: shown(c) for c in ("created_at", "expires_at")})


@query(LETTERS + " SELECT stream_name, count(*) AS pending FROM letters WHERE status = 'PENDING' GROUP BY stream_name")
def dlq_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).where("status = 'PENDING'").groupBy("stream_name").agg(F.count("*").alias("pending"))


@query(LETTERS + " SELECT id, stream_name FROM letters WHERE expires_at IS NULL OR expires_at > (SELECT max(cluster_time) FROM feed) + INTERVAL 20 DAY")
def dlq_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = resume.positions(events_feed(spark, sf_dir)).select((F.col("newest_time") + F.expr("INTERVAL 20 DAY")).alias("now"))
    return _letters(spark, sf_dir).join(F.broadcast(now)).where("expires_at IS NULL OR expires_at > now").select("id", "stream_name")  # one row: now


@query(LETTERS + """, again AS (SELECT id, stream_name, attempts + 1 AS attempts, 'RESOLVED' AS status, 1 AS version FROM letters WHERE stream_name = 'click' UNION ALL SELECT id, stream_name, attempts, status, 0 FROM letters)
    SELECT id, stream_name, attempts, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM again) WHERE rn = 1""")
def dlq_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _letters(spark, sf_dir).select("id", "stream_name", "attempts", "status")
    new = old.where("stream_name = 'click'").select("id", "stream_name", (F.col("attempts") + 1).alias("attempts"), F.lit("RESOLVED").alias("status"))
    return upserted(old, new, "id")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` with other keys."""
    values = F.struct(*(c for c in old.columns if c != key))
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(values, "_version").alias("_v")).select(key, "_v.*").select(old.columns)


@query(LETTERS + " SELECT id, stream_name, error_type FROM letters WHERE stream_name IN ('click', 'view') AND error_type = 'TimeoutError'")
def dlq_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup across the tables of several streams."""
    letters = _letters(spark, sf_dir).select("id", "stream_name", "error_type")
    return letters.where("stream_name = 'click'").unionByName(letters.where("stream_name = 'view'")).where("error_type = 'TimeoutError'")


# Anchors, resume, leases


@query("""WITH {feed}, s AS (SELECT seq, resume_token, row_number() OVER (ORDER BY seq) AS ordinal FROM feed WHERE value > 20) SELECT seq, resume_token, ordinal FROM s WHERE ordinal % 100 = 0""")
def anchor_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = events_feed(spark, sf_dir).where("value > 20").select("seq", "resume_token")
    return running_total(settled, "seq", F.lit(1).cast("long"), "ordinal").where("ordinal % 100 = 0")


def folded(rows: DataFrame, key: str, order: str, fold: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """An ordered fold per key: rows are dealt by key and sorted, and stream through with the state of one key."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.strip().split()[0] for f in schema.split(",")]
    target = pa.schema([(f.strip().split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.strip().split()[1]]) for f in schema.split(",")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, step = row[key], fold()
                if (made := step(row)) is not None:
                    out.append(made)
            yield pa.RecordBatch.from_pydict({c: [r[c] for r in out] for c in names}, target)

    return rows.repartition(n, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


@query()
def anchor_count_or_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of one stream per document key: persisted every 5 settlements, or 1 h after the last write when dirty."""

    def fold() -> Callable[[dict], dict | None]:
        state = {"n": 0, "at": None}

        def step(row: dict) -> dict | None:
            state["n"] += 1
            state["at"] = row["second"] if state["at"] is None else state["at"]
            if state["n"] < 5 and row["second"] - state["at"] < 3600:
                return None
            made = {"document_key": row["document_key"], "seq": row["seq"], "reason": "COUNT" if state["n"] >= 5 else "TIME", "settled": state["n"]}
            state.update(n=0, at=row["second"])
            return made

        return step

    rows = events_feed(spark, sf_dir).select("document_key", "seq", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "cluster_time").alias("second"))
    return folded(rows, "document_key", "seq", fold, "document_key long, seq long, reason string, settled long")


CHECKPOINTS = """c AS (SELECT document_key, max(CASE WHEN seq % 2 = 0 AND document_key % 4 <> 1 THEN resume_token END) AS processed, max(CASE WHEN document_key % 6 <> 1 THEN resume_token END) AS seen,
    max(CASE WHEN seq % 2 = 0 THEN cluster_time END) AS processed_at, max(CASE WHEN seq % 3 = 0 THEN cluster_time END) AS seen_at, max(CASE WHEN seq % 5 = 0 THEN cluster_time END) AS heartbeat_at,
    CASE document_key % 3 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'RESUME_FROM_NOW' ELSE 'RESUME_FROM_OPLOG_START' END AS strategy FROM feed GROUP BY document_key),
    b AS (SELECT lpad(CAST(max(seq) - 200 AS VARCHAR), 19, '0') AS oldest, max(resume_token) AS head, max(cluster_time) AS head_at FROM feed)"""


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint per key, and the feed's bounds (the last 200 events are kept) on every row."""
    feed = events_feed(spark, sf_dir)
    key, seq = F.col("document_key"), F.col("seq")
    saved = feed.groupBy("document_key").agg(
        F.max(F.when((seq % 2 == 0) & (key % 4 != 1), F.col("resume_token"))).alias("processed"), F.max(F.when(key % 6 != 1, F.col("resume_token"))).alias("seen"),
        F.max(F.when(seq % 2 == 0, F.col("cluster_time"))).alias("processed_at"), F.max(F.when(seq % 3 == 0, F.col("cluster_time"))).alias("seen_at"), F.max(F.when(seq % 5 == 0, F.col("cluster_time"))).alias("heartbeat_at"),
    )
    strategy = F.when(key % 3 == 0, "FAIL").when(key % 3 == 1, "RESUME_FROM_NOW").otherwise("RESUME_FROM_OPLOG_START")
    bounds = feed.agg(envelope.resume_token(F.max("seq") - 200).alias("oldest"), F.max("resume_token").alias("head"), F.max("cluster_time").alias("head_at"))
    return saved.withColumn("strategy", strategy).join(F.broadcast(bounds))  # one row


@query("WITH {feed}, " + CHECKPOINTS + """, d AS (SELECT *, CASE WHEN processed IS NULL AND seen IS NULL THEN 'BOOTSTRAP' WHEN processed BETWEEN oldest AND head THEN 'PROCESSED' WHEN seen BETWEEN oldest AND head AND seen IS DISTINCT FROM processed THEN 'SEEN'
        WHEN strategy = 'FAIL' THEN 'FAIL' WHEN strategy = 'RESUME_FROM_NOW' THEN 'FROM_NOW' ELSE 'FROM_OLDEST' END AS decision FROM c, b)
    SELECT document_key, strategy, decision, CASE decision WHEN 'PROCESSED' THEN processed WHEN 'SEEN' THEN seen WHEN 'FROM_OLDEST' THEN oldest WHEN 'FAIL' THEN NULL ELSE head END AS token FROM d""")
def resume_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision, token = resume.cascade(*(F.col(c) for c in ("processed", "seen", "oldest", "head", "strategy")))
    return _checkpoints(spark, sf_dir).select("document_key", "strategy", decision.alias("decision"), token.alias("token"))


@query("WITH {feed}, " + CHECKPOINTS + """ SELECT document_key, strftime(greatest(processed_at, seen_at, heartbeat_at), '{time}') AS lost_from, strftime(head_at, '{time}') AS lost_to,
    greatest(date_diff('second', greatest(processed_at, seen_at, heartbeat_at), head_at), 0) AS lost_seconds FROM c, b""")
def lost_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end, seconds = resume.lost_window(*(F.col(c) for c in ("processed_at", "seen_at", "heartbeat_at", "head_at")))
    return _checkpoints(spark, sf_dir).select("document_key", shown(start).alias("lost_from"), shown(end).alias("lost_to"), seconds.alias("lost_seconds"))


@query()
def lease_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease requests of two instances for a lease per document key: signup and click acquire, view and error renew, purchase releases. A lease lasts 2 h."""
    from tidemark.stores.memory import MemoryLocks

    def fold() -> Callable[[dict], dict | None]:
        locks = MemoryLocks()

        def step(row: dict) -> dict:
            instance, action = f"pod-{row['seq'] % 2}", {"signup": "ACQUIRE", "click": "ACQUIRE", "purchase": "RELEASE"}.get(row["event_type"], "RENEW")
            now = row["second"]
            granted = {"ACQUIRE": lambda: locks.try_acquire("s", instance, 7200, now), "RENEW": lambda: locks.renew("s", instance, 7200, now), "RELEASE": lambda: locks.release("s", instance)}[action]()
            state = locks.state("s", now)
            return {"document_key": row["document_key"], "seq": row["seq"], "action": action, "instance": instance, "granted": bool(granted), "owner": state.instance_id if state else None}

        return step

    rows = events_feed(spark, sf_dir).select("document_key", "seq", "event_type", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "cluster_time").alias("second"))
    return folded(rows, "document_key", "seq", fold, "document_key long, seq long, action string, instance string, granted boolean, owner string")


LIFECYCLE = "CASE WHEN seq % 101 = 0 THEN 'INVALIDATE' WHEN seq % 97 = 0 THEN (CASE seq % 3 WHEN 0 THEN 'DROP' WHEN 1 THEN 'RENAME' ELSE 'DROP_DATABASE' END) ELSE operation_type END"


@query("""WITH {feed}, x AS (SELECT seq, """ + LIFECYCLE + """ AS op FROM feed), y AS (SELECT *, last_value(CASE WHEN op IN ('DROP', 'RENAME', 'DROP_DATABASE') THEN op END IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cause FROM x)
    SELECT seq, coalesce(cause, 'DROP') AS cause, coalesce(cause, 'DROP') = 'RENAME' AS terminal FROM y WHERE op = 'INVALIDATE'""")
def invalidate_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = events_feed(spark, sf_dir).withColumn("operation_type", F.expr(LIFECYCLE))
    return dispatch.invalidate_causes(feed).select("seq", "cause", (F.col("cause") == "RENAME").alias("terminal"))


# Liveness, health, metrics


@query("""WITH {feed}, g AS (SELECT seq, cluster_time, lag(cluster_time) OVER (ORDER BY seq) AS before FROM feed) SELECT seq, date_diff('second', before, cluster_time) AS idle_seconds FROM g WHERE date_diff('second', before, cluster_time) > 300""")
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = previous(events_feed(spark, sf_dir).select("seq", "cluster_time"), [], "seq", {"before": F.col("cluster_time")})
    return feed.withColumn("idle_seconds", scalars.seconds_between(F.col("before"), F.col("cluster_time"))).where("idle_seconds > 300").select("seq", "idle_seconds")


@query("""WITH {feed}, f AS (SELECT *, CASE WHEN lag(operation_type) OVER w IS DISTINCT FROM operation_type THEN 1 ELSE 0 END AS starts FROM feed WINDOW w AS (PARTITION BY document_key ORDER BY seq)),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY document_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT document_key, operation_type, min(seq) AS first_seq, count(*) AS length FROM i GROUP BY document_key, operation_type, island HAVING count(*) >= 3""")
def stuck_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more events of one kind per key: gaps and islands."""
    feed = previous(events_feed(spark, sf_dir).select("document_key", "seq", "operation_type"), ["document_key"], "seq", {"before": F.col("operation_type")})
    starts = F.when(F.col("before").eqNullSafe(F.col("operation_type")), 0).otherwise(1)
    islands = running_total(feed, "seq", starts, "island", ["document_key"])
    return islands.groupBy("document_key", "operation_type", "island").agg(F.min("seq").alias("first_seq"), F.count("*").alias("length")).where("length >= 3").drop("island")


@query("""WITH {feed}, s AS (SELECT document_key, document_key % 5 <> 0 AS enabled, document_key % 7 <> 0 AS auto_start, arg_max(operation_type, seq) <> 'DELETE' AS running FROM feed GROUP BY document_key)
    SELECT count(*) AS total, count(*) FILTER (WHERE running) AS healthy, CASE WHEN count(*) = count(*) FILTER (WHERE running) THEN 'UP' ELSE 'DOWN' END AS status FROM s WHERE enabled AND auto_start""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(_streams(spark, sf_dir))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("document_key")
    last = events_feed(spark, sf_dir).groupBy(key.alias("stream")).agg(F.max_by("operation_type", "seq").alias("last_op"), F.max("cluster_time").alias("last_event_time"))
    return last.select("stream", (F.col("stream") % 5 != 0).alias("enabled"), (F.col("stream") % 7 != 0).alias("auto_start"), (F.col("last_op") != "DELETE").alias("running"), "last_event_time")


def health(streams: DataFrame) -> DataFrame:
    """UP when every enabled stream that starts by itself runs; none: UP."""
    counts = streams.where("enabled AND auto_start").agg(F.count("*").alias("total"), F.count_if("running").alias("healthy"))
    return counts.withColumn("status", F.when(F.col("total") == F.col("healthy"), "UP").otherwise("DOWN"))


@query("""WITH {feed}, s AS (SELECT document_key AS stream, arg_max(operation_type, seq) <> 'DELETE' AS running, max(cluster_time) AS last FROM feed GROUP BY document_key)
    SELECT stream, CASE WHEN running THEN 'UP' ELSE 'DOWN' END AS status, 'IMPERATIVE' AS mode, strftime(last, '{time}') AS last_event_time FROM s""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir).select("stream", F.when(F.col("running"), "UP").otherwise("DOWN").alias("status"), F.lit("IMPERATIVE").alias("mode"), shown("last_event_time").alias("last_event_time"))


@query(OUTCOME + """ SELECT event_type, count(*) AS events, count(*) FILTER (WHERE outcome = 'HANDLED') AS succeeded, count(*) FILTER (WHERE outcome = 'DEAD_LETTER') AS dead, sum(attempts) AS attempts, max(attempts) AS most_attempts FROM o GROUP BY event_type""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _settled(spark, sf_dir)
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "HANDLED").alias("succeeded"), F.count_if(F.col("outcome") == "DEAD_LETTER").alias("dead"), F.sum("attempts").alias("attempts"), F.max("attempts").alias("most_attempts"))


@query("SELECT 'on_delete,on_insert,on_update,ON_CHANGE' AS handlers")
def handler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handler names of a configuration snapshot: sorted, the catch-all last."""
    named = spark.createDataFrame([(v,) for v in TYPED.values()], "name string").agg(F.concat(F.array_sort(F.collect_list("name")), F.array(F.lit("ON_CHANGE"))).alias("names"))
    return named.select(F.array_join("names", ",").alias("handlers"))


@query("""WITH {feed} SELECT strftime(date_trunc('hour', wall_time), '{time}') AS window_start, operation_type, count(*) AS events, round(sum(value), 2) AS total FROM feed GROUP BY ALL""")
def windowed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed(spark, sf_dir).groupBy(F.window("wall_time", "1 hour").alias("w"), "operation_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(shown("w.start").alias("window_start"), "operation_type", "events", "total")


@query("""WITH {feed}, g AS (SELECT document_key, wall_time, CASE WHEN wall_time < lag(wall_time) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM feed WINDOW w AS (PARTITION BY document_key ORDER BY wall_time, seq)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY document_key ORDER BY wall_time ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT document_key, strftime(min(wall_time), '{time}') AS session_start, count(*) AS events FROM s GROUP BY document_key, session""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed(spark, sf_dir).groupBy("document_key", F.session_window("wall_time", "30 minutes").alias("s")).agg(F.count("*").alias("events")).select("document_key", shown("s.start").alias("session_start"), "events")


@query("""SELECT c_custkey, left(c_name, 12) || '…' AS short_id, lower(left(c_name, 1)) || substr(c_name, 2) AS decapitalised, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS capitalised,
    lower(regexp_replace(c_mktsegment, '(.)([A-Z])', '\\1-\\2', 'g')) IS NOT NULL AS has_kebab, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey * 1000 ELSE c_custkey * 60000 END AS duration_ms FROM customer""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    text = F.concat(key.cast("string"), F.when(key % 3 == 0, "ms").when(key % 3 == 1, "s").otherwise("m"))
    return customers.select(
        "c_custkey", scalars.short_id(F.col("c_name")).alias("short_id"), scalars.decapitalise_column(F.col("c_name")).alias("decapitalised"), scalars.capitalise_column(F.col("c_mktsegment")).alias("capitalised"),
        scalars.kebab_case_column(F.col("c_mktsegment")).isNotNull().alias("has_kebab"), scalars.duration_ms_column(text).alias("duration_ms"),
    )


@query("SELECT unnest(['HTTPFeed', 'OrderStream', 'plain']) AS name, unnest(['h-t-t-p-feed', 'order-stream', 'plain']) AS kebab, unnest(['hTTPFeed', 'orderStream', 'plain']) AS collection")
def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("HTTPFeed",), ("OrderStream",), ("plain",)], "name string")
    return names.select("name", scalars.kebab_case_column(F.col("name")).alias("kebab"), scalars.decapitalise_column(F.col("name")).alias("collection"))


# Streams


def shared_location(spark: SparkSession, name: str) -> str:
    """A new folder for a query's checkpoints, in the one that spark.checkpoint.dir names; a local one where that is unset (tests)."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4()}"


STREAM_EVENTS = 2500


def _stream_of(spark: SparkSession, sf_dir: str, location: str) -> DataFrame:
    """Events in batches of STREAM_EVENTS, many of which make a micro-batch; the runner's turns keep them apart."""
    from tidemark.sources.feed import stream_feed

    events = stream_feed(spark, location, path=f"{sf_dir}/events.parquet", maxEventsPerBatch=STREAM_EVENTS, batchesAtOnce=100)
    kind = envelope.mapped(F.col("event_type"), envelope.EVENT_OPERATIONS)
    return events.select(F.col("event_id").alias("seq"), envelope.resume_token(F.col("event_id")).alias("resume_token"), kind.alias("operation_type"), F.lit("events").alias("coll"), F.col("user_id").alias("document_key"), F.col("ts").alias("cluster_time"), "event_type", "value")


@query()
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of each event to a strict stream whose handler fails once in its second batch and is then started again."""
    from tidemark.plans.spec import CheckpointPolicy, stream
    from tidemark.sources.feed import drain
    from tidemark.stores.memory import MemoryCheckpoints
    from tidemark.streaming.runner import StrictRunner

    location = shared_location(spark, "replay")
    delivered, folder = array("q"), f"{location}-delivered"
    crash = {"left": 1}

    def put() -> None:
        spark.createDataFrame(pa.table({"seq": pa.array(np.array(delivered, dtype=np.int64))})).write.mode("append").parquet(folder)
        del delivered[:]

    def accepts(context) -> bool:
        if context.seq == 2700 and crash["left"]:
            crash["left"] = 0
            raise ConnectionError("the process dies here")
        return True

    def handle(context) -> None:
        delivered.append(context.seq)
        if len(delivered) >= 1_000_000:
            put()

    store = MemoryCheckpoints()

    def run() -> None:
        spec = stream("replay").options(collection="events", checkpoint=CheckpointPolicy(save_every=100)).on_change(handle).filter(accepts).build()
        drain(StrictRunner(spec, store).start(_stream_of(spark, sf_dir, location), location, seconds=0, turn_events=STREAM_EVENTS))

    try:
        run()
    except Exception:
        if crash["left"]:  # not the failure that is meant
            raise
    run()  # whatever fails here is the query's failure
    put()
    anchor = store.find("replay").last_processed_token
    return spark.read.parquet(folder).groupBy("seq").agg(F.count("*").cast("int").alias("deliveries")).withColumn("anchor", F.lit(anchor))


@query()
def stream_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of a strict stream whose handler refuses errors and fails on expensive purchases."""
    from tidemark.plans.spec import CheckpointPolicy, DeadLetterPolicy, stream
    from tidemark.sources.feed import drain
    from tidemark.stores.files import FileDeadLetters
    from tidemark.stores.memory import MemoryCheckpoints
    from tidemark.streaming.runner import StrictRunner

    def purchase(document, context) -> None:
        if document["value"] > 90:
            raise TimeoutError(f"no answer for {context.seq}")

    def refuse(context) -> None:
        context.send_to_dead_letters("refused")

    location = shared_location(spark, "letters")
    letters = FileDeadLetters(spark, f"{location}-written")
    retry = RetryPolicy(2, "1ms", "1ms", 1.0, False)
    spec = stream("letters").options(collection="events", checkpoint=CheckpointPolicy(save_every=500), retry=retry, dead_letters=DeadLetterPolicy()).on_replace(purchase).on_delete(refuse).build()
    runner = StrictRunner(spec, MemoryCheckpoints(), letters, sleep=lambda s: None)
    drain(runner.start(_stream_of(spark, sf_dir, location), location, seconds=0, turn_events=STREAM_EVENTS))
    return letters.table("id", "document_key", "error_type", "attempts", "status")


@query("""WITH {feed} SELECT seq, CASE operation_type WHEN 'REPLACE' THEN (CASE WHEN value > 90 THEN 'DEAD_LETTER' ELSE 'HANDLED' END) WHEN 'INSERT' THEN 'HANDLED' ELSE 'NO_HANDLER' END AS outcome,
    CAST(CASE WHEN operation_type = 'REPLACE' AND value > 90 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM feed""")
def keyed_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in parallel, each in order."""
    from tidemark.plans.spec import DeadLetterPolicy, stream
    from tidemark.streaming.runner import run_keyed

    def purchase(document) -> None:
        if document["value"] > 90:
            raise TimeoutError("no answer")

    spec = stream("parallel").options(collection="events", retry=RetryPolicy(2, "0ms", "0ms"), dead_letters=DeadLetterPolicy()).on_replace(purchase).on_insert(lambda document: None).build()
    return run_keyed(events_feed(spark, sf_dir), spec).select("seq", "outcome", "attempts")


@query("""WITH {feed}, now AS (SELECT document_key AS k, max_by(value, seq) AS current FROM feed GROUP BY document_key)
    SELECT seq, CASE WHEN operation_type <> 'UPDATE' THEN 'NO_HANDLER' WHEN current > 50 THEN 'DEAD_LETTER' ELSE 'HANDLED' END AS outcome FROM feed JOIN now ON document_key = k""")
def stream_update_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose updates carry the document as it is now; its handler refuses large values."""
    from tidemark.plans.spec import DeadLetterPolicy, stream
    from tidemark.streaming.runner import run_keyed

    def update(document) -> None:
        if document["value"] > 50:
            raise ValueError(document["value"])

    feed = events_feed(spark, sf_dir).select("seq", "resume_token", "operation_type", "document_key", "cluster_time", "value")
    spec = stream("lookup").options(collection="events", full_document="UPDATE_LOOKUP", dead_letters=DeadLetterPolicy()).on_update(update).build()
    return run_keyed(feed, spec, current=lambda: feed.groupBy("document_key").agg(F.max_by("value", "seq").alias("value"))).select("seq", "outcome")


@query("WITH {feed} SELECT seq, make_timestamp(seq * 86399 * 1000000) AS moment FROM feed")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_feed(spark, sf_dir).select("seq", scalars.from_epoch(F.col("seq") * 86399).alias("moment"))
