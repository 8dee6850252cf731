"""The change-event envelope and the feeds made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed: operation types, the feed's names for them, and which of them end a cursor or announce its end.
OPERATIONS = ("INSERT", "UPDATE", "REPLACE", "DELETE", "DROP", "DROP_DATABASE", "RENAME", "INVALIDATE")
WIRE_NAMES = {
    "insert": "INSERT", "update": "UPDATE", "replace": "REPLACE", "delete": "DELETE", "drop": "DROP", "dropDatabase": "DROP_DATABASE", "rename": "RENAME", "invalidate": "INVALIDATE",
}
LIFECYCLE = ("DROP", "DROP_DATABASE", "RENAME", "INVALIDATE")
DOCUMENT_OPERATIONS = ("INSERT", "UPDATE", "REPLACE", "DELETE")
# Fixed: how the events table maps to operations.
EVENT_OPERATIONS = {"signup": "INSERT", "click": "UPDATE", "view": "UPDATE", "purchase": "REPLACE", "error": "DELETE"}
TOKEN_WIDTH = 19

UPDATE_DESCRIPTION = T.StructType([
    T.StructField("updated_fields", T.MapType(T.StringType(), T.VariantType())),
    T.StructField("removed_fields", T.ArrayType(T.StringType())),
    T.StructField("truncated_arrays", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("new_size", T.IntegerType())]))),
])

ENVELOPE = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("resume_token", T.StringType(), False),
    T.StructField("operation_type", T.StringType()),
    T.StructField("db", T.StringType()),
    T.StructField("coll", T.StringType()),
    T.StructField("document_key", T.StringType()),
    T.StructField("cluster_time", T.TimestampNTZType()),
    T.StructField("wall_time", T.TimestampNTZType()),
    T.StructField("full_document", T.VariantType()),
    T.StructField("full_document_before_change", T.VariantType()),
    T.StructField("update_description", UPDATE_DESCRIPTION),
    T.StructField("lsid", T.StringType()),
    T.StructField("txn_number", T.LongType()),
])


def operation_type(wire: Column) -> Column:
    """Operation type of the feed's name for it; null stays null, an unknown name is an error."""
    names = F.create_map(*(F.lit(x) for pair in WIRE_NAMES.items() for x in pair))
    return F.when(wire.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(names, wire), F.raise_error(F.concat(F.lit("unknown operation type: "), wire))))


def resume_token(seq: Column) -> Column:
    """Fixed width, which all numbers fit, so that tokens sort as their numbers do; a negative number is an error."""
    whole = seq.cast("long")
    return F.when(whole < 0, F.raise_error(F.concat(F.lit("no token for "), whole.cast("string")))).otherwise(F.lpad(whole.cast("string"), TOKEN_WIDTH, "0"))


def seq_of(token: str) -> int:
    return int(token)


def mapped(column: Column, mapping: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), column)


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat feed over ``events``: envelope columns plus the document's fields as columns, so that filters reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("seq"), resume_token(F.col("event_id")).alias("resume_token"), mapped(F.col("event_type"), EVENT_OPERATIONS).alias("operation_type"),
        F.lit("testdb").alias("db"), F.lit("events").alias("coll"), F.col("user_id").alias("document_key"),
        F.date_trunc("SECOND", F.col("ts")).cast("timestamp_ntz").alias("cluster_time"), F.col("ts").alias("wall_time"), "event_type", "value", "props",
    )


def enveloped(feed: DataFrame) -> DataFrame:
    """The flat feed in the full envelope, its fields gathered in a document (absent after a DELETE)."""
    document = F.parse_json(F.to_json(F.struct("event_type", "value", F.from_json("props", "k long").alias("props"))))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in ENVELOPE if f.name in ("full_document_before_change", "update_description", "lsid", "txn_number")}
    return feed.select(
        "seq", "resume_token", "operation_type", "db", "coll", F.to_json(F.struct(F.col("document_key").alias("_id"))).alias("document_key"), "cluster_time", "wall_time",
        F.when(F.col("operation_type") != "DELETE", document).alias("full_document"), *(c.alias(n) for n, c in empty.items()),
    )


def orders_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with nested line items, one INSERT each, in key order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))).alias("items")
    )  # an order has a handful of lines
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("seq"), resume_token(F.col("o_orderkey")).alias("resume_token"), F.lit("INSERT").alias("operation_type"), F.lit("testdb").alias("db"), F.lit("orders").alias("coll"),
        F.col("o_orderkey").alias("document_key"), F.date_trunc("SECOND", F.col("o_orderdate")).cast("timestamp_ntz").alias("cluster_time"), F.col("o_orderdate").alias("wall_time"),
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.coalesce("items", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double,l_returnflag:string>>")).alias("items"),
    )


def event_metadata(feed: DataFrame, stream: str) -> DataFrame:
    """The six light columns of an event; its id is a hash of stream and token, so a replay writes the same id."""
    return feed.select(event_id(stream).alias("event_id"), "operation_type", F.col("coll").alias("collection_name"), "document_key", "cluster_time", "wall_time")


def event_id(stream: str) -> Column:
    return F.sha2(F.concat(F.lit(stream + "|"), F.col("resume_token")), 256)


def transaction(lsid: Column, txn_number: Column) -> Column:
    """Both halves of a transaction's identity, or null."""
    return F.when(lsid.isNotNull() & txn_number.isNotNull(), F.struct(lsid.alias("lsid"), txn_number.alias("txn_number")))
