"""Document images: current state, pre-images, update lookup, update descriptions and their accessors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import previous

FULL_DOCUMENT = ("DEFAULT", "UPDATE_LOOKUP", "WHEN_AVAILABLE", "REQUIRED")
BEFORE_CHANGE = ("OFF", "WHEN_AVAILABLE", "REQUIRED")
DOCUMENT = ("event_type", "value", "props")


def post_image(fields: Sequence[str] = DOCUMENT) -> Column:
    """The document after the event; null after a DELETE."""
    return F.when(F.col("operation_type") != "DELETE", F.struct(*fields))


def latest_state(feed: DataFrame, fields: Sequence[str] = DOCUMENT) -> DataFrame:
    """The last event of each key whose document lives. Aggregated before the shuffle, so a hot key costs one row per task."""
    last = feed.groupBy("document_key").agg(F.max_by(F.struct("seq", "operation_type", "cluster_time", *fields), "seq").alias("last"))
    return last.select("document_key", "last.*").where("operation_type <> 'DELETE'")


def pre_images(feed: DataFrame, mode: str = "WHEN_AVAILABLE", fields: Sequence[str] = DOCUMENT) -> DataFrame:
    """Add ``before``: the document before the event, null at first sight of a key and after a DELETE.

    REQUIRED fails where an update, replace or delete has none; OFF gives null everywhere.
    """
    if mode not in BEFORE_CHANGE:
        raise ValueError(f"unknown mode {mode}")
    image = post_image(fields)
    if mode == "OFF":
        return feed.withColumn("before", F.when(F.lit(False), image))
    out = previous(feed, ["document_key"], "seq", {"before": image})
    if mode == "REQUIRED":
        missing = F.col("operation_type").isin("UPDATE", "REPLACE", "DELETE") & F.col("before").isNull()
        out = out.withColumn("before", F.when(missing, F.raise_error(F.concat(F.lit("no pre-image at "), "resume_token"))).otherwise(F.col("before")))
    return out


def full_documents(feed: DataFrame, mode: str = "DEFAULT", fields: Sequence[str] = DOCUMENT) -> DataFrame:
    """Add ``document`` by mode: DEFAULT leaves it out of updates; UPDATE_LOOKUP takes the state at the feed's end;
    WHEN_AVAILABLE the post-image or null; REQUIRED the post-image or an error."""
    if mode not in FULL_DOCUMENT:
        raise ValueError(f"unknown mode {mode}")
    image = post_image(fields)
    if mode == "DEFAULT":
        return feed.withColumn("document", F.when(F.col("operation_type") != "UPDATE", image))
    if mode == "UPDATE_LOOKUP":
        current = latest_state(feed, fields).select(F.col("document_key").alias("_key"), F.struct(*fields).alias("_current"))
        joined = feed.join(current, F.col("document_key") == F.col("_key"), "left")
        return joined.withColumn("document", F.when(F.col("operation_type") == "UPDATE", F.col("_current")).otherwise(image)).drop("_key", "_current")
    if mode == "REQUIRED":
        image = F.when((F.col("operation_type") == "UPDATE") & image.isNull(), F.raise_error(F.concat(F.lit("no document at "), "resume_token"))).otherwise(image)
    return feed.withColumn("document", image)


def differences(before: Column, after: Column, fields: Sequence[str]) -> tuple[Column, Column]:
    """Names of fields that an update set, and of those it removed (known before, null after)."""
    pick = lambda test: F.filter(F.array(*(F.when(test(before[f], after[f]), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    updated = pick(lambda b, a: a.isNotNull() & ~b.eqNullSafe(a))
    removed = pick(lambda b, a: a.isNull() & b.isNotNull())
    return updated, removed


def truncations(before: Column, after: Column, path: str) -> Column:
    """An array that an update only shortened, as (field, new_size); else no entries."""
    size = F.size(after)
    shorter = before.isNotNull() & after.isNotNull() & (size < F.size(before))
    prefix = F.slice(before, F.lit(1), F.greatest(size, F.lit(0)))
    entry = F.array(F.struct(F.lit(path).alias("field"), size.cast("int").alias("new_size")))
    return F.when(F.coalesce(shorter & (prefix == after), F.lit(False)), entry).otherwise(F.slice(entry, 1, 0))


def has_field_changed(description: Column, path: str) -> Column:
    """Exactly this path is updated or removed; its parents and children don't count."""
    updated = F.coalesce(F.map_contains_key(description["updated_fields"], F.lit(path)), F.lit(False))
    return updated | F.coalesce(F.array_contains(description["removed_fields"], path), F.lit(False))


def updated_value(description: Column, path: str, kind: str, strict: bool = True) -> Column:
    """Value of an updated field; null when absent or null. A value of another kind is an error if ``strict``, else null."""
    value = F.element_at(description["updated_fields"], F.lit(path))
    return F.variant_get(value, "$", kind) if strict else F.try_variant_get(value, "$", kind)


def removed_fields(description: Column) -> Column:
    return F.coalesce(description["removed_fields"], F.array().cast("array<string>"))


def truncated_arrays(description: Column) -> Column:
    return F.coalesce(description["truncated_arrays"], F.array().cast("array<struct<field:string,new_size:int>>"))


def summary(stream: str, key: Column, time: Column, document: Column | None = None) -> Column:
    """[OP] collection.<key> | stream=... | time, and the document on a line of its own."""
    from tidemark.functions.scalars import short_id

    head = F.concat(F.lit("["), F.col("operation_type"), F.lit("] "), F.col("coll"), F.lit("."), short_id(key.cast("string")), F.lit(f" | stream={stream} | "), F.date_format(time, "yyyy-MM-dd HH:mm:ss"))
    return head if document is None else F.concat_ws("\n", head, F.concat(F.lit("  document: "), document))
