"""Joins of rows with a table of their groups, safe against groups that hold a large share of the rows."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A group of more than 1 / HOT_PARTS of all rows is hot; so there are fewer than HOT_PARTS hot groups, whatever the input.
HOT_PARTS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``; ``size``: its number of rows of ``total``).

    Hot groups are broadcast, at most HOT_PARTS rows of them. All others meet their rows in a shuffle, in which no key has more
    than 1 / HOT_PARTS of the rows. Keys aren't null.
    """
    bound = max(total // HOT_PARTS, 1)
    hot = F.broadcast(groups.where(F.col(size) > bound))
    cold = groups.where(F.col(size) <= bound)
    hot_keys = F.broadcast(groups.where(F.col(size) > bound).select(key))
    return rows.join(hot, key).unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """The rows, written to the shared checkpoint folder, with their lineage cut; ``batch``: most rows of an Arrow batch on the way."""
    shared_folder(df.sparkSession)
    with arrow_batches(df.sparkSession, batch) if batch else contextlib.nullcontext():
        return df.checkpoint()


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows in the Arrow functions of what runs meanwhile: for wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when the write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [quoted(c) for c in df.columns]


def quoted(name: str) -> Column:
    """The column of that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores at its end until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """The rows, written as compressed Parquet to the shared checkpoint folder and read again: for wide rows."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
