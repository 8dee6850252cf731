"""Ordered computations that no single task carries.

A window over a whole feed, or over one very active key, would run in one task. Here rows fall into blocks of their sequence number;
a window runs inside each block (and key), and a small summary per block carries values over from earlier blocks. The summary
has one row per block and key, and its join meets rows that the window has already dealt by the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000
_B = "_block"


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / block))


def _carried(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, _B)]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return df.alias("r").join(summary.alias("s"), condition, "left")


def _finish(df: DataFrame, joined: DataFrame, made: dict[str, Column]) -> DataFrame:
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), *(c.alias(n) for n, c in made.items()))


def previous(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add, under the names of ``values``, their values at the row before (same keys, by ``order``)."""
    whole = F.struct(*(c.alias(n) for n, c in values.items()))
    rows = _blocked(df, order, block)
    inner = Window.partitionBy(*keys, _B).orderBy(order)
    last = rows.groupBy(*keys, _B).agg(F.max_by(whole, F.col(order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(_B))).drop("_last")
    joined = _carried(rows.withColumn("_prior", F.lag(whole).over(inner)), carry, keys)
    prior = F.coalesce(F.col("r._prior"), F.col("s._carry"))
    return _finish(df, joined, {n: prior[n] for n in values})


def last_known(df: DataFrame, order: str, value: Column, name: str, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Add the last value that isn't null up to and including the row."""
    rows = _blocked(df, order, block).withColumn("_value", value)
    inner = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy(*keys, _B).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    joined = _carried(rows.withColumn("_own", F.last("_value", ignorenulls=True).over(inner)), carry, keys)
    return _finish(df, joined, {name: F.coalesce(F.col("r._own"), F.col("s._carry"))})


def running_total(df: DataFrame, order: str, value: Column, name: str, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Add the sum of ``value`` up to and including the row."""
    rows = _blocked(df, order, block).withColumn("_value", value)
    inner = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, _B).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("_carry", F.sum("_sum").over(before)).drop("_sum")
    joined = _carried(rows.withColumn("_own", F.sum("_value").over(inner)), carry, keys)
    return _finish(df, joined, {name: F.col("r._own") + F.coalesce(F.col("s._carry"), F.lit(0))})
