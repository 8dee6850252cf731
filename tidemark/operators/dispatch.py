"""Row-level dispatch as Columns: routing, the filter funnel, error handlers and final outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.policies import RetryPolicy
from tidemark.operators.ordered import last_known

ACTIONS = ("SKIP", "DLQ", "RETRY", "RETHROW")
CATCH_ALL = 2**31 - 1
# The ancestor that stands for every error.
ANY = "*"


def route(typed: Mapping[str, str], on_change: str | None = None) -> Column:
    """The handler of an event: the typed one, else the catch-all, else null. INVALIDATE never reaches a handler."""
    handlers = F.create_map(*(F.lit(x) for pair in typed.items() for x in pair)) if typed else F.create_map().cast("map<string,string>")
    found = F.coalesce(F.element_at(handlers, F.col("operation_type")), F.lit(on_change).cast("string"))
    return F.when(F.col("operation_type") != "INVALIDATE", found)


def disposition(handler: Column, accepted: Column) -> Column:
    """What happens before any attempt, in this order: lifecycle, no handler, filter. All but DISPATCHED settle the event at once."""
    return (
        F.when(F.col("operation_type") == "INVALIDATE", "LIFECYCLE").when(handler.isNull(), "NO_HANDLER").when(~F.coalesce(accepted, F.lit(False)), "FILTERED").otherwise("DISPATCHED")
    )


def invalidate_causes(feed: DataFrame) -> DataFrame:
    """INVALIDATE events with the last DROP, DROP_DATABASE or RENAME before them; DROP where none is known."""
    cause = F.when(F.col("operation_type").isin("DROP", "DROP_DATABASE", "RENAME"), F.col("operation_type"))
    return last_known(feed, "seq", cause, "cause").where("operation_type = 'INVALIDATE'").withColumn("cause", F.coalesce("cause", F.lit("DROP")))


def ancestry(spark: SparkSession, types: Sequence[type[BaseException]]) -> DataFrame:
    """(error_type, ancestor, distance) of exception classes: a small dimension made from their method resolution order."""
    rows = [(t.__name__, a.__name__, d) for t in types for d, a in enumerate(c for c in t.__mro__ if c is not object)]
    return spark.createDataFrame(rows, "error_type string, ancestor string, distance int")


def resolve_handlers(errors: DataFrame, kinds: DataFrame, bindings: DataFrame) -> DataFrame:
    """Add handler and action of ``errors`` (error_type): the most specific binding (handler, position, ancestor or null for
    a catch-all, action); the first registered wins ties; RETHROW where nothing matches.

    The choice is made once per error type; kinds and bindings are as many as there are classes in the program.
    """
    types = kinds.select("error_type").distinct()
    every = types.select("error_type", F.lit(ANY).alias("ancestor"), F.lit(CATCH_ALL).alias("distance"))
    named = kinds.unionByName(every).join(bindings.withColumn("ancestor", F.coalesce("ancestor", F.lit(ANY))), "ancestor")
    best = named.groupBy("error_type").agg(F.min_by(F.struct("handler", "action"), F.struct("distance", "position")).alias("best"))
    found = types.join(best, "error_type", "left").select("error_type", F.col("best.handler").alias("handler"), F.coalesce("best.action", F.lit("RETHROW")).alias("action"))
    return errors.join(F.broadcast(found), "error_type", "left").withColumn("action", F.coalesce("action", F.lit("RETHROW")))


def outcomes(failures: Column, action: Column, ancestry_: Column, policy: RetryPolicy | None) -> tuple[Column, Column]:
    """(attempts, outcome) of an event whose first ``failures`` attempts fail.

    SKIP and DLQ end at the first failure. RETRY goes on while the policy has attempts left, whatever the error; RETHROW only
    for errors that the policy retries. An event that never succeeds is dead-lettered.
    """
    most = policy.max_attempts if policy else 1
    listed = lambda names: F.arrays_overlap(ancestry_, F.array(*map(F.lit, names))) if names else F.lit(False)
    eligible = (~listed(policy.no_retry_on) & (listed(policy.retry_on) if policy.retry_on else F.lit(True))) if policy else F.lit(False)
    tries = F.when((action == "RETRY") & F.lit(policy is not None), F.lit(most)).when((action == "RETHROW") & eligible, F.lit(most)).otherwise(F.lit(1))
    attempts = F.when(failures == 0, 1).otherwise(F.least(failures + 1, tries))
    outcome = F.when(failures < tries, "HANDLED").when(action == "SKIP", "SKIPPED").otherwise("DEAD_LETTER")
    return attempts.cast("int"), F.when(failures == 0, "HANDLED").otherwise(outcome)
