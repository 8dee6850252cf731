"""Operator 3, mixing sources to target weights: Poisson replication.

A source with target weight w and share s of the rows gets the mean repetition rate w / s times ``epochs``. A document's
count is the inverse of the Poisson distribution with that mean at a uniform number taken from a seeded hash of its id. A mean beyond
``MEAN`` is halved often enough that it fits, in equal parts: the count is then the sum of the parts' inverses at numbers of their own, which has the same
distribution. So a source's table of the distribution function has a bounded length, whatever its rate.
Each document is exploded by its count and every copy goes to a place given by a hash of (seed, id, copy): a global
shuffle that any run repeats. All of it is built-in DataFrame functions.

Weights of sources that aren't named are those of ``other`` times the source's share of the rows not named, so that a
default of 1 leaves them at their natural rate. The table of sources is small unless there are as many sources as
documents: it is counted, and broadcast up to ``BROADCAST_SOURCES`` rows; beyond that the join shuffles, with
the rows of the large side salted.

Defined cases: a null source is a source of its own; a null text is replicated like others; a null doc_id has the hash
of null and thus one count for all such rows of a source; repeated rows get the same count; an empty table gives no rows;
other columns, of whatever name, are passed through: where one has the name of a column of the operator, that one gets an underscore.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import every, fresh, quoted

BROADCAST_SOURCES = 10_000
SALTS = 64
# The largest mean that is inverted at once.
MEAN = 64
# Names the operator uses; the first four are in its result.
OWN = ("mix_rate", "mix_copies", "mix_copy", "mix_key", "mix_source", "mix_parts", "mix_steps", "mix_salt", "mix_slot")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def poisson_steps(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... up to where it reaches 1 in double precision, as an array."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean) - F.log(k.cast("double"))
        total = F.least(acc["total"] + F.exp(log_p), F.lit(1.0))
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["steps"])).otherwise(F.array(F.lit(1.0)))


def inverse_poisson(u: Column, steps: Column) -> Column:
    """How many values of the distribution function lie at or below ``u``: the least k whose value is above it."""
    return F.size(F.filter(steps, lambda c: c <= u))


def parts_of(mean: Column) -> Column:
    """Equal parts, a power of two of them, in which ``mean`` is at most MEAN each."""
    return F.when(mean > MEAN, F.pow(F.lit(2.0), F.ceil(F.log2(mean / MEAN)))).otherwise(1.0).cast("long")


def copies(parts: Column, steps: Column, *key: Column) -> Column:
    """The count of a document whose key is ``key``; ``steps``: distribution function of one part."""
    drawn = F.aggregate(F.sequence(F.lit(1).cast("long"), parts), F.lit(0).cast("long"), lambda total, i: total + inverse_poisson(uniform(*key, i), steps))
    return F.when(parts > 1, drawn).otherwise(inverse_poisson(uniform(*key), steps)).cast("int")


def source_rates(docs: DataFrame, weights: Mapping[str, float], other: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """Rows, mean repetition rate and distribution of each source."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n_docs"))
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.coalesce("source", F.lit(""))), F.lit(None).cast("double")) if weights else F.lit(None).cast("double")
    counts = counts.withColumn("named", named)
    totals = counts.agg(F.sum("n_docs").alias("n"), F.sum(F.when(F.col("named").isNull(), F.col("n_docs"))).alias("rest")).first()
    n, rest = totals.n or 0, totals.rest or 0
    whole = sum(weights.values()) + (other * rest / n if n else 0)
    weight = F.coalesce("named", F.lit(other) * F.col("n_docs") / F.lit(max(n, 1)))
    rate = F.lit(float(epochs)) * (weight / F.lit(whole or 1.0)) / (F.col("n_docs") / F.lit(max(n, 1)))
    rates = counts.select("source", "n_docs", rate.alias("rate")).withColumn("parts", parts_of(F.col("rate")))
    return rates.withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))


def mix_sources(docs: DataFrame, weights: Mapping[str, float], other: float = 1.0, epochs: float = 1.0, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """All copies, dealt and sorted in their global random order.

    Beside the columns of ``docs`` the result has mix_rate, mix_copies, mix_copy (from 0) and mix_key, by which it is sorted
    over all partitions.
    """
    rate, count, copy, key, source, parts, steps, salt, slot = (fresh(docs, name) for name in OWN)
    doc_id = quoted("doc_id")
    rates = source_rates(docs, weights, other, epochs).persist()
    try:
        small = rates.count() <= BROADCAST_SOURCES
        right = rates.select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("parts").alias(parts), F.col("steps").alias(steps))
        same = quoted("source").cast("string").eqNullSafe(F.col(source))
        if small:
            bounded = rates.sparkSession.createDataFrame(right.toArrow())  # at most BROADCAST_SOURCES rows
            rows = docs.join(F.broadcast(bounded), same)
        else:
            rows = docs.withColumn(salt, F.pmod(F.xxhash64(F.lit(seed), F.lit("salt"), doc_id), F.lit(SALTS)))
            right = right.withColumn(slot, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            rows = rows.join(right, same & (F.col(salt) == F.col(slot)))
    finally:
        rates.unpersist()
    rows = rows.select(*every(docs), rate, copies(F.col(parts), F.col(steps), F.lit(seed), doc_id).alias(count))
    rows = rows.where(F.col(count) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    rows = rows.withColumn(key, F.xxhash64(F.lit(seed), F.lit("order"), doc_id, F.col(copy)))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Keys are even over the signed 64-bit range, so equal ranges need no sampling pass.
    share = F.pmod(F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53)) + 0.5, F.lit(1.0))
    place = F.least(F.floor(share * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, place).sortWithinPartitions(F.col(key), doc_id, F.col(copy))


def mixing_digest(docs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``mix_sources`` with a hash of the text in place of other columns."""
    out = mix_sources(docs.select("doc_id", "source", "text"), weights)
    return out.select("doc_id", "source", "mix_rate", "mix_copies", "mix_copy", "mix_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
