"""Connected components: parts of bounded size at once, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import join_groups, stored

# Links that one task joins by itself.
PART = 1 << 18


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forests(links: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) from each node to the smallest one of its component among the links (a, b) of one of ``parts`` parts at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(n: int) -> int:
            top = n
            while (up := above.setdefault(top, top)) != top:
                top = up
            while above[n] != top:
                above[n], n = top, above[n]
            return top

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        edges = [(n, root(n)) for n in list(above)]
        edges = [(u, v) for u, v in edges if u != v]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)] if edges else [pa.array([], pa.int64())] * 2, ["u", "v"])

    return links.coalesce(parts).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: longs, stored); root is the smallest node of its component.

    Parts of about PART links, whole partitions of ``links``, are joined to stars by one task each. Where there is more than one part, steps
    follow that connect nodes to the smallest neighbour, so that paths shrink to stars in a number of rounds that grows with the
    logarithm of the component's size. Nodes with very many neighbours are joined by ``join_groups``.
    """
    links = links.where("a <> b")
    parts = -(-links.count() // PART)
    edges = stored(forests(links, max(parts, 1)))
    before = _signature(edges) if parts > 1 else (0,)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = join_groups(both, least, "u", "degree", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = join_groups(large, lower, "u", "degree", before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
