"""Operator 8, near duplicates: HyperMinHash sketches, banding, estimation, exact verification, components.

A document's set is that of its distinct ``shingle``-word shingles. Its sketch deals the shingles' hashes into REGISTERS buckets and
keeps of each bucket's least value the number of leading zeros and MANTISSA bits after them. A bucket without shingles holds
the same for the least of all shingles under a hash of its own, so small sets have full sketches too.

Documents with equal texts form a class, and only classes are compared. Bands of four registers give the candidates:

1. In each bucket of a band every class is paired with the bucket's smallest. Pairs are first estimated from the registers
   (collision-corrected; pairs more than five standard errors below the threshold go) and then verified on full sets.
2. Components of the links found are formed. A bucket whose classes all lie in one component is done: more links in it
   can't change the result. Other buckets that share classes form families; a family is compared as one group, or bucket by bucket where
   that takes fewer comparisons. In each group the classes outside its leading component meet, in tiles of bounded size, the classes of other
   components whose set sizes are near enough to theirs. Pairs that the estimate leaves open only mark their members; the members' full sets meet in
   the same tiles, where all intersections are counted at once, and a link is returned only where it joins two components.

So no bucket is capped and no pairs are listed but those with a bucket's leader. Shingle sets are compared as sets of 64-bit hashes.

Chance of missing a link: a pair at similarity 0.8 has a band in common with probability 1 - (1 - 0.8**4)**32, above 1 - 1e-7.

Defined cases: a null or wordless text has an empty set and is linked with nothing, not even its equals; repeated rows are one class, and all rows of the smallest
doc_id count as kept; a class without any doc_id has component_id null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.joins import HOT_PARTS, fresh, join_groups, quoted, stored, written
from tidemark.llm.textkit import BLANKS, Words, grams, lower_ascii, map_slices, mix, raw_bytes, slices, text_of

REGISTERS, MANTISSA, BAND = 128, 10, 4
CHUNK, BLOCK, COLUMNS = 256, 512, 4096
# A family is compared as one group if that takes at most so many times the comparisons of its buckets.
FAMILY = 1
TILE = ("grp", "level", "block", "part")
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_sets(texts: pa.Array, shingle: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, joined; and each text's bounds in them."""
    data, bounds = raw_bytes(texts)
    words = Words(lower_ascii(data), bounds, BLANKS)
    doc = words.doc_of()
    whole = grams(words.hash, shingle)
    fits = doc[: len(whole)] == doc[shingle - 1 :] if len(whole) else np.zeros(0, bool)
    docs, hashes = [doc[: len(whole)][fits]], [whole[fits]]
    for n in range(1, shingle):  # texts of n words: the whole sequence
        short = np.flatnonzero(words.counts == n)
        if len(short):
            sequence = words.hash[words.offsets[short][:, None] + np.arange(n)]
            total = np.zeros(len(short), np.uint64)
            for k in range(n):
                total = total * np.uint64(0x9E3779B97F4A7C15) + sequence[:, k]
            docs.append(short)
            hashes.append(mix(total + np.uint64(n)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h) != 0) | (np.diff(doc) != 0)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def compress(values: np.ndarray) -> np.ndarray:
    """Registers of 57-bit values: leading zeros plus one, then the bits after the leading one."""
    values = np.maximum(values, np.uint64(1))
    top = np.floor(np.log2(values.astype(np.float64))).astype(np.int64)
    top -= (values >> top.astype(np.uint64)) == 0  # rounding up to the next power
    zeros = 56 - top
    shifted = (values << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 57) - 1)
    return ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | shifted >> np.uint64(57 - MANTISSA)).astype(np.uint16)


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of each text; zeros where the set is empty."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    scrambled = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    bucket = (scrambled >> np.uint64(57)).astype(np.int64)
    value = scrambled & np.uint64((1 << 57) - 1)
    least = np.full(n * REGISTERS, np.uint64(1 << 63), np.uint64)
    np.minimum.at(least, doc * REGISTERS + bucket, value)
    least = least.reshape(n, REGISTERS)
    for i in np.flatnonzero((least >= np.uint64(1 << 63)).any(1) & (np.diff(bounds) > 0)).tolist():
        empty = np.flatnonzero(least[i] >= np.uint64(1 << 63))
        own = hashes[bounds[i] : bounds[i + 1]]
        least[i, empty] = (mix(own[None, :] ^ _SEEDS[empty][:, None]) & np.uint64((1 << 57) - 1)).min(1)
    out = compress(least)
    out[np.diff(bounds) == 0] = 0
    return out


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of these sizes agree."""
    zeros = np.arange(1, 58)
    spread = lambda n: (1 - 2.0**-zeros) ** np.maximum(n[..., None] / REGISTERS, 1) - (1 - 2.0 ** -(zeros - 1.0)) ** np.maximum(n[..., None] / REGISTERS, 1)
    return (spread(np.asarray(n_a, float)) * spread(np.asarray(n_b, float))).sum(-1) * 2.0**-MANTISSA


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less those that agree by chance."""
    by_chance = chance(n_a, n_b)
    return np.clip((equal / REGISTERS - by_chance) / (1 - by_chance), 0, 1)


def cut(threshold: float) -> float:
    """The estimate below which a pair at the threshold is out of question."""
    return threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def sketch_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, n_shingles, registers of each row."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_sets(text_of(piece), shingle)
        rows = sketches(hashes, bounds).astype(">u2")
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(np.diff(bounds)), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "key", "n_shingles", "registers"])

    return map_slices(docs.select("doc_id", text_key().alias("key"), "text"), run, "doc_id long, key binary, n_shingles long, registers binary")


def bands() -> Column:
    """A hash for each band of a class's registers."""
    width = 2 * BAND
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substr(F.col("registers"), i * width + 1, F.lit(width))))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """Of pairs (a, b) those whose sets have ``threshold`` percent in common.

    The text of every b goes to a chunk of its a (at most about CHUNK pairs each), whose text goes there once. Chunks are read in sorted order, so
    a task holds one a and one slice of bs.
    """
    degrees = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    total = pairs.count()
    chunked = join_groups(pairs, degrees, "a", "degree", total).withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / CHUNK)))
    chunked = stored(chunked.select("a", "b", "chunk"))
    heads = chunked.select("a", "chunk").distinct().join(texts, F.col("a") == F.col("node")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "n_shingles", "registers", "text")
    bodies = chunked.join(texts, F.col("b") == F.col("node")).select("a", "chunk", "b", "n_shingles", "registers", "text")
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.unionByName(bodies).repartition(partitions, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    least = cut(threshold / 100)
    head: dict = {}

    def run(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, bounds = shingle_sets(text_of(piece), shingle)
        registers = [np.frombuffer(r, ">u2") for r in piece.column("registers").to_pylist()]
        sizes = piece.column("n_shingles").to_pylist()
        links = []
        for i, (a, b) in enumerate(zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True)):
            own = hashes[bounds[i] : bounds[i + 1]]
            if b is None:
                head.update(a=a, set=own, registers=registers[i], size=sizes[i])
                continue
            if head["a"] != a:
                raise ValueError("a chunk without its head")
            if 100 * min(sizes[i], head["size"]) < threshold * max(sizes[i], head["size"]):
                continue
            if estimate(np.array(int((registers[i] == head["registers"]).sum())), sizes[i], head["size"]) < least:
                continue
            both = len(own) + len(head["set"])
            common = both - len(np.union1d(own, head["set"]))
            if 100 * common >= threshold * (both - common):
                links.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"]) if links else None

    return map_slices(dealt, run, "a long, b long")


def size_level(size: Column, threshold: int) -> Column:
    """Sets can only be alike enough if they are of one level or of two next to each other."""
    ratio = 0.99 * min(threshold, 99) / 100  # a little wider than need be, for rounding
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(ratio))).cast("long")


def open_groups(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Rows (grp, band, node, leader, component, outside) of the groups in which links may still be missing.

    A bucket is open if some class lies outside its leader's component. Open buckets that share classes form a family. Its classes
    are compared once, as one group with band -1, if that takes no more comparisons than all its buckets do; else its buckets are.
    """
    named = members.where("n > 2").join(labels.withColumnRenamed("root", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    leaders = labels.select(F.col("node").alias("leader"), F.col("root").alias("leader_component"))
    named = named.join(leaders, "leader", "left").withColumn("outside", F.col("component") != F.coalesce("leader_component", "leader"))
    named = stored(named.select("bucket", "band", "node", "leader", "n", "component", "outside"))
    buckets = named.where("outside").groupBy("bucket").agg(F.max("n").alias("size"), F.max("leader").alias("head"), (F.max("n") * F.count("*")).alias("cost"))
    within = stored(join_groups(named, buckets.select("bucket", "size"), "bucket", "size", total).drop("size", "n"))
    family = stored(components(stored(within.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()))).withColumnRenamed("root", "family")
    nodes = within.select("node", "component").distinct().join(family, "node")
    shares = nodes.groupBy("family", "component").agg(F.count("*").alias("share"))
    size = shares.groupBy("family").agg(F.max(F.struct("share", "component")).alias("main"), F.sum("share").alias("size"))
    costs = buckets.join(family, F.col("head") == F.col("node")).groupBy("family").agg(F.sum("cost").alias("cost"))
    choice = size.join(costs, "family").select("family", "size", F.col("main.component").alias("main"), (F.col("size") * (F.col("size") - F.col("main.share")) <= FAMILY * F.col("cost")).alias("whole"))
    nodes = stored(join_groups(nodes, stored(choice), "family", "size", total))
    whole = nodes.where("whole").select(F.col("family").alias("grp"), F.lit(-1).alias("band"), "node", F.lit(-1).cast("long").alias("leader"), "component", (F.col("component") != F.col("main")).alias("outside"))
    single = within.join(nodes.where("not whole").select("node"), "node", "left_semi")
    return whole.unionByName(single.withColumnRenamed("bucket", "grp"))


def tiles(members: DataFrame, labels: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Rows (grp, level, block, part, asks, ...) of open groups: ``part`` of those that ask meets ``block`` of those that are held.

    Members of a group are held in the blocks of their size level, about BLOCK in each. Those outside its leading component ask in
    all blocks of the levels next to their own, in parts of about BLOCK. So a tile's rows are bounded, whatever the group's size.
    """
    total = max(members.count(), 1)
    within = open_groups(members, labels, total).join(classes.select("node", "n_shingles", "registers"), "node")
    within = stored(within.withColumn("level", size_level(F.col("n_shingles"), threshold)))
    near = F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1))
    held = within.groupBy("grp", "level").agg(F.count("*").alias("held"))
    asked = within.where("outside").select("grp", near.alias("level")).groupBy("grp", "level").agg(F.count("*").alias("asking"))
    key = F.xxhash64("grp", "level").alias("key")
    shape = stored(held.join(asked, ["grp", "level"]).select(key, (F.col("held") + F.col("asking")).alias("rows"), F.ceil(F.col("held") / BLOCK).alias("blocks"), F.ceil(F.col("asking") / BLOCK).alias("parts")))

    def all_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    columns = [*TILE, "asks", "outside", "node", "leader", "component", "n_shingles", "registers", "band"]
    holding = join_groups(within.select("*", key), shape, "key", "rows", total)
    holding = holding.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("part", all_of("parts")).withColumn("asks", F.lit(False))
    asking = join_groups(within.where("outside").withColumn("level", near).select("*", key), shape, "key", "rows", total)
    asking = asking.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), "parts")).withColumn("block", all_of("blocks")).withColumn("asks", F.lit(True))
    return holding.select(columns).unionByName(asking.select(columns))


def dealt_tiles(rows: DataFrame) -> DataFrame:
    """Each tile's rows together, those that are held first."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *TILE).sortWithinPartitions(*TILE, "asks", "node")


def open_members(members: DataFrame, labels: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Who takes part in a pair that is still open: one bucket, different components, not refuted by the estimate.

    A pair is looked at once in a family, or only in the first band that it shares, and from one side. Returns members of tiles, never pairs.
    """
    dealt = dealt_tiles(tiles(members, labels, classes, threshold))
    least = cut(threshold / 100)
    columns = [*TILE, "asks", "node", "leader", "component", "n_shingles", "band", "outside"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            registers = np.array([np.frombuffer(r, ">u2") for r in batch.column("registers").to_pylist()], np.uint16)
            yield from zip(zip(*(batch.column(c).to_pylist() for c in TILE), strict=True), *(batch.column(c).to_pylist() for c in columns[len(TILE) :]), registers, strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, group in groupby(rows(batches), key=lambda r: r[0]):
            held: list[tuple] = []
            matrix = None
            askers: list[tuple[int, int]] = []
            for _, asks, node, leader, component, size, band, outside, registers in group:
                if not asks:
                    held.append((node, component, size, outside, registers))
                    continue
                if not held:
                    break
                if matrix is None:
                    matrix = np.array([r[4] for r in held])
                    nodes, parts, sizes, both = (np.array([r[k] for r in held]) for k in range(4))
                    wanted = np.zeros(len(held), bool)
                same = matrix == registers
                equal = same.sum(1)
                first_band = same.reshape(len(held), -1, BAND).all(2).argmax(1)
                likely = (equal >= least * REGISTERS) & (parts != component) & (nodes != leader) & ((first_band == band) | (band < 0)) & (100 * np.minimum(sizes, size) >= threshold * np.maximum(sizes, size))
                likely = np.flatnonzero(likely & (~both | (nodes < node)))  # of two that ask, the larger does
                likely = likely[estimate(equal[likely], sizes[likely], np.full(len(likely), size)) >= least]
                if len(likely):
                    wanted[likely] = True
                    askers.append((node, component))
            if askers:
                found = [(*tile, False, n, c) for n, c in zip(nodes[wanted].tolist(), parts[wanted].tolist(), strict=True)] + [(*tile, True, n, c) for n, c in askers]
                kinds = [*[pa.int64()] * len(TILE), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [*TILE, "asks", "node", "component"])

    return dealt.mapInArrow(run, "grp long, level long, block long, part long, asks boolean, node long, component long")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of their incidence matrices, COLUMNS shared values at a time."""
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(values), COLUMNS):
        part = values[low : low + COLUMNS]
        sides = []
        for sets in (left, right):
            dense = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                dense[i, np.flatnonzero(np.isin(part, s, assume_unique=True))] = 1
            sides.append(dense)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def open_links(found: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """Links between different components among open members, verified on full sets; one per pair of components and block at most."""
    columns = [*TILE, "asks", "node", "component", "text"]
    dealt = dealt_tiles(found.join(texts.select("node", "text"), "node").select(columns))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for piece in slices(batch):
                hashes, bounds = shingle_sets(text_of(piece), shingle)
                sets = [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield from zip(zip(*(piece.column(c).to_pylist() for c in TILE), strict=True), *(piece.column(c).to_pylist() for c in ("asks", "node", "component")), sets, strict=True)

    def compare(askers: list[tuple], held: list[tuple]) -> Iterator[tuple[int, int]]:
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        shared = common([r[-1] for r in askers], [r[-1] for r in held])
        union = np.array([len(r[-1]) for r in askers])[:, None] + np.array([len(r[-1]) for r in held])[None, :] - shared
        for i, j in np.argwhere(100 * shared >= threshold * union).tolist():
            a, b = root(askers[i][3]), root(held[j][3])
            if a != b:
                joined[a] = b
                yield min(askers[i][2], held[j][2]), max(askers[i][2], held[j][2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            held: list[tuple] = []
            asking: list[tuple] = []
            for row in group:
                (asking if row[1] else held).append(row)
            if asking and held and (links := list(compare(asking, held))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 80, shingle: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; ``threshold``: least similarity of a link in percent."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(sketch_documents(docs, shingle))
    total = rows.count()
    classes = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    in_band = classes.select("node", F.posexplode(bands()).alias("band", "bucket"))
    groups = stored(in_band.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    members = stored(join_groups(in_band, groups, "bucket", "n", max(total, 1)))
    texts = class_texts(docs, classes, members.select("node").distinct(), total)
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(stored(pairs), texts, threshold, shingle))
    labels = stored(components(links))
    found = stored(open_members(members, labels, classes, threshold))
    if not found.isEmpty():
        more = stored(open_links(found, texts, threshold, shingle))
        if not more.isEmpty():
            labels = stored(components(links.unionByName(more)))
    return labelled(rows, classes, labels, total)


def class_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """One text of each of the classes, with its sketch. Of a class with very many copies only rows of its first doc_id are moved."""
    wanted = classes.join(nodes, "node", "left_semi")
    hot = F.broadcast(wanted.where(F.col("copies") > max(total // HOT_PARTS, 1)).select(F.col("key").alias("hot_key"), F.col("first_id").alias("hot_id"), F.lit(True).alias("hot")))
    keyed = docs.withColumn("key", text_key())
    keyed = keyed.join(hot, F.col("key") == F.col("hot_key"), "left").where(F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("hot_id"))).select("doc_id", "key", "text")
    found = keyed.join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return written(found.dropDuplicates(["key"]).select("node", "n_shingles", "registers", "text"))


def labelled(rows: DataFrame, classes: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Each row with the smallest doc_id of its component."""
    rooted = classes.select("node", "key", "first_id", "copies").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes"))
    named = stored(join_groups(rooted, least, "root", "classes", max(total, 1)).select("key", "component_id", "copies"))
    full = join_groups(rows.where("n_shingles > 0").select("doc_id", "key", "n_shingles"), named, "key", "copies", max(total, 1))
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, threshold: int = 80, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id stays, unchanged."""
    stay_id = fresh(docs, "stay_id")
    stay = near_duplicates(docs, threshold, shingle).where("kept").select(F.col("doc_id").alias(stay_id)).distinct()
    return docs.join(stay, quoted("doc_id").cast("long").eqNullSafe(F.col(stay_id)), "left_semi")
