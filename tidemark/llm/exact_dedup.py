"""Operator 4, exact duplicates: deterministic block naming.

A text is cut into blocks of ``block_bytes``. Sorting all distinct blocks gives each an integer name; equal blocks have equal
names and different blocks different ones. Then adjacent pairs of names get names in the same way, level by level, until a
document has one: with the number of levels, that is an identity without collisions. Documents leave as soon as they have one
name, so almost all of the work is the first level.

One level of naming moves contents once. Within an Arrow batch only the first row of each content (its representative)
carries it; the others carry the representative's number. Content rows are dealt by a hash of the content and sorted, and
a streaming pass names each run of equal contents; other rows are dealt evenly and pass through. Then
rows meet their representative: a group of one batch's rows at most. A content that fills the corpus thus
costs one row per batch, and no task holds a group.

Defined cases: a null text counts as empty; an empty text is one empty block; of equal texts the row with the largest doc_id
stays (null is the smallest; of rows that share that doc_id too, one); an empty table gives no rows; other columns,
of whatever name, are not read, and pass unchanged through the pipeline's form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import every, fresh, join_groups, quoted, stored
from tidemark.llm.textkit import slices, text_of

BLOCK_BYTES = 8192
# item: a row's number; representative: that of the first row of its batch with the same content; doc: the item of the
# document's first block. doc_id and text_sha256 are set on first blocks of the first level.
CARRIED = ["doc", "place", "blocks", "doc_id", "text_sha256"]
CARRIED_TYPES = "doc long, place long, blocks long, doc_id long, text_sha256 string"
ITEM = f"item long, representative long, content binary, {CARRIED_TYPES}"
ITEM_TYPES = {c: pa.string() if c == "text_sha256" else pa.int64() for c in ("item", "representative", *CARRIED)}
# Rows of an Arrow batch of contents: with BLOCK_BYTES, 8 MB.
BATCH = 1000


def represented(first_item: int, contents: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Numbers of a batch's rows, of their representatives, and the contents where a row is its own."""
    first: dict[bytes, int] = {}
    chosen = [first.setdefault(c, i) for i, c in enumerate(contents, first_item)]
    kept = [c if r == i else None for i, (c, r) in enumerate(zip(contents, chosen, strict=True), first_item)]
    return pa.array(np.arange(first_item, first_item + len(contents))), pa.array(chosen, pa.int64()), pa.array(kept, pa.binary())


def name_contents(items: DataFrame) -> DataFrame:
    """Rows (carried columns, name) of rows (item, representative, content, carried columns): one integer per distinct content."""
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartition(partitions, F.when(F.col("content").isNotNull(), F.xxhash64("content")).otherwise(F.xxhash64(F.lit(4), "item"))).sortWithinPartitions("content", "item")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            values = batch.column("content")
            valid = pc.is_valid(values).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[0] = values[0].as_py() != last
            new[1:] = pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            names = name + np.cumsum(new & valid)
            name, last = int(names[-1]), values[n - 1].as_py()
            kept = [pa.array(batch.column(c).to_pylist(), ITEM_TYPES[c]) for c in ("item", "representative", *CARRIED)]  # copies: the batch can go
            del batch, values
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.int64(), mask=~valid)], ["item", "representative", *CARRIED, "name"])
            pa.default_memory_pool().release_unused()

    named = stored(dealt.mapInArrow(run, f"item long, representative long, {CARRIED_TYPES}, name long"), BATCH)
    found = named.where("name is not null").select(F.col("item").alias("representative"), "name")
    rest = named.where("name is null").drop("name").join(found, "representative")
    return named.where("name is not null").select(*CARRIED, "name").unionByName(rest.select(*CARRIED, "name"))


def first_level(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch):
                contents: list[bytes] = []
                carried: list[tuple] = []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), text_of(piece).cast(pa.binary()).to_pylist(), strict=True):
                    doc = number + len(contents)
                    blocks = [text[i : i + block_bytes] for i in range(0, len(text), block_bytes)] or [b""]
                    contents += blocks
                    carried.append((doc, 0, len(blocks), doc_id, hashlib.sha256(text).hexdigest()))
                    carried += [(doc, i, len(blocks), None, None) for i in range(1, len(blocks))]
                columns = [pa.array(c, k) for c, k in zip(zip(*carried, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*represented(number, contents), *columns], ["item", "representative", "content", *CARRIED])
                number += len(contents)
            del batch
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ITEM)


def next_level(pairs: DataFrame) -> DataFrame:
    """Pairs (doc, place, blocks, first, second) as contents; a missing second name is -1, which no name is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            sides = np.column_stack([batch.column(c).to_numpy() for c in ("first", "second")]).astype(">i8")
            columns = [*(batch.column(c) for c in CARRIED[:3]), pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays([*represented(number, [row.tobytes() for row in sides]), *columns], ["item", "representative", "content", *CARRIED])
            number += batch.num_rows

    return pairs.mapInArrow(run, ITEM)


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc, doc_id, text_sha256, level and name of each row; rows with equal texts, and only they, agree in level and name."""
    level = stored(name_contents(first_level(docs, block_bytes)))
    out = level.where("blocks = 1").select("doc", "doc_id", "text_sha256", F.lit(0).alias("level"), "name")
    heads = level.where("blocks > 1 and place = 0").select("doc", "doc_id", "text_sha256")
    current, depth = level.where("blocks > 1"), 0
    while not current.isEmpty():
        depth += 1
        even = F.col("place") % 2 == 0
        pairs = current.groupBy("doc", F.floor(F.col("place") / 2).alias("place"), F.ceil(F.col("blocks") / 2).alias("blocks")).agg(
            F.max(F.when(even, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("second")
        )
        current = stored(name_contents(next_level(pairs)))
        out = out.unionByName(current.where("blocks = 1").select("doc", F.lit(depth).alias("level"), "name").join(heads, "doc"))
        current = current.where("blocks > 1")
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    rows = stored(name_documents(docs, block_bytes).withColumn("identity", F.col("name") * 64 + F.col("level")).drop("name", "level"))
    total = rows.count()
    groups = rows.groupBy("identity").agg(F.max(F.struct("doc_id", "doc")).alias("keep"), F.count("*").alias("group_size"))
    out = join_groups(rows, groups, "identity", "group_size", total)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("doc") == F.col("keep.doc")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged; of rows with the same doc_id and text, the one whose columns come first in order."""
    identity = F.concat_ws("|", F.coalesce(quoted("doc_id").cast("string"), F.lit("-")), F.sha2(F.coalesce(quoted("text"), F.lit("")), 256))
    key, row = fresh(docs, "exact_key"), fresh(docs, "exact_row")
    stay = exact_duplicates(docs, block_bytes).where("kept").select(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_sha256").alias(key))
    first = F.min_by(row, F.to_json(row)) if "map<" in docs.schema.simpleString() else F.min(row)  # maps have no order
    rows = docs.select(identity.alias(key), F.struct(*every(docs)).alias(row)).groupBy(key).agg(first.alias(row))
    return rows.join(stay, key, "left_semi").select(f"{row}.*")
