"""Operator 9, packing: order-preserving dynamic programming over sentence and document ends.

A partition's documents, in their order, form one stream of ids. A sequence is a window of the stream of at most
``size`` ids. With candidate cuts c_j (document ends, sentence ends, and inner points of sentences longer than a
window), the least cost up to c_j is

    cost[j] = penalty[j] + size - c_j + min(cost[i] + c_i  over i < j with c_j - c_i <= size)

and the minimum runs over a sliding range, so a monotone queue makes it linear. No shuffle: each scan partition packs
its own rows in blocks of bounded size.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed each by itself; a null doc_id
stays null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import slices, text_of
from tidemark.llm.wordbpe import gather, load

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
BLOCK_BYTES = 6 << 20
END_ID = 2


def cuts(ends: np.ndarray, penalties: np.ndarray, size: int) -> np.ndarray:
    """Best window ends. ``ends``: candidate cuts, rising, the last one the stream's end; gaps are at most ``size``."""
    points, price = [0, *ends.tolist()], [0, *penalties.tolist()]
    keys, back = [0] * len(points), [0] * len(points)
    queue: deque[int] = deque([0])
    for j in range(1, len(points)):
        at = points[j]
        while at - points[queue[0]] > size:
            queue.popleft()
        best = queue[0]
        back[j] = best
        key = keys[j] = price[j] + size + keys[best]  # cost[j] + c_j
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], len(points) - 1
    while j:
        out.append(points[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int, sentence_penalty: int, inner_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts allowed and what each costs beyond its padding."""
    ends = np.union1d(doc_ends, sentence_ends)
    penalties = np.where(np.isin(ends, doc_ends, assume_unique=True), 0, sentence_penalty)
    gaps = np.diff(ends, prepend=0)
    long = np.flatnonzero(gaps > size)
    if len(long):
        inner = np.concatenate([np.arange(ends[i] - gaps[i], ends[i], max(1, size // 16))[1:] for i in long])
        ends = np.concatenate([ends, inner])
        penalties = np.concatenate([penalties, np.full(len(inner), inner_penalty)])
        order = np.argsort(ends, kind="stable")
        ends, penalties = ends[order], penalties[order]
    return ends, penalties


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end_id: int = END_ID, sentence_penalty: int = 8, inner_penalty: int = 64) -> DataFrame:
    """Pieces of documents with their place in a sequence; ``ids`` holds little-endian unsigned 32-bit ids.

    ``sequence_id`` is unique over the result: the partition's number and a count in it.
    """

    def block(piece: pa.RecordBatch, first_sequence: int) -> tuple[pa.RecordBatch, int]:
        offsets, codes, sizes, words, joined = load(tokenizer).batch(text_of(piece))
        n = piece.num_rows
        ends_at = np.cumsum(sizes[codes])  # ids before the end of each chunk
        before = np.concatenate([[0], ends_at])[offsets]  # ids before each text, without end ids
        doc_ends = before[1:] + np.arange(1, n + 1)
        ids = np.empty(int(doc_ends[-1]), np.uint32)
        body = np.ones(len(ids), bool)
        body[doc_ends - 1] = False
        ids[body], ids[~body] = gather(codes, sizes, joined), end_id
        closing = pc.match_substring_regex(words, r"[.!?][\"')\]]*$").to_numpy(zero_copy_only=False).astype(bool)
        doc_of = np.repeat(np.arange(n), np.diff(offsets))
        where = closing[codes] if len(codes) else np.zeros(0, bool)
        sentence_ends = (ends_at + doc_of)[where]
        window_ends = cuts(*candidates(doc_ends, sentence_ends[sentence_ends > 0], size, sentence_penalty, inner_penalty), size)
        starts = np.union1d(np.concatenate([[0], doc_ends[:-1]]), np.concatenate([[0], window_ends[:-1]]))
        stops = np.append(starts[1:], doc_ends[-1])
        doc = np.searchsorted(doc_ends, starts, "right")
        window = np.searchsorted(window_ends, starts, "right")
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        raw = pa.py_buffer(ids.astype("<u4").tobytes())
        bounds = pa.py_buffer(np.append(starts, stops[-1]).astype(np.int64) * 4)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, raw]).cast(pa.binary())
        columns = [
            piece.column("doc_id").take(pa.array(doc)), pa.array(starts - doc_starts[doc]), pa.array(stops - starts), pieces,
            pa.array((doc_ends - doc_starts)[doc]), pa.array(window + first_sequence), pa.array(starts - np.concatenate([[0], window_ends[:-1]])[window]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), len(window_ends)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, limit=BLOCK_BYTES):
                out, used = block(piece, sequence)
                sequence += used
                yield out
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def pack_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``pack`` with a checksum in place of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
