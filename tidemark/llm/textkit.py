"""Arrow and numpy helpers shared by the text operators.

Every helper works on one bounded slice of an Arrow batch (``SLICE_BYTES`` of text, or one longer
document) and on whole texts. Null texts read as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 3 << 19

# Separators: blank and tab to carriage return; or every ASCII character but letters and digits.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())

_MIX = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
np.seterr(over="ignore")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes + 64) - 1) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as strings without nulls."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to each slice of ``df``. What Arrow has freed goes back to the system after each batch, as workers live on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column, limit):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and each text's bounds in them."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a run of texts: byte bounds, a 64-bit hash each, and each text's range of words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: bytes, hashes: bool = True):
        self.data = data
        table = np.ones(256, bool)
        table[list(separators)] = False
        inside = table[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        firsts = bounds[:-1][bounds[:-1] < len(data)]
        before[firsts] = False
        after[firsts[firsts > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.offsets = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.offsets)
        if hashes:
            self.hash = self._hash(data[inside])

    def _hash(self, letters: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        powers = np.ones(int(lengths.max()) + 1, np.uint64)
        powers[1:] = _ODD
        powers = np.multiply.accumulate(powers)
        return mix(np.add.reduceat(_MIX[letters] * powers[place], first))

    def prefixes(self, longest: int) -> list[np.ndarray]:
        """Hashes of each word's first 1, 2, ... ``longest`` bytes (all of a shorter word)."""
        lengths, power = self.ends - self.starts, np.uint64(1)
        total, out = np.zeros(len(lengths), np.uint64), []
        for k in range(longest):
            inside = np.minimum(self.starts + k, max(len(self.data) - 1, 0))
            total = total + np.where(lengths > k, _MIX[self.data[inside]] * power, np.uint64(0))
            power = power * _ODD
            out.append(mix(total + np.uint64(k + 1)))
        return out

    def doc_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; one for each start, across text bounds too."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * _ODD + hashes[k : len(hashes) - n + 1 + k]
    return mix(total)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each length, joined."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
