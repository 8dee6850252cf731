"""Operator 10, token counts: pre-token segment trees and edit-aware recounting.

A document's pre-tokens are its blank-separated chunks, which the tokenizer never merges. Leaves of its segment tree
hold the id counts of ``LEAF`` pre-tokens; inner nodes hold sums. An edit re-encodes only the pre-tokens it touches
and those that border on it (their text may join), and updates the sums on the paths to the root.

Defined cases: a null text has no pre-tokens and count 0; a null doc_id stays null; repeated rows are counted each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import map_slices, text_of
from tidemark.llm.wordbpe import load

LEAF = 16
CHUNK = re.compile(r"[^ \t\n\v\f\r]+")
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long, tree binary"
# Fixed: what the default edits blank out.
PERSONAL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\(?\d[\d ()./-]{7,}\d")
# Every match of PERSONAL holds one of these.
HINT = re.compile(r"[@\d]")
Edit = tuple[int, int, str]


class TokenTree:
    """Sums over blocks of pre-tokens in heap order: node 1 is the root, node k has children 2k and 2k + 1."""

    def __init__(self, counts: np.ndarray):
        self.counts = np.asarray(counts, np.int64)
        blocks = max(1, -(-len(self.counts) // LEAF))
        self.base = 1 << (blocks - 1).bit_length()
        self.nodes = np.zeros(2 * self.base, np.int64)
        if len(self.counts):
            self.nodes[self.base : self.base + blocks] = np.add.reduceat(self.counts, np.arange(0, len(self.counts), LEAF))
        for level in range(self.base.bit_length() - 2, -1, -1):
            low = 1 << level
            self.nodes[low : 2 * low] = self.nodes[2 * low : 4 * low : 2] + self.nodes[2 * low + 1 : 4 * low : 2]

    @property
    def total(self) -> int:
        return int(self.nodes[1])

    def add(self, pretoken: int, delta: int) -> None:
        node = self.base + min(pretoken // LEAF, self.base - 1)
        while node:
            self.nodes[node] += delta
            node >>= 1


def personal_data(text: str) -> list[Edit]:
    """Edits that put a mark in place of mail addresses and telephone numbers."""
    return [(m.start(), m.end(), "[removed]") for m in PERSONAL.finditer(text)] if HINT.search(text) else []


def apply_edits(text: str, tree: TokenTree, edits: Iterable[Edit], count: Callable[[str], int]) -> tuple[int, int]:
    """Bring the tree up to date with edits (start, end, new text) of ``text`` that don't overlap.

    Returns the number of edits and of pre-tokens that were encoded anew.
    """
    edits = sorted(edits)
    spans = [m.span() for m in CHUNK.finditer(text)]
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    regions: list[list] = []
    for edit in edits:
        low = bisect_left(ends, edit[0])  # first pre-token that ends at the edit's start or later
        high = bisect_right(starts, edit[1])  # after the last that starts at its end or before
        joins = regions and (low < regions[-1][1] or not CHUNK.sub("", text[regions[-1][2][-1][1] : edit[0]]))
        if joins:
            regions[-1][1] = max(high, regions[-1][1])
            regions[-1][2].append(edit)
        else:
            regions.append([low, high, [edit]])
    done = 0
    for low, high, inside in regions:
        at = min(inside[0][0], starts[low]) if high > low else inside[0][0]
        stop = max(inside[-1][1], ends[high - 1]) if high > low else inside[-1][1]
        parts = []
        for start, end, new in inside:
            parts += [text[at:start], new]
            at = end
        parts.append(text[at:stop])
        for k in range(low, high):
            tree.add(k, -int(tree.counts[k]))
        tree.add(low, count("".join(parts)))
        done += max(1, high - low)
    return len(edits), done


def edited(text: str, edits: Iterable[Edit]) -> str:
    """The text after the edits."""
    parts, at = [], 0
    for start, end, new in sorted(edits):
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def token_counts(docs: DataFrame, tokenizer: str | None = None, edits: Callable[[str], list[Edit]] = personal_data) -> DataFrame:
    """Counts before and after the edits, with each document's tree (node sums, little-endian 64-bit). ``edits`` gives a text's edits."""

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        encoder = load(tokenizer)
        texts = text_of(piece)
        offsets, codes, sizes, _, _ = encoder.batch(texts)
        counts = sizes[codes]
        totals = np.diff(np.concatenate([[0], np.cumsum(counts)])[offsets])
        after, made, anew = totals.copy(), np.zeros(len(totals), np.int64), np.zeros(len(totals), np.int64)
        trees = [TokenTree(counts[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for i, text in enumerate(texts.to_pylist()):
            if changes := edits(text):
                made[i], anew[i] = apply_edits(text, trees[i], changes, lambda s: len(encoder.encode(s)))
                after[i] = trees[i].total
        columns = [piece.column("doc_id"), *map(pa.array, (np.diff(offsets), totals, made, anew, after)), pa.array([t.nodes.astype("<i8").tobytes() for t in trees], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after", "tree"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), count, SCHEMA)
