"""Operator 2, quality rules: gradient-boosted trees over document statistics, held to monotone directions.

Statistics of whole texts are computed slice by slice in numpy. The trees are fitted on the driver on a bounded sample of
labelled rows (``SAMPLE`` at most, those with the smallest hash of doc_id), flattened into node arrays and applied to
whole slices at once.

Defined cases: a null text has no words and fails the base rule; repeated rows are judged each; a null doc_id stays null;
no labelled rows: the verdict is the base rule alone; an empty table gives no rows; other columns are not read. Of
repeated labels of one document, the largest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import BLANKS, Words, grams, map_slices, mix, raw_bytes, text_of

SAMPLE = 8192
# Features in order; +1 / -1: the score may only rise / fall with it; 0: free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "upper_share": -1,
    "digit_share": 0, "distinct_share": 0, "letter_share": 0, "punctuation": 0, "lines_per_word": 0, "longest_repeat": -1,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, features array<double>"


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(characters.encode())] = 1
    return table


SYMBOLS = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGITS = _table("0123456789")
STOPS = _table(".,;:!?")
LETTERS = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per document, and which entries share theirs with another entry of the document."""
    keys = mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[order]) != 0
    last = np.append(new[1:], True) if len(new) else new
    shared = np.zeros(len(keys), bool)
    shared[order] = ~(new & last)
    return np.bincount(doc[order[new]], minlength=n), shared


def statistics(piece: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """The five counts and the feature matrix of a slice."""
    data, bounds = raw_bytes(text_of(piece))
    n = piece.num_rows
    words = Words(data, bounds, BLANKS)
    doc = words.doc_of()
    starting = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starting)])
    per_word = chars[words.ends] - chars[words.starts]
    word_chars = _per_doc(per_word, words.offsets)
    symbols = _per_doc(SYMBOLS[data], bounds)
    lines = Words(data, bounds, b"\n")
    word_count_before = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts)
    full = word_count_before > 0
    line_doc = lines.doc_of()[full]
    distinct_lines, _ = _distinct(line_doc, lines.hash[full], n)
    n_lines = np.bincount(line_doc, minlength=n)
    five = grams(words.hash, 5)
    inside = doc[: len(five)] == doc[4:] if len(five) else np.zeros(0, bool)
    starts = np.flatnonzero(inside)
    _, shared = _distinct(doc[starts], five[starts], n)
    marks = np.zeros(len(doc) + 6, np.int64)
    hit = starts[shared]
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + 5, -1)
    repeated = np.cumsum(marks)[: len(doc)] > 0
    n_repeat = _per_doc(repeated, words.offsets)
    distinct_words, _ = _distinct(doc, words.hash, n)
    n_words = words.counts
    some, letters = np.maximum(n_words, 1), np.maximum(_per_doc(LETTERS[data], bounds), 1)
    all_chars = np.maximum(word_chars, 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    longest = np.zeros(n, np.int64)
    if len(edge):
        np.maximum.at(longest, doc[edge[::2]], edge[1::2] - edge[::2])
    features = np.column_stack([
        np.log1p(n_words), word_chars / some, symbols / some, (n_lines - distinct_lines) / np.maximum(n_lines, 1), n_repeat / some,
        _per_doc(UPPER[data], bounds) / letters, _per_doc(DIGITS[data], bounds) / all_chars, distinct_words / some, letters / all_chars,
        _per_doc(STOPS[data], bounds) / some, n_lines / some, longest / some,
    ])
    return [n_words, word_chars, symbols, n_lines - distinct_lines, n_repeat], features


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def document_statistics(docs: DataFrame) -> DataFrame:
    """Counts, base rule and features of each document."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = statistics(piece)
        columns = [piece.column("doc_id"), *map(pa.array, counts), pa.array(base_failed(counts[0], counts[4]))]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES)), pa.array(features.ravel()))
        return pa.RecordBatch.from_arrays([*columns, rows], ["doc_id", *COUNTS, "base_failed", "features"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


@dataclass
class Trees:
    """All trees in one set of node arrays; leaves point at themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality, for each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms.

    A constrained split must order its children's values; children then inherit the middle as a bound, so that no deeper
    split can break the order.
    """
    monotone = monotone or list(FEATURES.values())
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        for column, entry in zip((feature, threshold, left, right, value), (0, 0.0, k, k, v), strict=True):
            column.append(entry)
        return k

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        node = leaf(rate * float(np.clip(-g.sum() / (h.sum() + l2), low, high)))
        if level == depth or len(rows) < 20:
            return node
        best = (1e-6, None)
        for f, sign in enumerate(monotone):
            if not len(edges[f]):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g, len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h, len(edges[f]) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
            gain[(nl < 5) | (len(rows) - nl < 5) | (sign * (vr - vl) < 0)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return node
        f, k, vl, vr = best[1]
        middle = (vl + vr) / 2
        goes_left = binned[rows, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
        feature[node], threshold[node] = f, float(edges[f][k])
        left[node] = grow(rows[goes_left], level + 1, *bounds[0])
        right[node] = grow(rows[~goes_left], level + 1, *bounds[1])
        return node

    model = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
        model = Trees(*(np.array(c) for c in (roots, feature, threshold, left, right, value)), bias, depth)
        one = Trees(np.array(roots[-1:]), model.feature, model.threshold, model.left, model.right, model.value, 0.0, depth)
        p = one.score(x)
        margin += np.log(p / (1 - p))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on at most ``sample`` labelled documents; None without labels."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    total = chosen.count()
    if not total:
        return None
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    if total > sample:
        chosen = chosen.where(key < F.lit(int(1.2 * sample / total * (1 << 32))))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(key, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    least = document_statistics(texts).groupBy("doc_id").agg(F.min("features").alias("features"))  # of a doc_id's texts, one that any run chooses
    rows = least.join(F.broadcast(chosen), "doc_id").select("features", "quality").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("features").to_pylist(), float)
    y = rows.column("quality").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the order of arrival must not matter
    return fit(x[order], y[order])


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, base rule, score and verdict of each document: kept when the base rule passes and the trees give ``threshold`` or more."""
    model = train(docs, labels)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = statistics(piece)
        failed = base_failed(counts[0], counts[4])
        score = model.score(features) if model else np.where(failed, 0.0, 1.0)
        columns = [piece.column("doc_id"), *map(pa.array, (*counts, failed, ~failed & (score >= threshold), score))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
