"""Operator 6, toxicity: non-negative positive-unlabelled learning of a linear classifier.

The classifier reads how often a whole text holds words and beginnings of words (lower case, hashed). It is trained on the
driver from a bounded sample of confirmed toxic documents and a bounded sample of unlabelled text: the risk is

    prior * risk_p(+) + max(0, risk_u(-) - prior * risk_p(-))

with ``prior`` the share of toxic documents. When the second term falls below zero, the step goes against it, as
the estimator asks. A logistic curve then maps the margin to a probability on labelled rows of the same fold.

Defined cases: a null text reads as empty and has the score of a text without words; repeated rows are scored each;
a null doc_id stays null and is held out of training; no confirmed toxic row: every score is 0; an empty table gives
no rows; labels, lang, source and doc_id never reach a score; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.joins import written
from tidemark.llm.textkit import NOT_ALNUM, Words, lower_ascii, map_slices, raw_bytes, text_of

# Most rows of each kind that reach the driver: confirmed toxic, unlabelled, and labelled for the curve.
SAMPLE = 4096
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)  # bytes
MIN_Z = 5.0
THRESHOLD = 0.3


def buckets(piece: pa.RecordBatch, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and logarithm of the count of each text's words and word beginnings; ``use`` marks the buckets wanted."""
    data, bounds = raw_bytes(text_of(piece))
    words = Words(lower_ascii(data), bounds, NOT_ALNUM)
    doc, lengths = words.doc_of(), words.ends - words.starts
    keys = []
    for hashes, fits in [(words.hash, slice(None)), *((h, lengths > k) for k, h in enumerate(words.prefixes(BEGINNINGS[-1]), 1) if k in BEGINNINGS)]:
        bucket = (hashes[fits] % np.uint64(BUCKETS)).astype(np.int64)
        if use is None:
            keys.append(doc[fits] * BUCKETS + bucket)
        else:
            wanted = use[bucket]
            keys.append(doc[fits][wanted] * BUCKETS + bucket[wanted])
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, np.log1p(counts)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.use = self.weights != 0

    def margin(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[features] * values, n) + self.bias

    def score(self, piece: pa.RecordBatch) -> np.ndarray:
        margin = self.margin(*buckets(piece, self.use), piece.num_rows)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


Vector = tuple[np.ndarray, np.ndarray]  # buckets and values of one text


def stack(docs: list[Vector]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(docs)), [len(f) for f, _ in docs])
    return rows, np.concatenate([f for f, _ in docs]), np.concatenate([v for _, v in docs])


def fit_nnpu(positive: list[Vector], unlabelled: list[Vector], prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> Classifier:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    n_p, n = len(positive), len(positive) + len(unlabelled)
    rows, flat, values = stack([*positive, *unlabelled])
    chosen, columns = np.unique(flat, return_inverse=True)
    w, bias = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[columns] * values, n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_minus = np.logaddexp(0, z)
        negative = loss_minus[n_p:].mean() - prior * loss_minus[:n_p].mean()
        push = np.zeros(n)
        if negative >= 0:  # the whole risk
            push[:n_p] = prior * ((p[:n_p] - 1) - p[:n_p]) / n_p
            push[n_p:] = p[n_p:] / (n - n_p)
        else:  # back out of the overfitted negative part
            push[:n_p] = prior * p[:n_p] / n_p
            push[n_p:] = -p[n_p:] / (n - n_p)
        gradient = np.append(np.bincount(columns, push[rows] * values, len(w)) + l2 * w, push.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    weights = np.zeros(BUCKETS)
    weights[chosen] = w
    return Classifier(weights, bias)


def fit_curve(model: Classifier, docs: list[Vector], y: np.ndarray, steps: int = 50) -> None:
    """Newton steps of a logistic curve from margins to labels, with a little shrinkage."""
    z = model.margin(*stack(docs), len(docs))
    center, spread = float(z.mean()), float(z.std()) or 1.0
    x = np.column_stack([(z - center) / spread, np.ones(len(z))])
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-2])
        theta -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * (theta - [1.0, 0.0]))
    if theta[0] > 0:
        model.slope, model.shift = theta[0] / spread, theta[1] - theta[0] * center / spread


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sample(rows: DataFrame, total: int, bound: int) -> DataFrame:
    """At most ``bound`` rows: those with the smallest hash of doc_id."""
    key = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 32))
    if total > bound:
        rows = rows.where(key < F.lit(int(1.2 * bound / total * (1 << 32))))
    return rows.orderBy(key, "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """The classifier, from rows that aren't held out; None without a confirmed toxic row."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    if not seen.p:
        return None
    prior = float(np.clip(seen.p / seen.n, 0.001, 0.5))
    toxic = _sample(labels.where("toxic = 1"), seen.p, sample).select("doc_id", F.lit("p").alias("kind"))
    curve = _sample(labels, seen.n, sample).select("doc_id", F.when(F.col("toxic") == 1, "1").otherwise("0").alias("kind"))
    free = _plain(docs).where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id")
    free = _sample(free, free.count(), sample).select("doc_id", F.lit("u").alias("kind"))
    kinds = toxic.unionByName(curve).unionByName(free).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "").alias("kind"))  # 3 * sample rows at most

    sample_docs = written(_plain(docs).join(F.broadcast(kinds), "doc_id").dropDuplicates())
    wanted = frequent_in_toxic(sample_docs)
    if not len(wanted):
        return None
    use = np.zeros(BUCKETS, bool)
    use[wanted] = True

    def features(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows, found, values = buckets(piece, use)
        bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
        raw = [found[a:b].astype("<i4").tobytes() + values[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("kind"), pa.array(raw, pa.binary())], ["doc_id", "kind", "raw"])

    table = map_slices(sample_docs, features, "doc_id long, kind string, raw binary").toArrow()
    table = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True))  # the order of arrival must not matter
    vectors = [(np.frombuffer(raw[: len(raw) // 2], "<i4").astype(np.int64), np.frombuffer(raw[len(raw) // 2 :], "<f4").astype(float)) for *_, raw in table]
    of = lambda kind: [v for (_, k, _), v in zip(table, vectors, strict=True) if kind in k]
    if not of("p") or not of("u"):
        return None
    model = fit_nnpu(of("p"), of("u"), prior)
    marked = of("0") + of("1")
    if marked:
        fit_curve(model, marked, np.array([0.0] * len(of("0")) + [1.0] * len(of("1"))))
    return model


def frequent_in_toxic(sample_docs: DataFrame, min_z: float = MIN_Z) -> np.ndarray:
    """Buckets that more of the confirmed toxic than of the unlabelled texts have, by ``min_z`` standard errors and in three texts at least. Counted on the executors."""

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows, found, _ = buckets(piece)
        kinds = piece.column("kind").to_pylist()
        toxic, free = (np.array([mark in k for k in kinds])[rows] for mark in "pu")
        names, at = np.unique(found, return_inverse=True)
        columns = [names, *(np.bincount(at, of, len(names)).astype(np.int64) for of in (toxic, free))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "p", "u"])

    sizes = sample_docs.agg(F.count_if(F.contains("kind", F.lit("p"))).alias("p"), F.count_if(F.contains("kind", F.lit("u"))).alias("u")).first()
    if not sizes.p or not sizes.u:
        return np.zeros(0, np.int64)
    counts = map_slices(sample_docs, count, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u")) / F.lit(sizes.p + sizes.u)
    error = F.sqrt(share * (1 - share) * F.lit(1 / sizes.p + 1 / sizes.u)) + 1e-12
    found = counts.where("p >= 3").where((F.col("p") / F.lit(sizes.p) - F.col("u") / F.lit(sizes.u)) / error >= min_z)
    return np.array(sorted(r.bucket for r in found.select("bucket").collect()), np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """held_out, score and prediction of each document."""
    model = train(docs, labels)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(piece) if model else np.zeros(piece.num_rows)
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_slices(_plain(docs).withColumn("held_out", held_out()), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, unchanged; the classifier is trained on ``documents``."""
    model = train(documents, labels)
    if model is None:
        return docs

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        keep = model.score(piece) < threshold
        return piece.filter(pa.array(keep))

    return map_slices(docs, run, docs.schema)
