"""Exact, near and substring duplicates, mixing, WARC, components, group joins and the pipeline: against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components as components_module
from tidemark.llm import exact_dedup, joins, mixing, near_dedup, substring_dedup, warc
from tidemark.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Groups and components


def test_group_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_PARTS", 8)
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    assert collected(joins.join_groups(rows, groups, "k", "n", 300), "i", "low") == collected(rows.join(groups, "k"), "i", "low")


@pytest.mark.parametrize(("seed", "part"), [(0, 1 << 18), (1, 7), (2, 40)])
def test_components(spark, seed, part, monkeypatch):
    monkeypatch.setattr(components_module, "PART", part)
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = {n: n for pair in links for n in pair}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {n: root(n) for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Exact duplicates


@pytest.mark.parametrize("block", [16, 8192])
def test_exact_duplicates(docs, rows, empty, block):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = exact_dedup.exact_duplicates(docs, block)
    largest = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = sorted(((d, largest[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=repr)
    assert collected(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = out.where("kept").collect()
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    if block == 8192:
        stay = exact_dedup.drop_exact_copies(docs)
        assert {tuple(r) for r in stay.collect()} <= {tuple(r) for r in docs.collect()}
        assert stay.columns == docs.columns and Counter(r.text or "" for r in stay.collect()) == Counter(groups) .__class__(dict.fromkeys(groups, 1))
        assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_repeated_rows_with_other_columns(spark):
    """Of rows with one doc_id and text, the one whose columns come first stays."""
    rows = [(1, "same", 9), (1, "same", 4), (None, None, 7), (None, "", 2), (0, "same", 1)]
    out = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, other long"))
    assert collected(out, "doc_id", "text", "other") == sorted([(1, "same", 4), (None, None, 7)], key=repr)
    maps = spark.createDataFrame(rows, "doc_id long, text string, other long").withColumn("m", F.create_map(F.lit("k"), F.col("other")))
    assert {r.other for r in exact_dedup.drop_exact_copies(maps).collect()} == {4, 7}


def test_blocks_in_another_order_are_other_texts(spark):
    a, b = "x" * 16, "y" * 16
    texts = [a + b, b + a, a + b, a, a + a, a + a + b, a + a + a, a + "x", a + a + b]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16)
    assert {r.doc_id: r.keep_id for r in out.collect()} == {i: max(j for j, u in enumerate(texts) if u == t) for i, t in enumerate(texts)}


# Near duplicates


def shingles(text, n):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def components_of(rows, n, threshold=80):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(docs, rows, empty):
    out = near_dedup.near_duplicates(docs, shingle=4)
    assert collected(out, "doc_id", "n_shingles", "component_id") == sorted(components_of(rows, 4), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("families", [True, False])
def test_chains_and_spread_families(spark, monkeypatch, families):
    """Families whose members mostly aren't near each other: links must be found beyond a bucket's leader."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    if not families:  # bucket by bucket
        monkeypatch.setattr(near_dedup, "FAMILY", -1)
    rng = random.Random(9)
    rows, doc = [], 0
    for _ in range(3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(50):
            copy = list(words)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((doc, " ".join(copy)))
            doc += 1
    words = [f"c{i}" for i in range(120)]
    for _ in range(25):
        rows.append((doc, " ".join(words)))
        words[rng.randrange(len(words))] = f"d{doc}"
        doc += 1
    rng.shuffle(rows)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert collected(out, "doc_id", "n_shingles", "component_id") == sorted(components_of(rows, 4), key=repr)


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    for size, share in ((6, 0.5), (60, 0.8), (900, 0.8), (5000, 0.3), (3000, 0.0)):
        errors = []
        for _ in range(30):
            both = rng.integers(1, 2**63, size, dtype=np.uint64)
            k = int(size * share)
            left = np.unique(np.concatenate([both[:k], rng.integers(1, 2**63, size - k, dtype=np.uint64)]))
            right = np.unique(both)
            sketch = near_dedup.sketches(np.concatenate([left, right]), np.array([0, len(left), len(left) + len(right)]))
            true = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
            errors.append(float(near_dedup.estimate(np.array((sketch[0] == sketch[1]).sum()), len(left), len(right))) - true)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 5 * 0.045
    values = np.array([1, 2, 3, 2**56, 2**57 - 1, 2**53 + 1], np.uint64)
    for v, r in zip(values.tolist(), near_dedup.compress(values).tolist(), strict=True):
        bits = format(v, "057b")
        zeros = len(bits) - len(bits.lstrip("0"))
        assert r >> 10 == zeros + 1 and r & 1023 == int((bits[zeros + 1 :] + "0" * 10)[:10], 2)


# Substring duplicates


def removed(rows, window=13):
    infinite = math.inf
    docs = [(infinite if d is None else d, WORDS.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, infinite))
    out = []
    for (d, w), (doc_id, _) in zip(docs, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [4096, 2])
def test_substring_duplicates(docs, rows, empty, monkeypatch, split):
    monkeypatch.setattr(substring_dedup, "SPLIT_ROWS", split)
    out = substring_dedup.remove_repeats(docs)
    assert collected(out, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(rows)
    if split == 4096:
        assert substring_dedup.remove_repeats(empty).count() == 0


def test_overlapping_passages(spark):
    rng = random.Random(3)
    pool = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randint(13, 60))] for _ in range(12)]
    rows = []
    for d in range(160):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            words += part[a : a + rng.randint(5, 60)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 8))]
        rows.append((d // 2 if d % 10 == 0 else d, " ".join(words)))
    rows.append((900, "same " * 400))
    rows.append((901, "same " * 30 + "other " + "same " * 13))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collected(out, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(rows)


def test_substring_duplicates_write_one_table(spark, docs):
    folder = Path(urlparse(joins.shared_folder(spark)).path)
    before = set(folder.iterdir())
    assert substring_dedup.remove_repeats(docs).count() == docs.count()
    (new,) = set(folder.iterdir()) - before  # each file that an executor writes may start a process
    assert new.name.startswith("rows-")


def test_substring_duplicates_leave_no_shuffle_files(spark, docs):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for d in manager.localDirs() for f in Path(d.toString()).rglob("shuffle_*.data")}
    docs.count()
    before = shuffles()
    out = substring_dedup.remove_repeats(docs)  # its first table is written, nothing else has run
    deadline = time.time() + 10
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert out.count() == docs.count()


def test_other_slices_are_an_error():
    table = pa.table({"slice": [1], "rows": [substring_dedup.packed(pa.table({"doc_id": [1], "text": ["a b"]}))]})
    answers = pa.table({c: pa.array([], pa.int64()) for c in ("slice", "key", "least", "splits")})
    with pytest.raises(ValueError, match="other slices"):
        substring_dedup.first_pass(table, answers)


# Mixing


def quantile(u, mean):
    """The least k whose Poisson distribution function is above u."""
    k, term = 0, -mean
    total = math.exp(term)
    while total <= u and mean:
        k += 1
        term += math.log(mean) - math.log(k)
        total += math.exp(term)
    return k


def test_poisson_inversion(spark):
    for mean in (0.0, 0.3, 2.5, 40.0, 64.0):
        us = [i / 997 + 0.0003 for i in range(0, 996, 7)]
        df = spark.createDataFrame([(u,) for u in us], "u double").withColumn("steps", mixing.poisson_steps(F.lit(mean)))
        got = {r.u: r.k for r in df.select("u", mixing.inverse_poisson(F.col("u"), F.col("steps")).alias("k")).collect()}
        assert got == {u: quantile(u, mean) for u in us}


@pytest.mark.parametrize(("mean", "n"), [(64.5, 200), (900.0, 200), (1e6, 12)])
def test_counts_of_large_means(spark, mean, n):
    """Each count is the sum of the inverses of its parts, exactly; its mean and variance are those of the whole."""
    row = F.lit(mean)
    df = spark.range(n).withColumn("parts", mixing.parts_of(row)).withColumn("steps", mixing.poisson_steps(row / F.col("parts")))
    us = F.transform(F.sequence(F.lit(1).cast("long"), F.col("parts")), lambda i: mixing.uniform(F.lit(3), F.col("id"), i))
    found = df.select("parts", F.size("steps").alias("size"), us.alias("us"), mixing.copies(F.col("parts"), F.col("steps"), F.lit(3), F.col("id")).alias("k")).collect()
    for r in found:
        assert mean / 64 <= r.parts < mean / 32 and r.size < 250
        table = [0.0]
        for j in range(r.size):  # the distribution function of a part, from the definition
            table.append(table[-1] + math.exp(-mean / r.parts + j * math.log(mean / r.parts) - math.lgamma(j + 1)))
        near = [u for u in r.us if min(abs(u - t) for t in table) < 1e-11] if len(r.us) < 100 else []
        assert not near and r.k == sum(int(np.searchsorted(table[1:], u, "right")) for u in r.us)
    counts = [r.k for r in found]
    assert abs(np.mean(counts) - mean) < 5 * (mean / n) ** 0.5
    if n > 100:
        assert 0.6 < np.var(counts) / mean < 1.5


def test_mixing_reaches_its_weights(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, f"src{0 if rng.random() < 0.4 else rng.randrange(1, 6)}", f"t{i}") for i in range(20_000)]
    table = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, source string, text string")
    out = mixing.mix_sources(table, {"src0": 0.2, "src1": 0.4}, epochs=1.5, partitions=6)
    found = out.collect()
    share = Counter(r.source for r in found)
    other = sum(1 for _, s, _ in rows if s not in ("src0", "src1")) / 20_001
    whole = 0.6 + other
    assert abs(share["src0"] / len(found) - 0.2 / whole) < 0.01 and abs(share["src1"] / len(found) - 0.4 / whole) < 0.015 and abs(len(found) - 30_000) < 600
    per_doc = Counter(r.doc_id for r in found)
    assert all(per_doc[r.doc_id] == r.mix_copies and 0 <= r.mix_copy < r.mix_copies for r in found)
    assert [r.mix_key for r in found] == sorted(r.mix_key for r in found)  # partitions follow the order too
    again = mixing.mix_sources(table.repartition(9), {"src0": 0.2, "src1": 0.4}, epochs=1.5, partitions=3)
    assert [(r.mix_key, r.doc_id) for r in again.collect()] == [(r.mix_key, r.doc_id) for r in found]
    kept = mixing.mix_sources(docs, {"src0": 1.0})
    assert kept.columns == [*docs.columns, "mix_rate", "mix_copies", "mix_copy", "mix_key_"]
    given = {tuple(r[:-4]) for r in kept.collect()}
    assert given and given <= {tuple(r) for r in docs.collect()}  # columns of clashing names keep their values
    assert mixing.mix_sources(empty, {"src0": 1.0}).count() == 0


def test_mixing_with_very_many_sources(spark, monkeypatch):
    table = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 50) AS source", "'t' AS text")
    small = collected(mixing.mixing_digest(table, {"s1": 0.3}), "mix_key", "doc_id", "mix_copies")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert collected(mixing.mixing_digest(table, {"s1": 0.3}), "mix_key", "doc_id", "mix_copies") == small


# WARC


PAGES = [(i, f"http://x/{i}", f"<p>{'a' * 200}{i % 7}</p>") for i in range(60)] + [(100 + i, "http://short", "tiny") for i in range(4)] + [(200, None, None), (201, "http://e\r\nx: 1", ""), (202, "http://ü/ ä", "ü" * 300), (203, "u", "ü" * 300), (None, "n", f"<p>{'a' * 200}3</p>")]
PAGES += [(1, "http://x/1", PAGES[1][2]), (0, "http://x/0", PAGES[0][2])]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, payload long, record_type string").repartition(3)
    got = collected(warc.warc_digest(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    least = {}
    for p, _, h in PAGES:
        if p is not None:
            least[h] = min(p, least.get(h, p))
    want, seen = [], set()
    for p, _, h in sorted(PAGES, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and h in seen
        seen.add(h)
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[h] if revisit else None))
    assert got == sorted(want, key=repr)
    index = warc.write_archives(pages, f"file://{tmp_path}/a")
    assert not list(tmp_path.glob("a/*.part")) and index.count() == len(PAGES)
    chosen = warc.read_records(index.where("page_id % 9 = 0")).collect()
    text = {p: (h or "").encode() for p, _, h in PAGES}
    assert chosen and all(r.payload is None or bytes(r.payload) == text[r.page_id] for r in chosen)
    assert warc.warc_digest(pages.where("false")).count() == 0
    headers = []
    for r in index.collect():
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            headers.append(warc.parse(f.read(r.length))[0])
    ids = {h["WARC-Record-ID"]: h for h in headers}
    assert len(ids) == len(PAGES) and len({h["WARC-Date"] for h in headers}) == 1
    for h in headers:
        if h["WARC-Type"] == "revisit":
            of = ids[h["WARC-Refers-To"]]
            assert of["WARC-Type"] == "response" and (of["WARC-Payload-Digest"], of["X-Page-ID"]) == (h["WARC-Payload-Digest"], h["X-Refers-To-Page-ID"])


def test_hot_payloads_leave_their_copies_behind(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_PARTS", 4)
    pages = spark.createDataFrame([(i, f"u{i}", "same page " * 20 if i % 2 else f"page {i} " * 20) for i in range(200)], "page_id long, url string, html string")
    out = warc.warc_digest(pages).collect()
    assert sum(r.record_type == "response" for r in out) == 101 and all(r.refers_to == 1 for r in out if r.record_type == "revisit")


def test_ranges_join_across_small_gaps():
    found = list(warc.coalesced([("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.MAX_GAP, 5), ("a", 10**9, 5), ("b", 10**9, 5)]))
    assert [(f[0], f[1], f[2], len(f[3])) for f in found] == [("a", 0, 20 + warc.MAX_GAP, 3), ("a", 10**9, 10**9 + 5, 1), ("b", 10**9, 10**9 + 5, 1)]


# Pipeline


def test_pipeline_stages(spark, docs, rows, labels, empty, tmp_path):
    import corpus_pipeline
    from tidemark.llm import packing, toxicity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    scores = Counter((r.doc_id) for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect())
    assert Counter(r.doc_id for r in clean.collect()) == scores and clean.columns == docs.columns
    unique = corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))
    near = corpus_pipeline.drop_near_copies(spark, unique, str(tmp_path))
    left = [(r.doc_id, r.text) for r in unique.collect()]
    want = Counter(d for d, _, c in components_of(left, 4) if d == c)
    assert Counter(r.doc_id for r in near.collect()) == want and near.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, near, str(tmp_path))
    assert mixed.columns == docs.columns
    pieces = corpus_pipeline.pack(spark, mixed, str(tmp_path))
    assert pieces.agg(F.sum("length")).first()[0] == packing.pack_digest(mixed).where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
