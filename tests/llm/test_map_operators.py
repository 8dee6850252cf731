"""Licences, quality, packing, token counts, toxicity: against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licences, packing, quality, token_counts, toxicity
from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.wordbpe import load

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Suffix automaton


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=20))
def test_matching_statistics(strings, text):
    automaton = SuffixAutomaton()
    for s in strings:
        automaton.add(s)
    factors = {tuple(s[a:b]) for s in strings for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for i, (state, length) in enumerate(automaton.statistics(text)):
        assert length == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in factors), default=0)
        assert length <= automaton.size[state]


# Licences


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


LICENSED = [
    "GNU General Public License and gnu-general/public license", "mit license", "xmit license. MIT LICENSE mit licenses", "The CC BY text, cc by cc by", "ümit license mit  license", "apache license apache licence",
    "gnu general public gnu general public license gnu", licences.TEMPLATES["mit"], "so " + licences.TEMPLATES["apache"][:400] + " and more", "a" * 50, "gnu general public\x00license",
]


def test_base_phrases(spark, docs, rows, empty):
    extra = [(1000 + i, t) for i, t in enumerate(LICENSED)] + [(2000, " ".join(LICENSED) * 50)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = []
    for doc_id, text in [*rows, *extra]:
        n, places = base_places(text)
        starts = [i for i, _ in places]
        want.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    out = licences.licence_digest(table)
    assert collected(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    for r in out.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    found = {r.doc_id: r for r in out.collect()}
    assert found[1007].labels == "mit" and found[1007].score > 0.9 and "apache" in found[1008].labels and found[1009].labels == ""
    assert licences.licence_digest(empty).count() == 0


def test_template_spans(spark):
    words = licences.TEMPLATES["bsd"].split()
    edited = " ".join(["before"] * 9 + words[:40] + ["inserted", "here"] + words[42:] + ["after"] * 9)
    one = licences.scan_licences(spark.createDataFrame([(1, edited)], "doc_id long, text string")).first()
    span = next(s for s in one.spans if s.label == "bsd" and s.covered > 0.5)
    assert one.labels == ["bsd"] and span.start == 9 and span.covered > 0.9 and span.end <= 9 + len(words) + 5


# Quality


def base_statistics(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_quality_statistics(spark, docs, rows, labels, empty):
    extra = [(3000, "a b c d e " * 3), (3001, "ü#€ $x| " * 4), (3002, "one\ntwo\none\n\n \none"), (3003, "\x0b\x0c x\x85y z")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    out = quality.judge_quality(table, labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(out, *columns) == sorted(((d, *base_statistics(t)) for d, t in [*rows, *extra]), key=repr)
    assert not [r for r in out.collect() if r.base_failed and r.kept]
    none = quality.judge_quality(docs, labels.where("false"))
    assert none.where("kept = base_failed").count() == 0
    assert quality.judge_quality(empty, labels).count() == 0


def test_boosting_is_monotone_and_flat_arrays_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] - 0.5 * x[:, 1] + 0.3 * np.sin(3 * x[:, 2]) + rng.normal(scale=0.5, size=2000)) > 0).astype(float)
    model = quality.fit(x, y, [1, -1, 0], trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.85
    for f, sign in ((0, 1), (1, -1)):
        for _ in range(20):
            line = np.repeat(rng.normal(size=(1, 3)), 50, axis=0)
            line[:, f] = np.linspace(-3, 3, 50)
            assert (sign * np.diff(model.score(line)) >= -1e-12).all()

    def walk(node, v):
        while model.left[node] != node:
            node = model.left[node] if v[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    direct = [1 / (1 + np.exp(-(model.bias + sum(walk(r, v) for r in model.roots)))) for v in x[:100]]
    assert np.allclose(direct, model.score(x[:100]))


# Tokens


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBc'sd tT9 \n\t.,!<|>endoftextéÉ́ \x85\x1c中"), max_size=60))
def test_word_pieces_are_exact(text):
    encoder = load(None)
    assert encoder.encode(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark, docs, rows, empty):
    encoder = load(None)
    extra = [(4000, "<|endoftext|> A <|ENDOFTEXT|>"), (4001, "x" * 9000 + " y" * 6000)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    out = packing.pack(table).collect()
    want = Counter((d, tuple(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in [*rows, *extra])
    sequences = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    stream, total = [], 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
        total += at
    for key in sorted(sequences):
        stream += sorted(sequences[key], key=lambda p: p.offset)
    got, current = Counter(), []
    for p in stream:  # order is preserved, so a document's pieces follow each other
        assert p.start == sum(len(c) for c in current)
        current.append(np.frombuffer(p.ids, "<u4").tolist())
        if p.start + p.length == p.doc_tokens:
            got[p.doc_id, tuple(i for c in current for i in c)] += 1
            current = []
    assert not current and got == want
    digest = packing.pack_digest(table).collect()
    assert Counter((p.doc_id, p.start, p.ids_crc32) for p in digest) == Counter((p.doc_id, p.start, zlib.crc32(p.ids)) for p in out)
    assert packing.pack(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(8, 14), st.randoms())
def test_cuts_are_best(gaps, size, rng):
    gaps = [min(g, size) for g in gaps]
    ends = np.cumsum(gaps)
    penalties = np.array([rng.randint(0, 5) for _ in gaps])
    best = [0.0] + [float("inf")] * len(ends)
    points = [0, *ends.tolist()]
    for j in range(1, len(points)):
        best[j] = min(best[i] + size - (points[j] - points[i]) for i in range(j) if points[j] - points[i] <= size) + penalties[j - 1]
    chosen = packing.cuts(ends, penalties, size).tolist()
    assert chosen[-1] == points[-1]
    cost, last = 0, 0
    for c in chosen:
        assert 0 < c - last <= size
        cost += size - (c - last) + penalties[points.index(c) - 1]
        last = c
    assert cost == best[-1]


def test_padding_is_little(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) + rng.choice(["", ".", ""]) for _ in range(rng.randint(1, 900)))) for i in range(1500)]
    out = packing.pack_digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    tokens, sequences = out.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert 1 - tokens / (4096 * sequences) < 0.01


def test_token_counts(docs, rows, empty):
    encoder = load(None)
    n = lambda t: len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((d, len(WORDS.findall(t or "")), n(t), n(token_counts.edited(t or "", token_counts.personal_data(t or "")))) for d, t in rows), key=repr)
    out = token_counts.token_counts(docs)
    assert collected(out, "doc_id", "n_pretokens", "n_tokens", "n_tokens_after") == want
    for r in out.collect():
        assert np.frombuffer(r.tree, "<i8")[1] == r.n_tokens_after
    assert token_counts.token_counts(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_edits_recount_exactly(data):
    encoder = load(None)
    text = data.draw(st.text(alphabet="ab 'sT.\n", max_size=80))
    marks = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=8)))
    edits = [(a, b, data.draw(st.text(alphabet="xy z.", max_size=5))) for a, b in zip(marks[::2], marks[1::2], strict=False)]
    edits = [e for i, e in enumerate(edits) if i == 0 or e[0] > edits[i - 1][1]]
    count = lambda s: len(encoder.tokenizer.encode(s, add_special_tokens=False).ids)
    tree = token_counts.TokenTree(np.array([count(w) for w in token_counts.CHUNK.findall(text)], np.int64))
    token_counts.apply_edits(text, tree, edits, count)
    assert tree.total == count(token_counts.edited(text, edits))


def test_redaction_recounts_little(spark):
    text = "word " * 5000 + "mail me@example.org or +1 (555) 555-0101 now " + "more " * 5000
    one = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert one.n_edits == 2 and one.n_reencoded < 12
    assert one.n_tokens_after == len(load(None).encode(token_counts.edited(text, token_counts.personal_data(text))))


# Toxicity


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in out)
    assert hit / sum(r.predicted for r in out) > 0.9 and hit / sum(r.toxic for r in out) > 0.85
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(documents, flipped).where("doc_id % 50 = 0").collect()}
    assert again == {r.doc_id: r.score for r in toxicity.score_toxicity(documents, labels).where("doc_id % 50 = 0").collect()}  # labels of held-out rows don't matter


def test_toxicity_edge_cases(docs, rows, labels, empty):
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_non_negative_risk_recovers_a_known_signal():
    rng = np.random.default_rng(0)
    make = lambda toxic: (np.unique(np.concatenate([rng.integers(10, 400, 30), rng.integers(0, 5, 2) if toxic else []]).astype(int)),)
    doc = lambda toxic: (f := make(toxic)[0], np.ones(len(f)))
    positive, unlabelled = [doc(True) for _ in range(150)], [doc(i % 5 == 0) for i in range(1000)]
    model = toxicity.fit_nnpu(positive, unlabelled, 0.2)
    margins = [model.margin(*toxicity.stack([doc(t)]), 1)[0] for t in [True] * 50 + [False] * 200]
    assert np.mean(margins[:50]) > np.mean(margins[50:]) + 1 and np.median(margins[50:]) < 0


def test_edits_reach_every_text(spark):
    """Unicode digits, and edits of a caller's own on texts without digits."""
    table = spark.createDataFrame([(1, "call \u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669 now"), (2, "no marks in here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(table).collect()}
    assert {d: r.n_edits for d, r in got.items()} == {1: 1, 2: 0, 3: 0}
    assert got[1].n_tokens_after == len(load(None).encode("call [removed] now"))
    own = {r.doc_id: r for r in token_counts.token_counts(table, edits=lambda t: [(0, 2, "some")] if t.startswith("no") else []).collect()}
    assert {d: r.n_edits for d, r in own.items()} == {1: 0, 2: 1, 3: 0}
    assert own[2].n_tokens_after == len(load(None).encode("some marks in here"))


def test_phrases_and_matches_of_one_word(spark):
    scanner = licences.LicenceScanner(phrases={"mit": "mit", "apache license": "apache"}, templates={"t": "alpha beta gamma"}, min_match=1)
    table = spark.createDataFrame([(1, "the MIT one, mit"), (2, "apache"), (3, "apache license mit"), (4, "x gamma y"), (5, "mit")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(table, scanner).collect()}
    assert {d: (r.n_base, r.first_word, r.last_word, r.base_labels) for d, r in got.items()} == {1: (2, 1, 3, ["mit"]), 2: (0, None, None, []), 3: (2, 0, 2, ["apache", "mit"]), 4: (0, None, None, []), 5: (1, 0, 0, ["mit"])}
    assert [(s.label, s.start, s.end) for s in got[4].spans] == [("t", 1, 2)] and got[4].score == pytest.approx(1 / 3)
    assert {r.doc_id: r.n_base for r in licences.scan_licences(table, licences.LicenceScanner(phrases={"mit": "mit"})).collect()} == {1: 2, 2: 0, 3: 1, 4: 0, 5: 1}


def test_factor_with_several_places(spark):
    """A factor that stands twice in a template prolongs the chain from its second place."""
    scanner = licences.LicenceScanner(phrases={"zz yy": "z"}, templates={"t": "a b c d e f g h a b c d e"}, min_match=3)
    one = licences.scan_licences(spark.createDataFrame([(1, "c d e f g x a b c")], "doc_id long, text string"), scanner).first()
    assert [(s.start, s.end, round(s.covered, 4)) for s in one.spans] == [(0, 9, round(8 / 13, 4))]


@pytest.mark.parametrize("make", [licences.licence_digest, packing.pack_digest, token_counts.token_counts])
def test_partitions_do_not_matter_to_rows(docs, make):
    columns = [c for c in ("doc_id", "n_words", "labels", "doc_tokens", "n_tokens") if c in make(docs).columns]
    assert set(collected(make(docs.repartition(1)), *columns)) == set(collected(make(docs.repartition(7)), *columns))
