"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, node long, key string, slice long, identity long, mix_key long, hot boolean, label string, stay_id long, stay_sha256 string, exact_key string, exact_row string, mix_source string, mix_slot long, `a.b` long"


def row(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, True, 0.5, 7, "k", 3, 4, 5, False, "x", 6, "s", "e", "r", "m", 7, 8)


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "er", "the", "ing", "ou", "st", "re", "on", "ha", "ti", "é", "ü"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (rng.choice([".", ",", ".\n"]) if rng.random() < 0.1 else "") for w in words)


def texts() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 200)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(6)]  # exact copies
    rows += [(120, base[0]), (121, base[0].upper()), (122, " " + base[0])]
    for i in range(12):  # near copies of one text
        words = base[7].split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((140 + i, " ".join(words)))
    rows += [(160 + i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for i in range(8)]
    rows += [(180, prose(rng, 30_000)), (181, "word " * 40), (182, "a b c"), (183, "a b c"), (184, "A  b\tC"), (185, "a"), (186, None), (187, None), (188, ""), (189, ""), (190, " \n\t "), (None, "lost id lost id"), (None, base[3]), (191, "x\n\nx\ny\nx \ny\n")]
    rows += [(5, base[5]), (5, base[5])]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([row(d, t, f"src{(d or 0) % 3}") for d, t in rows], NAMES).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def labels(spark, rows):
    ids = sorted({d for d, _ in rows if d is not None})
    return spark.createDataFrame([(d, int(d % 4 != 0), int(d % 5 == 0)) for d in ids] + [(None, 1, 1), (ids[0], None, None)], "doc_id long, quality int, toxic int")
