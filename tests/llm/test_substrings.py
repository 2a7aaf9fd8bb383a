import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import substrings
from tesserae.llm.substrings import remove_repeats


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, window):
    r = random.Random(seed)
    vocabulary = ["a", "b", "ö", "Word", "word", "x\x1cy"]
    texts = [r.choice([" ", "  ", "\n", "\t"]).join(r.choice(vocabulary) for _ in range(r.randrange(0, 60))) for _ in range(30)]
    shared = " ".join(str(r.random()) for _ in range(window))
    unique = [" ".join(str(r.random()) for _ in range(r.randrange(1, 40))) for _ in range(30)]
    texts += [u + " " + shared + " " + r.choice(unique) for u in unique[:8]] + unique
    texts += [None, "", " ", "a " * 200, shared, " ".join(shared.split()[:-1])] + texts[:3]
    rows = list(enumerate(texts))
    return rows + rows[40:43] + [(None, texts[5]), (5, "x y z")]


@pytest.mark.parametrize("window", [2, 7, 8, 35])
def test_against_brute_force(spark, window, monkeypatch):
    rows = random_rows(window, window)
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, bucket string, k1 int")
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1 << 10)
    got = sorted((tuple(r) for r in remove_repeats(d.repartition(5), window=window).collect()), key=str)
    assert got == brute(rows, window)


def test_very_long_texts(spark):
    words = [str(i * 7919 % 1_000_003) for i in range(70_000)]
    rows = [(1, " ".join(words)), (2, "q " + " ".join(words[66_000:66_040])), (3, "same " * 66_000)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert [(got[i].n_words, got[i].n_removed) for i in (1, 2, 3)] == [(70_000, 40), (41, 40), (66_000, 66_000)]
    assert got[2].kept_text == "q" and got[3].kept_text == ""


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("gaps", [[1], [1, 65_534, 65_535, 65_536, 1, 131_070, 200_000, 3]])
def test_steps_come_back(gaps):
    places = 70_000 + np.cumsum(gaps)
    assert substrings._places(*substrings._steps(places)).tolist() == places.tolist()


def test_small_packs(spark, monkeypatch):
    rows = random_rows(9, 7)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(substrings, "SEND_WORDS", 50)
    got = sorted((tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=7).collect()), key=str)
    assert got == brute(rows, 7)
