import random
import re
import zlib
from collections import Counter

import pytest

from tesserae.llm.spelling import near_words, noisy_words, spelling_variants

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(ASCII_LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:i] + a[i + (len(a) == len(b)) :] == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(n, ratio=10):
    others = {w: [o for o in n if near(w, o)] for w in n}
    form = {w: min(others[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def edited(r, word, letters):
    i, c = r.randrange(len(word) + 1), r.choice(letters)
    return r.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.mark.parametrize(("letters", "seed"), [("ab", 1), ("abc", 2), ("abcdefghijklmnopqrstuvwxyzéß×", 3)])
def test_no_near_pair_is_missed(spark, letters, seed):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(7, 14))) for _ in range(120)]
    words = {w for b in base for w in [b, *(edited(r, b, letters) for _ in range(4))] if len(w) >= 7} | {"a" * 7, "a" * 8, "a" * 60, "ab" * 30, "ab" * 30 + "a"}
    got = near_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string"))
    assert sorted(tuple(x) for x in got.collect()) == sorted((a, b) for a in words for b in words if near(a, b))


def test_words_and_variants_against_brute_force(spark):
    r = random.Random(5)
    base = ["Kartoffel", "question", "rivière", "señoritas", "information", "Überhaupt"]
    common = [w for w in base for _ in range(40)]
    texts = [" ".join(r.choice([r.choice(common), edited(r, r.choice(base), "aeionrst")]) + r.choice([" ", ".", "-", "1", "\n"]) for _ in range(r.randrange(80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (None, "question questionn question questionn"), (3, texts[3]), (3, texts[3]), (102, "longest" * 3000 + " " + "longest" * 3000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    words = noisy_words(docs)
    n = brute_words(rows)
    assert {x.word: x.n for x in words.collect()} == n
    assert sorted(tuple(x) for x in spelling_variants(words).collect()) == brute_variants(n)


def test_chains_lead_to_the_last_form(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 25, "aaaaabb": 300, "aaaabbb": 4000, "aaabbbb": 50000, "aabbbbb": 600000, "zzzzzzz": 7}
    got = spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted(tuple(x) for x in got) == brute_variants(n)
    assert {x.word: x.root for x in got}["aaaaaaa"] == "aabbbbb"


def test_ties_and_empty_tables(spark):
    n = {"abcdefg": 2, "abcdefx": 20, "abcdefh": 20, "abcdefgh": 19}
    got = {x.word: x for x in spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["abcdefg"].form == "abcdefh" and got["abcdefg"].n_near == 3
    assert spelling_variants(noisy_words(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    assert noisy_words(spark.createDataFrame([(1, "short words only")], "doc_id long, text string")).collect() == []
