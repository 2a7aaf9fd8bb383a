import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tesserae.llm.ppm import ORDER, score_texts
from tesserae.llm.queries import QUERIES


def line(text):
    return b" ".join((text or "").encode().lower().split()) + b"\xff"


def brute(rows, modulus=7, remainder=2):
    held = [i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i, _ in rows]
    counts = defaultdict(Counter)
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            s = b"\xff" * ORDER + line(t)
            for p in range(ORDER, len(s)):
                for j in range(ORDER + 1):
                    counts[s[p - j : p]][s[p]] += 1
    words = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*line(t)[:-1].split(), None])
    n, v = sum(words.values()), len(words)

    def code(context, symbol):
        out, gone = 0.0, set()
        for j in range(ORDER, -1, -1):
            c = {s: k for s, k in counts.get(context[len(context) - j :], {}).items() if s not in gone}
            total = sum(c.values())
            if total:
                if symbol in c:
                    return out + math.log10((2 * c[symbol] - 1) / (2 * total))
                out += math.log10(len(c) / (2 * total))
            gone |= set(c)
        return out - math.log10(256 - len(gone))

    out = []
    for (i, t), h in zip(rows, held, strict=True):
        s, tokens = b"\xff" * ORDER + line(t), [*line(t)[:-1].split(), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, h, len(tokens), sum(words[w] > 0 for w in tokens), n, base, sum(code(s[p - ORDER : p], s[p]) for p in range(ORDER, len(s)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_grams", [10**6, 40])
def test_against_brute_force(spark, block_grams):
    r = random.Random(5)
    texts = [r.choice([" ", "\n "]).join(r.choice(["the", "The", "then", "hen", "ñu", "x", "zebra", "q!"]) for _ in range(r.randrange(0, 25))) for _ in range(40)]
    texts += [None, "", " ", "Ω new Ж", "lead  and trail ", " x"] + texts[:3]
    rows = [*enumerate(texts), (3, texts[3]), (None, "hen")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, grp string")
    got = sorted((tuple(x) for x in score_texts(d.repartition(3), block_grams=block_grams).collect()), key=str)
    want = brute(rows)
    assert [x[:5] for x in sorted(got, key=lambda x: str(x[:5]))] == [x[:5] for x in sorted(want, key=lambda x: str(x[:5]))]
    for a, b in zip(sorted(got, key=lambda x: (str(x[:5]), x[6])), sorted(want, key=lambda x: (str(x[:5]), x[6])), strict=True):
        assert a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_no_training_text(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (got,) = score_texts(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert got.held_out and got.train_tokens == 0 and got.score == pytest.approx(-3 * math.log10(256))
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_better_than_words_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op5_ppm_scoring"](spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)
