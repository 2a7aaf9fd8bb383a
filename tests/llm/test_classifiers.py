import time

import numpy as np
import pytest

from tesserae.llm import toxicity
from tesserae.llm.quality import fit_network, fit_quality, pooled, score_quality, word_vectors
from tesserae.llm.queries import QUERIES
from tesserae.llm.toxicity import char_table, decode, fit_toxicity, lattice, restored, score_toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "  "), (4, "plain words here"), (5, "x" * 300_000), (6, "same same"), (6, "same same"), (None, "no id")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("name", "label", "least"), [("op10_quality_classifier", "quality", 0.95), ("op3_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold few toxic rows
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    wins = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    assert wins.mean() > 0.95


def test_edge_cases(spark, tables):
    d = spark.createDataFrame([(i, t, 0.5) for i, t in EDGES], "doc_id long, text string, score double")
    for got in (score_toxicity(d, fit_toxicity(*tables)), score_quality(d, fit_quality(*tables))):
        rows = sorted((tuple(r) for r in got.collect()), key=str)
        assert len(rows) == len(EDGES) and all(0 <= r[2] <= 1 for r in rows)
        assert got.limit(0).count() == 0


def test_without_labels(spark, tables):
    docs, labels = tables[0].limit(20), tables[1].limit(0)
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()} == {0.5}
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels)).count() == 0


def test_disguises_are_read(spark, tables):
    table = char_table(tables[0])
    for said, meant in [("l0ser", "loser"), ("tr@sh", "trash"), ("1d10t", "idiot"), ("looooser", "loser"), ("s.c.u.m", "scum"), ("m0r0n", "moron"), ("pathet1c", "pathetic")]:
        assert decode(said, table) == meant
    assert restored("you are a l o s e r, tr4sh and fine", table) == "you are a loser, trash and fine"


def test_disguised_words_are_found(spark):
    model = fit_toxicity(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    known = [w for w in ("loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid") if model.odds(w) > 3]
    assert len(known) >= 5
    for w in known:
        look = w.replace("o", "0").replace("i", "1").replace("s", "$").replace("t", "+")
        for form in (w, look, w.upper() + "!!", " ".join(w), ".".join(w), w[0] + w[1] * 4 + w[2:]):
            assert model.score(f"the thing of {form} and that") > 0.3, form
    assert model.score("the thing of ering and that") < 0.3


def test_viterbi_against_all_paths(spark, tables):
    table = char_table(tables[0])

    def paths(arcs, i=0):
        if i == len(arcs):
            yield 0.0, ""
            return
        for letters, cost, j in arcs[i]:
            for c, w in paths(arcs, j):
                yield c + cost, letters + w

    def score(word):
        x = [0, 0, *(toxicity._CLASS.get(c, toxicity._OTHER) for c in word), 0]
        return sum(table[a, b, c] for a, b, c in zip(x, x[1:], x[2:], strict=False))

    for token in ("l00ser", "a$$b", "1!l", "sssss", "x*y", "éé0"):
        best = max((score(w) - c, w) for c, w in paths(lattice(token)) if w)
        assert decode(token, table) == best[1]


def test_vectors_do_not_depend_on_partitions(spark, tables):
    d = tables[0].limit(200)
    one, many = word_vectors(d.coalesce(1)), word_vectors(d.repartition(70))
    assert np.allclose(one, many, atol=1e-3)


def test_pooling_by_text(spark):
    texts = [b"a b c", b"", b"!!! ?", b"word " * 150_000, b"z"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    v = np.random.default_rng(0).normal(size=(1 << 14, 64)).astype(np.float32)
    together = pooled(data, offsets, v)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], pooled(np.frombuffer(t, np.uint8), np.array([0, len(t)]), v)[0], atol=1e-3)


def test_network_learns_and_is_calibrated():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5))
    y = (x[:, 0] * x[:, 1] + r.normal(0, 0.1, 2000) > 0).astype(float)
    net = fit_network(x, y)
    p = net.probability(x)
    assert ((p > 0.5) == y).mean() > 0.8 and abs(p.mean() - y.mean()) < 0.05


def test_marks_at_the_ends_may_be_letters(spark, tables):
    table = char_table(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for said, meant in [("!diot", "idiot"), ("!diot!!!", "idiot"), ('"(lown,"', "clown"), ("<lown", "clown"), ("tras#", "trash"), ("(great)", "great")]:
        assert meant in toxicity.readings(said, table), (said, toxicity.readings(said, table))
    assert all(meant in toxicity.readings(x, table) for x, meant in (("|oser", "loser"), ("pas$", "pass"), ("(!diot", "idiot"), ("!.diot", "idiot")))
    assert toxicity.readings("great,", table) == ["great"] and toxicity.readings("!!!", table) == []


def test_repeated_letters_and_mixed_separators_are_joined():
    for text, word in [("you a s s there", "ass"), ("p o o p", "poop"), ("f.u c.k", "fuck"), ("so s-t.u p_i d!", "stupid")]:
        assert word in toxicity.spaced_words(text)
    assert toxicity.spaced_words("nothing of the kind a b here") == []
    assert "abcdefghijklmnopqrstuvwxyz" * 2 in toxicity.spaced_words("so " + " ".join("abcdefghijklmnopqrstuvwxyz" * 2) + " it ends")


def test_long_tokens_are_decoded(spark, tables):
    table = char_table(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for said, meant in [("1d10t" + "!" * 40, "idiot"), ("l" + "o" * 60 + "ser", "loser"), (".".join("l" + "o" * 45) + ".s.e.r", None), ("-" * 50 + "l0ser", "loser")]:
        got = toxicity.readings(said, table)
        assert meant in got if meant else any(w != said and w.startswith("lo") and w.isalpha() for w in got), got
    assert restored("a l" + "o" * 60 + "ser", table) == "a loser"
    began = time.perf_counter()
    assert all(toxicity.readings(x, table) for x in ("a1" * 50_000, "f.u-c.k." * 10_000, "(!" * 20_000 + "x" + "!(" * 20_000))
    assert time.perf_counter() - began < 60


def test_character_counts_do_not_depend_on_parts(spark, tables, monkeypatch):
    whole = char_table(tables[0].limit(50))
    monkeypatch.setattr(toxicity, "PART", 7)
    assert np.allclose(whole, char_table(tables[0].limit(50)))


def test_toxicity_against_plain_loops(spark, tables):
    """Scores from the model's counts and weights, with every path of a token's lattice tried instead of Viterbi's search."""
    model = fit_toxicity(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))

    def spell(arcs, i, a, b):
        """(score, word) of every path from place i on, with the classes of the last two letters."""
        if i == len(arcs):
            yield model.table[a, b, 0], ""
            return
        for letters, cost, j in arcs[i]:
            x, y, s = a, b, -cost
            for ch in letters:
                k = toxicity._CLASS.get(ch, toxicity._OTHER)
                s += model.table[x, y, k]
                x, y = y, k
            for t, rest in spell(arcs, j, x, y):
                yield s + t, letters + rest

    def plain_score(text):
        odds = {}
        for token in {*text.split(), *toxicity.spaced_words(text)}:
            words = [w for w in toxicity.readings(token, model.table)]
            low = token.lower()
            if len(low) < 9 and low[0].isalnum() and low[-1].isalnum() and not low.isalpha() and any(x.isalpha() for x in low):
                best = max((s, w) for s, w in spell(lattice(low), 0, 0, 0) if w)[1]
                assert best in words and len(words) <= 2 and low in words
            strongest = max(((max((toxicity.ToxicityModel.odds(model, f) for f in toxicity.features(w)), default=0.0), w) for w in words), default=(0.0, ""))
            if strongest[0] > 1.5:
                odds[strongest[1]] = strongest[0]
        top = sorted(odds.values(), reverse=True) + [0.0, 0.0]
        z = float(np.array([1.0, top[0], top[1], np.log1p(sum(x > 4 for x in top))]) @ model.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(120).collect()] + ["what an 1d10t", "l0ser, tr4sh and m0r0n", "a s s h 0 l e", ""]
    got = score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], [plain_score(t) for t in texts], atol=1e-9)


def test_word_vectors_and_pooling_against_plain_loops(spark):
    from tesserae.llm import quality
    from tesserae.llm.wordhash import mix

    texts = ["the cat sat on the mat !!", "a dog -- and a cat ?!", "", "one"]
    got = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    want, docs = np.zeros((quality.ROWS, quality.DIMS)), []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        kinds = []
        for words in quality.streams(data, np.array([0, len(data)])) if len(data) else []:
            hashes, rows = words.hashes.tolist(), quality.rows_of(words).tolist()
            kinds.append(rows)
            for i in range(len(hashes)):
                for j in range(max(0, i - quality.WINDOW), min(len(hashes), i + quality.WINDOW + 1)):
                    if i != j:
                        for k in range(quality.NONZERO):
                            x = int(mix(np.array([hashes[j]], np.uint64) ^ np.uint64(0xA5A5A5A5 + k))[0])
                            want[rows[i], x % quality.DIMS] += 1 if x >> 63 else -1
        docs.append(kinds)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, want, atol=1e-5)
    for t, kinds in zip(texts, docs, strict=True):
        row = pooled(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), got)[0]
        parts = [got[k] for k in kinds] if kinds else []
        for at, x in ((0, parts[0].mean(axis=0) if parts and len(parts[0]) else 0), (64, parts[0].std(axis=0) if parts and len(parts[0]) else 0), (128, parts[1].mean(axis=0) if parts and len(parts[1]) else 0)):
            assert np.allclose(row[at : at + 64], x, atol=1e-4)


def test_toxicity_of_an_empty_table(spark, tables):
    docs, labels = tables[0].limit(0), tables[1]
    model = fit_toxicity(docs, labels)
    assert score_toxicity(docs, model).count() == 0 and score_toxicity(tables[0].limit(3), model).count() == 3
