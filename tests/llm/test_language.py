import numpy as np

from tesserae.llm import language
from tesserae.llm.language import fit_languages, identify_language, ngram_counts, with_known_language
from tesserae.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert sum(r.rejected for r in got) == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("123", "fr"), ("zzz", None)])], "doc_id long, text string, lang string")
    m = fit_languages(train)
    assert m.languages == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 34!"), (4, "THE dog"), (5, "чужой язык"), (6, "le " * 200_000), (6, "le " * 200_000), (None, "chien")]
    got = identify_language(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string"), m).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)] * 3 + [("en", False), (got[4].lang_pred, True)] + [("fr", False)] * 3
    empty = fit_languages(train.limit(0))
    assert {r.lang_pred for r in identify_language(train, empty).collect()} == {"und"}
    assert identify_language(train.limit(0), m).count() == 0


def brute_centroids(texts, clusters):
    """Dense vectors and plain loops over a small training set, as fit_languages() and identify_language() are to give."""
    counts = [ngram_counts(t) for _, t in texts]
    idf = np.log((1 + len(texts)) / (1 + sum((c > 0).astype(int) for c in counts))) + 1
    unit = lambda c: np.log1p(c) * idf / np.linalg.norm(np.log1p(c) * idf)
    out = {}
    for lang in sorted({x for x, _ in texts}):
        x = [unit(c) for (l, _), c in zip(texts, counts, strict=True) if l == lang]
        mean = sum(x) / len(x)
        start = [max(range(len(x)), key=lambda i: (round(x[i] @ mean, 9), -i))]
        while len(start) < min(clusters, len(x)):
            start.append(min(range(len(x)), key=lambda i: (round(max(x[i] @ x[j] for j in start), 9), i)))
        centres = [x[i] for i in start]
        for _ in range(15):
            of = [max(range(len(centres)), key=lambda j: (round(v @ centres[j], 9), -j)) for v in x]
            for j in range(len(centres)):
                if own := [v for v, k in zip(x, of, strict=True) if k == j]:
                    centres[j] = sum(own) / np.linalg.norm(sum(own))
        out[lang] = centres
    return idf, out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = sorted(((r.doc_id, r.text, r.lang) for r in docs.where("doc_id % 4 = 1").collect()), key=lambda x: x[0])
    train = spark.createDataFrame(few, "doc_id long, text string, lang string")
    order = {r.doc_id: r.h for r in train.selectExpr("doc_id", "xxhash64(string(doc_id)) AS h").collect()}
    idf, centres = brute_centroids([(x, t) for _, t, x in sorted(few, key=lambda x: order[x[0]])], 2)
    model = fit_languages(train, clusters=2)
    assert np.allclose(model.idf, idf)
    got = {r.doc_id: r for r in identify_language(docs, model).collect()}
    for r in docs.collect():
        if (c := ngram_counts(r.text)) is None:
            assert got[r.doc_id].lang_pred == "und"
            continue
        v = np.log1p(c) * idf / np.linalg.norm(np.log1p(c) * idf)
        best = {x: max(float(v @ m) for m in ms) for x, ms in centres.items()}
        assert abs(got[r.doc_id].score - max(best.values())) < 1e-4 and best[got[r.doc_id].lang_pred] > max(best.values()) - 1e-4


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = fit_languages(docs)
    said = [
        "Kissa istui ikkunalaudalla ja katseli pihalla leikkiviä lapsia, kunnes ilta pimeni",
        "Tegnap este hosszú sétát tettünk a folyó mentén, és megnéztük a régi hidat meg a templomot",
        "qzx wvkpt ghjfr bnmxz qqwrt plkjh zxcvb mnbvq wrtyp sdfgh",
    ]
    got = identify_language(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), model).collect()
    assert [r.rejected for r in got] == [True] * 3
    assert identify_language(docs, model).where("rejected").count() <= 3


def test_nothing_is_rejected_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    assert [r.rejected for r in identify_language(docs, model).collect()] == [False, True, True]
    clash = docs.withColumn("score", docs["doc_id"]).withColumn("rejected", docs["text"])
    assert [tuple(r) for r in with_known_language(clash, model).collect()] == [(1, "some words", None, 1, "some words")]


def test_ties_go_to_the_first_language(spark):
    train = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    assert identify_language(train, fit_languages(train)).first().lang_pred == "a"


def test_pieces_do_not_change_counts(monkeypatch):
    text = "Ein langer Text, mit 3 Wörtern 𝒳𝒴 und mehr. " * 40
    whole = ngram_counts(text)
    monkeypatch.setattr(language, "PIECE", 50)
    assert np.array_equal(whole, ngram_counts(text))
