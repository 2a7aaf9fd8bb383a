import numpy as np

from tesserae.llm.quality import fit_network, fit_quality, score_quality
from tesserae.llm.samples import labelled_sample
from tesserae.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.1"


def test_weights_restore_the_shares(spark):
    labels = spark.range(5000).selectExpr("id AS doc_id", "int(id % 10 = 0) AS toxic")
    docs = labels.selectExpr("doc_id", "'t' AS text")
    for per_class in (100, 10_000):
        got = labelled_sample(docs, labels, "toxic", per_class=per_class, modulus=4, remainder=2).groupBy("y").agg({"*": "count", "weight": "sum"})
        got = {r["y"]: (r["count(1)"], r["sum(weight)"]) for r in got.collect()}
        want = {r["toxic"]: r["count"] for r in labels.where("crc32(cast(string(doc_id) as binary)) % 4 <> 2").groupBy("toxic").count().collect()}
        assert all(got[y][0] == min(per_class, want[y]) and abs(got[y][1] - want[y]) < 1e-6 for y in (0, 1))


def test_network_keeps_the_share_of_a_rare_label():
    r = np.random.default_rng(3)
    y = (np.arange(22_000) % 11 == 0).astype(float)
    x = r.normal(size=(len(y), 6))
    x[:, 0] += y
    taken = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[:2000]])
    full = fit_network(x, y).probability(x)
    capped = fit_network(x[taken], y[taken], np.where(y[taken] == 1, 1.0, 10.0)).probability(x)
    assert abs(full.mean() - y.mean()) < 0.02 and abs(capped.mean() - y.mean()) < 0.02
    assert np.abs(full - capped).mean() < 0.05


def test_capped_fit_scores_like_the_full_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for fit, score, label, per_class in ((fit_toxicity, score_toxicity, "toxic", 350), (fit_quality, score_quality, "quality", 430)):
        mean = [score(docs, fit(docs, labels, per_class=n)).join(labels.select("doc_id", label), "doc_id").selectExpr("avg(score) AS s", f"avg({label}) AS y").first() for n in (6000, per_class)]
        assert abs(mean[0].s - mean[1].s) < 0.03 and abs(mean[1].s - mean[1].y) < 0.03, (label, mean)
