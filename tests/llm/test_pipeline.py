import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_near_duplicates import brute as brute_near
from tests.llm.test_near_duplicates import family, shingles  # noqa: F401
from tests.llm.test_substrings import brute as brute_repeats
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(2)
    base = [x.text for x in docs.limit(30).collect()]
    extra = [(9001, None, None), (9002, "", "en"), (9003, "12 34 !!", "en"), (9004, base[0], "en"), (9005, items[0][1], "en"), (9006, "и чужой язык совсем другой", None)]
    extra += [(9100 + i, base[3] + " " + t, "en") for i, t in enumerate(family(r, 60, 3, 1))] + [(9100, base[3], "en")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in extra], docs.schema))
    for (name, stage), check in zip(corpus_pipeline.STAGES, (None, near, repeats, contaminated, packed), strict=True):
        before = [tuple(x) for x in docs.collect()]
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = [tuple(x) for x in docs.collect()]
        if check is None:
            assert {x[0] for x in before} - {x[0] for x in after} == {9001, 9002, 9003, 9006}
            assert set(after) <= set(before)
        else:
            check(before, after, items)
        assert name == "best_fit_packing" or docs.columns == columns


def near(before, after, items):
    kept = {i for i, _, _, k in brute_near([x[:2] for x in before], shingle=5) if k}
    assert sorted(x[0] for x in after) == sorted(kept) and set(after) <= set(before)


def repeats(before, after, items):
    want = {i: (n, gone, sha) for i, n, gone, sha in brute_repeats([x[:2] for x in before], 35)}
    assert len(after) == len(before)
    old = {x[0]: x[1] for x in before}
    for x in after:
        assert want[x[0]][2] == hashlib.sha256(b" ".join((x[1] or "").encode().split())).hexdigest()
        assert want[x[0]][1] or x[1] == old[x[0]]


def contaminated(before, after, items):
    assert sorted(x[0] for x in after) == sorted(x[0] for x in brute_contamination([x[:2] for x in before], items, 13) if not x[-1])
    assert set(after) <= set(before)


def packed(before, after, items):
    class Row:
        def __init__(self, x):
            self.sequence_id, self.offset, self.length = x[5], x[6], x[3]

    check_packing([Row(x) for x in after], 4096)
    assert {x[0] for x in after} == {x[0] for x in before}


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_unlabelled_empty_and_clashing_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    language = dict(corpus_pipeline.STAGES)["language_id"]
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language(spark, bare, SF).count() == docs.where("text rlike '[a-zA-Z]'").count()
    odd = docs.withColumn("row", docs["doc_id"]).withColumn("_kept_text", docs["text"]).withColumn("salt", docs["lang"]).withColumn("n_words", docs["doc_id"])
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            if name == "best_fit_packing":
                assert bool(out.count()) == bool(table.count())
            else:
                assert out.columns == table.columns and (out.count() > 0) == (table.count() > 0), name
