"""Counts by a model's vocabulary against the library, and chunks measured by them."""

import base64

import pyarrow.parquet as pq
import pytest

from tesserae.functions.tokens import ModelTokens
from tesserae.plans.queries import QUERIES
from tests.test_split import plain

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(spark, encoding):
    texts = [None, "", " ", "one two", "<|endoftext|> is text", "é🎉\u200b", "x" * 20_000, "word, " * 5_000]
    model = ModelTokens(spark, str(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.n for r in rows.select("id", model.column("text").alias("n")).collect()}
    assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert rows.where("id < 0").select(model.column("text")).count() == 0


def test_a_missing_or_empty_vocabulary_is_an_error(spark, tmp_path):
    (tmp_path / "none").write_bytes(b"")
    with pytest.raises(ValueError, match="vocabulary"):
        ModelTokens(spark, str(tmp_path / "none"), tokenizers.PATTERN)


def test_query_of_counts(spark, encoding):
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {f"source:{r['doc_id']}": len(encoding.encode_ordinary(r["text"] or "")) for r in texts}
    got = QUERIES["model_token_counts"](spark, SF).collect()
    assert {r.id: r.tokens for r in got} == want and len(got) == len(texts)
    assert all(abs(r.cost - want[r.id] * 0.15 / 1e6) < 1e-12 for r in got)


def test_query_of_chunks(spark, encoding):
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    count = lambda t: len(encoding.encode_ordinary(t))
    want = sorted((f"source:{r['doc_id']}", i, c) for r in texts for i, c in enumerate(plain(r["text"], 500, count)))
    assert sorted(map(tuple, QUERIES["chunks_by_model_tokens"](spark, SF).collect())) == want
