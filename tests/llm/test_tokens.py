import zlib
from collections import defaultdict
from random import Random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesserae.llm.packing import best_fit, pack, token_pieces
from tesserae.llm.token_counts import count_tokens, load_vocabulary
from tesserae.llm.wordbpe import IdReader, MergeCounter, _Reader

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello   World", "it's they'll WE'RE don't", "12345 3.14", "naïve café ÉCOLE école", "ΣΑΣ ΟΔΟΣ İstanbul",
    "<|endoftext|> a<|startoftext|>b<|endoftext|>", "<|endoftext", "a\x1cb \x1f c\x85d e　f", "🎉🎉 日本語 テキスト한국어", "á ́b",
    "x" * 3000, "ab" * 2000 + "!" * 500, "\x00\x01\x02 \t\n", "the the the the", "the the the the",
]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(PATH))


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_counts_are_the_librarys(spark, vocabulary, library):
    got = {r.doc_id: r for r in count_tokens(docs(spark), vocabulary, limit=3).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 3), t


def test_counts_and_ids_on_real_documents(spark, vocabulary, library):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(d, vocabulary).collect()}
    ids = defaultdict(dict)
    for r in token_pieces(d, vocabulary, with_ids=True, max_tokens=100).collect():
        ids[r.doc_id][r.piece] = r.ids
    for r in d.collect():
        want = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == len(want)
        assert [x for k in sorted(ids[r.doc_id]) for x in ids[r.doc_id][k]] == [*want, 1]


def test_empty_tables(spark, vocabulary):
    assert count_tokens(docs(spark).limit(0), vocabulary).count() == 0
    assert pack(docs(spark).limit(0), vocabulary).count() == 0


def check_packing(rows, max_tokens):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= max_tokens
    return len(by)


def test_packing_keeps_every_token(spark, vocabulary, library):
    rows = pack(docs(spark), vocabulary, max_tokens=64, group_pieces=8).collect()
    check_packing(rows, 64)
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // 64)):
            part = ids[64 * k : 64 * k + 64]
            r = pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (64 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not pieces


def test_packing_is_tight(spark, vocabulary):
    rows = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), vocabulary).collect()
    n = check_packing(rows, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    sequence, offset = best_fit(lengths, np.array([100.0, 5, 4000]), np.ones(3), rule)
    for s in set(sequence):
        mine = lengths[sequence == s]
        assert mine.sum() <= 100 and len(mine) <= 5 and ((mine.astype(float) ** 2).sum() <= 4000 or len(mine) == 1)
        o = np.sort(offset[sequence == s])
        assert o[0] == 0 and len(set(o)) == len(o)


def test_a_word_is_remembered_once(vocabulary, library):
    of = IdReader(vocabulary)
    for text in ["word", "Word, WORD. word", "été", "Été! été"]:
        assert np.frombuffer(of.read(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    assert {"word", "été"} <= set(of.chunks) and not {"word", "été"} & set(of.pieces)


@pytest.mark.parametrize("limit", [20, 1000])
def test_ids_and_counts_whatever_is_remembered(vocabulary, library, limit, monkeypatch):
    monkeypatch.setattr(_Reader, "LIMIT", limit)
    ids, count, random = IdReader(vocabulary), MergeCounter(vocabulary), Random(3)
    letters = [*"abcABÉéßΣσςİıK.,;!?'-<|> \t\n\x1c 1", "́", "̇", "é", "É", "ᄀ", "ᅡ", "Ω", "日", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(random.choices(letters, k=random.randint(0, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(ids.read(text), np.uint32).tolist(), count.read(text)) == (want, len(want)), text
