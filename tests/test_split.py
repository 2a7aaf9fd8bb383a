"""The splitter against an independent one, which states each chunk by sums instead of moving a window."""

import math
import re
from itertools import accumulate

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions.split import SEPARATORS, split, tokens
from tesserae.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def runs(text, size, length, at=0):
    """Runs of neighbouring parts shorter than a chunk, in order; parts are the pieces between the places where a separator begins."""
    while at < len(SEPARATORS) - 1 and SEPARATORS[at] not in text:
        at += 1
    mark = SEPARATORS[at]
    cuts = sorted({0, *(m.start() for m in re.finditer(re.escape(mark), text)), len(text)})
    run = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if length(text[a:b]) < size:
            run.append(text[a:b])
            continue
        yield run
        yield from ([[text[a:b]]] if mark == "" else runs(text[a:b], size, length, at + 1))
        run = []
    yield run


def plain(text, size, length=tokens, share=0.15):
    overlap, out = int(size * share), []
    for run in runs(text or "", size, length) if text else []:
        sums = [0, *accumulate(map(length, run))]
        first = 0
        while first < len(run):
            # The chunk ends before the first part that makes it too long; the next starts where what it takes along is short enough.
            end = next((e for e in range(first + 1, len(run)) if sums[e + 1] - sums[first] > size), len(run))
            out.append("".join(run[first:end]).strip())
            if end == len(run):
                break
            kept = lambda f: sums[end] - sums[f]  # noqa: B023, E731
            first = next(f for f in range(first, end + 1) if kept(f) <= overlap and (kept(f) == 0 or sums[end + 1] - sums[f] <= size))
    return [c for c in out if c]


def test_split_of_short_texts():
    assert split("") == [] and split(None) == [] and split(" \n ") == [] and split("short") == ["short"] and split(" two words\n") == ["two words"]


def test_split_by_hand():
    text = "one two three. four five six seven, eight nine\n\nten eleven\ntwelve"
    # Letters: 10 at most, 2 of them again in the next chunk; a separator stays at the head of what follows.
    got = split(text, 10, 2, len)
    assert got == ["one two", "three", ". four", "five six", "seven", ", eight", "nine", "ten", "eleven", "twelve"]


def test_split_by_hand_overlaps():
    # Each word is a token: 1.3 rounded down; chunks of 5 share int(5 * 0.4) = 2.
    assert split("a b c d e f g h i j", 5, 2) == ["a b c d e", "d e f g h", "g h i j"]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.sampled_from(["word", "a", "b.", "c,\n", "\n\n", "\n", " ", "、", "。x", "\u200b", "long" * 5, "é"]), max_size=120),
    st.sampled_from([" ", ""]), st.integers(2, 40), st.sampled_from([len, tokens, lambda x: math.ceil(len(x.encode()) / 3)]),
)
def test_split_equals_the_independent_one(parts, glue, size, length):
    text = glue.join(parts)
    assert split(text, size, length=length) == plain(text, size, length)


def test_all_texts_and_letters_are_in_the_chunks():
    text = ("x" * 1000 + " ") * 3 + "end"
    for size in (2, 7, 100):
        out = split(text, size, 0, len)
        assert "".join("".join(out).split()) == "".join(text.split()) and max(map(len, out)) <= size


def test_query_equals_the_independent_splitter(spark):
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted((f"source:{r['doc_id']}", i, c) for r in texts for i, c in enumerate(plain(r["text"], 500)))
    assert sorted(map(tuple, QUERIES["recursive_chunks"](spark, SF).collect())) == want and any(i > 2 for _, i, _ in want)
