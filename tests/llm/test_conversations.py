import hashlib
import random
import zlib

import pytest

from tesserae.llm.conversations import conversation_trie, prefix_trie


def rebuild(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in by.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def found(trie):
    return sorted((tuple(r) for r in trie.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("seed", "longest"), [(1, 1), (2, 8), (3, 21)])
def test_against_brute_force(spark, seed, longest):
    r = random.Random(seed)
    rows = []
    for c in [c for c in range(60) if c % 7 != 5] + [1000, 1002, 123456789012]:
        ts = r.sample(range(50), r.randrange(1, longest + 1))
        rows += [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(["a", "é" * 3, None, "long text " * 20])) for t in ts]
    rows += [(7, None, "system", "first"), (None, 1, "user", "no conversation")]
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, name string, depth int")
    assert found(conversation_trie(table.repartition(5))) == brute(rebuild(rows))


def test_sequences_as_they_are(spark):
    # Copies, one long sequence, and one without a turn.
    seqs = {c: [("u", "x")] * 3 for c in range(40)} | {100: [("u", str(i % 3)) for i in range(70)], 101: [("u", str(i % 3)) for i in range(64)], 102: []}
    turns = [(c, i + 1, repr(t).encode().ljust(16, b".")[:16], len(t[1])) for c, s in seqs.items() for i, t in enumerate(s)]
    lengths = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "conv long, length long")
    got = prefix_trie(spark.createDataFrame(turns, "conv long, place long, turn binary, bytes long"), lengths)
    assert found(got) == brute(seqs)


def test_only_conversations_without_turns_and_none(spark):
    # c = 1 is rebuilt from h turns of an absent conversation and its own after h.
    assert zlib.crc32(b"1") % 9 > 0
    rows = [(1, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(conversation_trie(table)) == brute(rebuild(rows)) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert found(conversation_trie(table.limit(0))) == []


def test_repeated_rows_and_a_very_long_text(spark):
    rows = [(c, 1, "user", "w" * 2_000_000) for c in (0, 1, 2)] + [(0, 1, "user", "w" * 2_000_000), (0, 2, "assistant", "end")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(conversation_trie(table)) == brute(rebuild(rows))
