"""Operator 3: toxicity by noisy-channel deobfuscation.

A token that may be disguised (look-alike marks and digits, runs of one letter,
letters set apart by blanks, dots or hyphens) becomes a lattice of letters. A
Viterbi search takes the path that is likeliest under a character trigram model
and the channel's costs, the token itself among the paths. The restored tokens
are scored by the evidence of words and word beginnings in labelled texts, and a
logistic regression on a text's evidence gives the probability.

The character model counts all texts. Evidence and regression are fitted on a
bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import is_held_out, small_batches
from tesserae.llm.samples import labelled_sample

#: Letters that a mark or digit may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáãçéèêëíìîïñóòôöõúùûüÿæœß"
#: Classes of the character model: 0 is a word's edge, then the letters, then any other letter.
CLASSES = len(ALPHABET) + 2
_CLASS = {c: i + 1 for i, c in enumerate(ALPHABET)}
_OTHER = CLASSES - 1

#: Channel costs in natural logarithms: a look-alike, a letter dropped from a run, an unread mark, an unread look-alike
#: (which says that a letter was there), a joint.
COST_LOOK, COST_RUN, COST_MARK, COST_LETTER, COST_JOINT = 2.0, 0.7, 5.0, 10.0, 1.0
STRIP = ".,;:!?\"'()[]{}«»“”„…*$%&#|~`^_=<>-–—/\\"
#: What of a token's ends stands for no letter, and the runs of marks that may.
MARKS = re.compile(r"[^!|(<#*$]+").sub
FIRST_RUN, LAST_RUN = re.compile(r"(?:([!|(<#*$])\1*)?").match, re.compile(r"(?:([!|(<#*$])\1*)?\Z").search
DISGUISE = regex.compile(r"[0-9@$!|+(<€£*#._\-]|(.)\1\1")
TRIPLE = re.compile(r"(.)\1\1").search
#: What no word set apart is without; quick to look for.
MAYBE_SPACED = re.compile(r"(?<!\S)\S[\s._\-*]{1,2}\S[\s._\-*]{1,2}\S").search
SPACED = regex.compile(r"(?<![^\s])(?:\p{L}|[0-9@$!|+])(?:[\s._\-*]{1,2}(?:\p{L}|[0-9@$!|+])){2,}(?![^\s.,;:!?])")
BEGINNINGS = (4, 5, 6)
#: Characters of a text counted at once.
PART = 1 << 20


def char_table(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Natural log probabilities p(c | a, b) of letter classes, CLASSES cubed, smoothed, from all texts."""
    schema = T._parse_datatype_string("slot int, n long")
    small_batches(texts.sparkSession)
    lookup = np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        if chr(c).isalpha():
            lookup[c] = _CLASS.get(chr(c), _OTHER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    # Up to a million characters at once; the last two classes go on to the next part.
                    before = np.zeros(2, np.int64)
                    for at in range(0, len(text), PART):
                        codes = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                        last = [0] * (at + PART >= len(text))
                        x = np.concatenate([before, lookup[np.minimum(codes, 0xFFFF)], np.array(last, np.int64)])
                        # One edge between words, and a second where a word starts: its first letter has two edges before it.
                        total += np.bincount((np.where(x[1:-1] > 0, x[:-2], 0) * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
                        before = x[-2:]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=schema.names)

    found = texts.select(text_col).mapInArrow(count, schema).groupBy("slot").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    n[[r["slot"] for r in found]] = [r["n"] for r in found]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    single = (n.sum(axis=(0, 1)) + 0.1) / (n.sum() + 0.1 * CLASSES)
    pair = n.sum(axis=0)
    pair = (pair + 5 * single) / (pair.sum(axis=1, keepdims=True) + 5)
    return np.log((n + 5 * pair) / (n.sum(axis=2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float, int]]]:
    """For each place of the (lower-cased) token its arcs: letters read ('' for none), cost, next place."""
    return list(arcs(token))


def arcs(token: str) -> Iterator[list[tuple[str, float, int]]]:
    n, i = len(token), 0
    while i < n:
        c = token[i]
        run = 1
        while i + run < n and token[i + run] == c:
            run += 1
        out = []
        if c.isalpha():
            # A run of one letter is that letter, doubled, or as written.
            out = [(c, COST_RUN * (run > 1) * (1 + (run > 2) * -0.7), run)]
            if run > 1:
                out += [(c + c, COST_RUN * (run > 2) * 0.6, run)]
            if run > 2:
                out += [(c * run, 0.0, run)]
        else:
            out = [(x, COST_LOOK + 0.3 * (run - 1), run) for x in LOOKS_LIKE.get(c, "")]
            if c in LOOKS_LIKE and run == 2:
                out += [(x + x, 2 * COST_LOOK, run) for x in LOOKS_LIKE[c]]
            out += [("", COST_JOINT if c in "._- *" else (COST_MARK if c in "#|!" or c not in LOOKS_LIKE else COST_LETTER) * run, run)]
        yield [(x, cost, i + step) for x, cost, step in out]
        yield from ([] for _ in range(run - 1))
        i += run


def decode(token: str, table: np.ndarray, head: int = 0, tail: int = 0) -> str:
    """The likeliest word of a disguised token; of equal paths, the first in order of the words.
    The first ``head`` and the last ``tail`` characters are read as letters."""
    token = token.lower()
    n = len(token)
    # Words are linked lists of what was read, and places behind are let go: time and memory are linear in the token's length.
    best: dict[int, dict[tuple[int, int], tuple[float, tuple | None]]] = {0: {(0, 0): (0.0, None)}}
    for i, out in enumerate(arcs(token)):
        here = best.pop(i, None)
        if not here:
            continue
        if i < head or i >= n - tail:
            out = [x for x in out if x[0]]
        for (a, b), (score, word) in here.items():
            for letters, cost, j in out:
                s, x, y = score - cost, a, b
                for c in letters:
                    k = _CLASS.get(c, _OTHER)
                    s += float(table[x, y, k])
                    x, y = y, k
                there = best.get(j)
                if there is None:
                    there = best[j] = {}
                old = there.get((x, y))
                link = (word, letters) if letters else word
                if old is None or s > old[0] or (s == old[0] and spelt(link) > spelt(old[1])):
                    there[x, y] = (s, link)
    found = [(s + float(table[a, b, 0]), w) for (a, b), (s, w) in best.get(n, {}).items() if w]
    if not found:
        return token
    top = max(s for s, _ in found)
    return max(spelt(w) for s, w in found if s == top)


def spelt(word: tuple | None) -> str:
    out = []
    while word:
        word, letters = word
        out.append(letters)
    return "".join(reversed(out))


def ends(low: str, plain: str) -> list[tuple[str, str]]:
    """What may be letters before and after ``plain``: none of a token's look-alike marks there, the nearest run of them, or all."""
    if not plain or len(low) == len(plain):
        return [("", "")]
    at = low.find(plain)
    head, tail = (MARKS("", x) for x in (low[:at], low[at + len(plain) :]))
    return [(h, t) for h in dict.fromkeys(("", LAST_RUN(head)[0], head)) for t in dict.fromkeys(("", FIRST_RUN(tail)[0], tail))]


def readings(token: str, table: np.ndarray) -> list[str]:
    """What a token is scored as: the word within its marks and, if it may be disguised, the word restored."""
    low = token.lower()
    if low.isalpha() and not TRIPLE(low):
        return [low]
    plain = low.strip(STRIP)
    out = [plain] if plain else []
    if not (plain.isalpha() and len(plain) == len(low)):
        out += [decode(h + plain + t, table, len(h), len(t)) for h, t in ends(low, plain) if any(c.isalpha() for c in plain) and (h or t or not plain.isalpha() or TRIPLE(plain))]
    else:
        out.append(decode(low, table))
    return list(dict.fromkeys(x for x in out if x))


def spaced_words(text: str) -> list[str]:
    """Runs of single letters set apart by blanks or marks, joined."""
    if not MAYBE_SPACED(text):
        return []
    found = [regex.sub(r"[\s._\-*]", "", m) for m in SPACED.findall(text)]
    # A word of one letter may stand before or after.
    return [w for x in found for w in (x, x[1:], x[:-1])]


def word_score(word: str, table: np.ndarray) -> float:
    x = [0, 0, *(_CLASS.get(c, _OTHER) for c in word.lower()), 0]
    return float(sum(table[a, b, c] for a, b, c in zip(x, x[1:], x[2:], strict=False)))


def joined(spaced: str, table: np.ndarray) -> str:
    """Letters set apart as one word, or as one after or before a word of one letter, whichever is likeliest."""
    w = regex.sub(r"[\s._\-*]", "", spaced)
    ways = [[w], [w[0], w[1:]], [w[:-1], w[-1]]]
    return " ".join(max(ways, key=lambda words: sum(word_score(decode(x, table), table) for x in words)))


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "~" for n in BEGINNINGS if len(word) > n]]


def restored(text: str | None, table: np.ndarray) -> str | None:
    """The text with disguised tokens and words set apart replaced by what they are read as."""
    if not text:
        return text
    text = SPACED.sub(lambda m: joined(m[0], table), text)
    return regex.sub(r"\S+", lambda m: decode(m[0].lower().strip(".,;:?\"'"), table) if DISGUISE.search(m[0].lower().rstrip(STRIP)) and any(c.isalpha() for c in m[0]) else m[0], text)


def text_words(text: str, table: np.ndarray) -> set[str]:
    return {w for t in {*text.split(), *spaced_words(text)} for w in readings(t, table)}


class Memory(dict):
    """What tokens came to, cleared when full."""

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        made = self.make(token)
        if len(token) <= 64:
            self[token] = made
        return made


@dataclass
class ToxicityModel:
    table: np.ndarray
    counts: dict[str, tuple[int, int]]
    totals: tuple[int, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    memory: Memory | None = None
    known: dict | None = None

    def odds(self, feature: str, own: int | None = None) -> float:
        """Log odds of a feature; ``own`` leaves one text of that label out."""
        n = self.counts.get(feature)
        if n is None:
            return 0.0
        p, q = n[0] - (own == 1), n[1] - (own == 0)
        if p + q < 3:
            return 0.0
        return math.log((p + 0.2) / (self.totals[1] + 1)) - math.log((q + 0.2) / (self.totals[0] + 1))

    def strong(self) -> dict[str, float]:
        """The odds of the features that count, once all is known."""
        if self.known is None:
            self.known = {f: x for f in self.counts if (x := self.odds(f)) > 1.5}
        return self.known

    def word_odds(self, word: str, own: int | None = None) -> float:
        """A word's odds are those of its strongest feature: the word or one of its beginnings."""
        return max(self.odds(f, own) for f in features(word))

    def evidence(self, odds: Iterator[float]) -> np.ndarray:
        """(1, strongest, second strongest, how many are strong) of a text's words."""
        strong = sorted((x for x in odds if x > 1.5), reverse=True)
        strong += [0.0, 0.0]
        return np.array([1.0, strong[0], strong[1], math.log1p(sum(x > 4 for x in strong))])

    def text_odds(self, text: str, own: int) -> Iterator[float]:
        """The odds of a text's words, each token by its strongest reading."""
        found: dict[str, float] = {}
        for token in {*text.split(), *spaced_words(text)}:
            pairs = [(w, self.word_odds(w, own)) for w in readings(token, self.table)]
            if pairs:
                word, odds = max(pairs, key=lambda pair: pair[1])
                found[word] = odds
        return iter(found.values())

    def token_odds(self, token: str) -> tuple[tuple[str, float], ...]:
        strong = self.strong()
        found = [(w, max(strong[f] for f in fs)) for w in readings(token, self.table) if (fs := [f for f in features(w) if f in strong])]
        # Several readings of one token are not several words.
        return (max(found, key=lambda pair: pair[1]),) if found else ()

    def score(self, text: str | None) -> float:
        text = text or ""
        found: dict[str, float] = {}
        if self.memory is None:
            self.memory = Memory(self.token_odds)
        for pairs in map(self.memory.__getitem__, {*text.split(), *spaced_words(text)}):
            if pairs:
                found.update(pairs)
        z = float(self.evidence(found.values()) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 6000, least: int = 4, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The character model of all texts; evidence from at most ``per_class`` labelled training rows of each label.

    Features in at least ``least`` texts of label 1 are candidates; only they are counted in the texts of label 0.
    """
    spark = docs.sparkSession
    table = char_table(docs, text_col)
    sample = labelled_sample(docs, labels, label, per_class=per_class, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col)
    # Exact copies say no more than one text.
    rows = sample.where("text IS NOT NULL").groupBy("text", "y").agg(F.min("id").alias("id"), F.max("weight").alias("weight"))
    sent = spark.sparkContext.broadcast(table)

    def counted(which: DataFrame, known) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    found = {f for w in text_words(text.as_py(), sent.value) for f in features(w)}
                    n.update(found if known is None else found & known.value)
                if len(n) > 500_000:
                    yield pa.RecordBatch.from_pydict({"f": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})
                    n.clear()
            yield pa.RecordBatch.from_pydict({"f": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

        return which.select("text").mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    toxic, clean = rows.where("y = 1"), rows.where("y = 0")
    candidates = {r["f"]: r["n"] for r in counted(toxic, None).where(F.col("n") >= least).collect()}
    known = spark.sparkContext.broadcast(set(candidates))
    other = {r["f"]: r["n"] for r in counted(clean, known).collect()}
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    model = ToxicityModel(table, {f: (n, other.get(f, 0)) for f, n in candidates.items()}, (totals.get(0, 0), totals.get(1, 0)))
    model.counts = {f: n for f, n in model.counts.items() if model.odds(f) > 1.0}
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = [m.evidence(m.text_odds(t, y)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([list(r) for r in x], pa.list_(pa.float64()))], names=["y", "weight", "x"])

    found = sorted((tuple(r["x"]), r["y"], r["weight"]) for r in rows.select("text", "y", "weight").mapInArrow(evidence, "y int, weight double, x array<double>").collect())
    model.weights = logistic(np.array([x for x, _, _ in found], float).reshape(-1, 4), np.array([y for _, y, _ in found], float), np.array([c for _, _, c in found], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method, each row standing for ``counts`` rows; without both labels only the first (constant) weight, at the smoothed share."""
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:
        w[0] = math.log((counts @ y + 0.5) / (counts @ (1 - y) + 0.5))
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (y - p)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row; a null or empty text has no evidence and the score that goes with it.

    Texts are taken whole; repeated rows each give a row, an empty table none; a null id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), is_held_out(F.col(id_col), modulus, remainder).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = [m.score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=schema.names)

    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
