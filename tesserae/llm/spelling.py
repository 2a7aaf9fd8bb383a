"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered from the rarest to the most frequent of the
vocabulary. Its prefix is its three rarest bigrams (and all that are as frequent
as the third); its pivots are two disjoint ones of the prefix, the rarest pair,
chosen by dynamic programming. One edit destroys at most one of two disjoint
pivots. If the last bigram of s's prefix is not rarer than that of t's, what
remains of t's pivots in s is in s's prefix. So every pair meets where the pivots
of one word are looked up among the prefixes of the other.

Position limits make the lists short: the edit is on one side of a pivot that
remains, so the word's other side is unchanged, and that side is the key. Where
the edit falls, seen from the pivots p < q of t, decides what is looked up:

    left of p                  from p to the end
    right of q                 from the start to the end of q
    between, or inside of q    from the start to the end of p, and the last two letters
    between, or inside of p    from q to the end, and the first two letters
    inside of a pivot that is the word's end (or start): all but the last (first) three letters

Candidates are verified by edit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import remove, small_batches, tidy, written

#: What is lower-cased, and the letters of a word.
UPPER, LOWER, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "a-zÀ-ÿ"

#: Least length of words for which the keys above hold.
LEAST_LENGTH = 7


def noisy_words(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``min_length`` that occur ``min_count`` times, after every
    ``every``-th run by the hash of "id:run" has lost the letter at that hash modulo its length. A null text has none; a null id
    is written as nothing. Only deletions happen, so a shorter run can't become a word."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, lost).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _pivots(weight: list[int], prefix: list[int]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of the prefix whose weights add to the least: for each place the best bigram that ends before it."""
    best, at, out, least = None, 0, (0, 0), None
    for j in prefix:
        while at < len(prefix) and prefix[at] + 2 <= j:
            if best is None or weight[prefix[at]] < weight[best]:
                best = prefix[at]
            at += 1
        if best is not None and (least is None or weight[best] + weight[j] < least):
            least, out = weight[best] + weight[j], (best, j)
    return out


def _keys(word: str, place: dict[str, int], weight_of: dict[str, int]) -> tuple[int, list[str], list[str]]:
    """(place of the prefix's last bigram, keys under which the word is found, keys that its pivots look up)."""
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    places = [place[g] for g in grams]
    last = sorted(places)[2]
    prefix = [i for i, x in enumerate(places) if x <= last]
    p, q = _pivots([weight_of[g] for g in grams], prefix)
    first, end, n = word[:2], word[-2:], len(word)
    found = {x for i in prefix for x in ("a" + word[i:], "b" + word[: i + 2], f"c{word[: i + 2]} {end}", f"d{first} {word[i:]}")}
    found |= {x for m in (2, 3, 4) for x in ("e" + word[: n - m], "f" + word[m:])}
    asked = ["a" + word[p:], "b" + word[: q + 2]]
    inner_end, inner_start = n - q - 2 >= 2, p >= 2
    asked.append(f"c{word[: p + 2]} {end}" if inner_end else "e" + word[: n - 3])
    asked.append(f"d{first} {word[q:]}" if inner_start else "f" + word[3:])
    if not inner_end and not inner_start:
        asked.append(f"c{word[: p + 2]} {end}")
    return last, list(found), asked


def near_words(words: DataFrame) -> DataFrame:
    """(word, other), both ways: the words, each of LEAST_LENGTH letters or more and distinct, that are exactly one inserted,
    deleted or replaced letter apart. The bigrams of the letters are at most 90 squared, so their counts may be anywhere."""
    spark = words.sparkSession
    small_batches(spark)
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    counts = sorted((r["count"], r["gram"]) for r in grams.groupBy("gram").count().collect())
    place, weight_of = {g: i for i, (_, g) in enumerate(counts)}, {g: n for n, g in counts}

    def keys(batches):
        for batch in batches:
            all_words = batch.column(0).to_pylist()
            for at in range(0, len(all_words), 4096):
                kinds, names, owners, lasts = [], [], [], []
                for word in all_words[at : at + 4096]:
                    last, found, asked = _keys(word, place, weight_of)
                    kinds += [False] * len(found) + [True] * len(asked)
                    names += found + asked
                    owners += [word] * (len(found) + len(asked))
                    lasts += [last] * (len(found) + len(asked))
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(names), pa.array(owners), pa.array(np.array(lasts, np.int16))], names=["asks", "name", "word", "last"])
        tidy()

    rows = words.select("word").mapInArrow(keys, "asks boolean, name string, word string, last short").select("asks", F.xxhash64("name").alias("key"), "word", "last")
    rows = written(rows, "grams")
    found = rows.where("NOT asks").select("key", F.col("word").alias("other"), F.col("last").alias("other_last"))
    asked = rows.where("asks").select("key", "word", "last")
    fits = (F.col("last") <= F.col("other_last")) & (F.abs(F.length("word") - F.length("other")) <= 1) & (F.col("word") != F.col("other"))
    pairs = asked.join(found.hint("merge"), "key").where(fits & (F.levenshtein("word", "other", 1) == 1))
    pairs = pairs.select(F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))).alias("p"))
    return pairs.select("p.word", "p.other").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the paths are halved each round, and each step's word is ``ratio`` times as
    frequent as the one before, so a path has as many steps as a count has digits."""
    roots = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").limit(1).count():
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(roots)
        roots = after
    return roots.drop("moved")


def spelling_variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), which are distinct and of LEAST_LENGTH letters or more.

    ``form`` is the most frequent near word (ties: the smallest) if it is ``ratio`` times as frequent, else null; ``root`` is
    where the forms end, the word itself without any. An empty table gives none.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    known = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")))
    known = written(known.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "variants")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

