"""An inverted index over several text columns, kept as tables, and ranked search in it.

``rows``      one row for each text: leg, row number, id, parent_id, title, length in tokens
``postings``  a row for each term and block of up to 128 texts of a leg: in how many of them it is, the most that it adds to a
              score, and for each of them its row, term frequency and length as arrays; a folder for each bucket of terms, in
              the order of term and block, so a search reads a few files' parts

A search reads the terms' blocks, which give document frequencies and, for each block, the most that any of its texts may
score. The best blocks give the first results; a block that can't reach the last of them is never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tesserae.functions.stem import stem
from tesserae.functions.text import TOKEN_BOUNDS, analyse
from tesserae.operators.lineage import stored

#: The customary parameters of BM25.
K1, B = 1.2, 0.75

#: Texts of a block (a power of two's exponent), and folders of terms.
BLOCK_BITS, BUCKETS = 7, 64

_TEXTS = "leg string, id string, parent_id string, title string, row long, len int, block long"
_BLOCKS = f"texts array<struct<{_TEXTS.replace(' string', ':string').replace(' long', ':long').replace(' int', ':int')}>>, leg string, block long, terms array<struct<term:string,ats:array<short>,tfs:array<int>>>"


def analysed(text: Column) -> Column:
    """The tokens of a text, null having none."""
    return F.array_remove(analyse(F.coalesce(text, F.lit(""))), "")


def _blocks(stemmed: bool, size: int) -> Callable:
    """Turns rows of leg, id, parent_id, title and tokens into rows of a block each, of up to ``size`` texts of one leg: the texts with
    their numbers and lengths, and the terms in them, each with its texts' places in the block and its counts there."""
    texts_type, leg_type, block_type, terms_type = (f.type for f in to_arrow_schema(_parse_datatype_string(_BLOCKS)))

    def cut(batches):
        block = TaskContext.get().partitionId() << 33 - size.bit_length() + 1
        for batch in batches:
            legs = batch.column(0).to_pylist()
            for first in range(0, len(legs), size):
                part = batch.slice(first, size)
                for leg in dict.fromkeys(legs[first : first + size]):
                    own = part.filter(pc.equal(part.column(0), leg))
                    yield one(own, leg, block)
                    block += 1

    def one(part, leg, block):
        n, tokens = part.num_rows, part.column(4)
        lengths = np.diff(tokens.offsets.to_numpy())
        coded = tokens.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if stemmed:
            known: dict[str, int] = {}
            of = np.array([known.setdefault(stem(w), len(known)) for w in words] or [0], np.int64)
            words, codes = list(known), of[codes]
        # By term, then by text.
        keys, counts = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
        offsets = pa.array(np.searchsorted(keys, np.arange(len(words) + 1) * n), pa.int32())
        term = terms_type.value_type
        ats = pa.ListArray.from_arrays(offsets, pa.array(keys % n, pa.int16())).cast(term[1].type)
        tfs = pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())).cast(term[2].type)
        terms = pa.StructArray.from_arrays([pa.array(words, pa.string()), ats, tfs], fields=list(term))
        rows = pa.array(np.arange(n) + block * size, pa.int64())
        texts = pa.StructArray.from_arrays([*part.columns[:4], rows, pa.array(lengths, pa.int32()), pa.array(np.full(n, block), pa.int64())], fields=list(texts_type.value_type))
        each = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values, type=kind)
        return pa.RecordBatch.from_arrays([each(texts, texts_type), pa.array([leg], leg_type), pa.array([block], block_type), each(terms, terms_type)], names=["texts", "leg", "block", "terms"])

    return cut


class TextIndex:
    """See the module. ``legs`` are (name, rows with id, parent_id and title, text column)."""

    def __init__(self, legs: list[tuple[str, DataFrame, str]], *, stemmed: bool = False, buckets: int = BUCKETS):
        self.stemmed, self.buckets, self.names = stemmed, buckets, [name for name, _, _ in legs]
        self.spark = legs[0][1].sparkSession
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Few large files would leave most cores without work.
        dealt = lambda rows: rows if rows.rdd.getNumPartitions() > parts else rows.repartition(parts)
        each = [dealt(rows.select("id", "parent_id", "title", F.col(text).alias("_text"))).select(F.lit(name).alias("leg"), F.col("id").cast("string"), F.col("parent_id").cast("string"), F.col("title").cast("string"), analysed(F.col("_text")).alias("tokens")) for name, rows, text in legs]
        united = reduce(DataFrame.unionByName, each)
        packed = stored(united.mapInArrow(_blocks(stemmed, 1 << BLOCK_BITS), _BLOCKS), "texts")
        self.rows = packed.select(F.inline("texts")).drop("block")
        # A row for each leg.
        self.legs = {r["leg"]: (r["n"], r["mean"]) for r in self.rows.groupBy("leg").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).collect()}
        lens = packed.select("leg", "block", F.col("texts.len").alias("all"), "terms").select("leg", "block", "all", F.inline("terms"))
        each = lens.select(self._bucket(F.col("term")).alias("bucket"), "term", "leg", "block", F.size("ats").alias("df"), "ats", "tfs", F.transform("ats", lambda i: F.get("all", i)).alias("lens"))
        most = F.array_max(F.zip_with("tfs", "lens", lambda tf, n: self._part(self.names, tf, n)))
        # By ranges, so a term of very many texts is in several files.
        self.postings = stored(each.withColumn("most", most).repartitionByRange(parts, "bucket", "term", "leg", "block").sortWithinPartitions("bucket", "term", "leg", "block"), "postings", ("bucket",))

    def _bucket(self, term: Column) -> Column:
        return (F.crc32(term.cast("binary")) % self.buckets).cast("int")

    def _part(self, legs: list[str], tf: Column | None = None, length: Column | None = None) -> Column:
        """What a posting adds to its text's score, but for the term's weight."""
        tf, length = F.col("tf") if tf is None else tf, F.col("len") if length is None else length
        mean = reduce(lambda so_far, leg: so_far.when(F.col("leg") == leg, F.lit(float(self.legs[leg][1] or 1.0))), [x for x in legs if x in self.legs], F.when(F.lit(False), F.lit(1.0)))
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

    def terms(self, words: str) -> list[str]:
        """The distinct terms of a search, cut like the texts. The expression is worked out while planning; no job runs."""
        found = self.spark.sql("SELECT 1").select(analysed(F.lit(words)).alias("t")).first()["t"]
        return list(dict.fromkeys(stem(t) if self.stemmed else t for t in found))

    def _of(self, table: DataFrame, terms: list[str], legs: list[str]) -> DataFrame:
        return table.where(F.col("bucket").isin([zlib.crc32(t.encode()) % self.buckets for t in terms]) & F.col("term").isin(terms) & F.col("leg").isin(legs)).drop("bucket")

    def scored(self, terms: list[str], legs: list[str], n: int | None = None) -> DataFrame:
        """(leg, row, score) of texts that hold all terms: all of them, or at least those of the ``n`` best results."""
        blocks = self._of(self.postings, terms, legs)
        # One row for each leg and term.
        df = {(r["leg"], r["term"]): (r["df"], r["blocks"]) for r in blocks.groupBy("leg", "term").agg(F.sum("df").alias("df"), F.count("*").alias("blocks")).collect()}
        legs = [leg for leg in legs if all((leg, t) in df for t in terms)]
        if not legs or not terms:
            return self.rows.select("leg", "row", F.lit(0.0).alias("score")).where("false")
        weight = F.lit(0.0)
        for leg in legs:
            for t in terms:
                k, all_rows = df[leg, t][0], self.legs[leg][0]
                weight = F.when((F.col("leg") == leg) & (F.col("term") == t), F.lit(float(np.log1p((all_rows - k + 0.5) / (k + 0.5))))).otherwise(weight)

        def sums(postings: DataFrame, part: Column, *by: Column | str) -> DataFrame:
            return postings.groupBy("leg", *by).agg(F.count("*").alias("_k"), F.sum(weight * part).alias("score")).where(F.col("_k") == len(terms)).drop("_k")

        size = 1 << BLOCK_BITS
        single = lambda found: found.select("leg", "term", "block", F.inline(F.arrays_zip("ats", "tfs", "lens"))).select("leg", "term", (F.col("block") * size + F.col("ats")).alias("row"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))
        postings, least = blocks, None
        if n is not None and sum(min(df[leg, t][1] for t in terms) for leg in legs) > 4 * n:
            bounds = sums(blocks, F.col("most"), "block").withColumnRenamed("score", "bound")
            in_blocks = lambda some: blocks.join(some.select("leg", "block"), ["leg", "block"], "left_semi")
            first = self._results(sums(single(in_blocks(bounds.orderBy(F.desc("bound")).limit(n))), self._part(legs), "row")).orderBy(F.desc("relevance")).limit(n)
            enough = first.agg(F.count("*").alias("k"), F.min("relevance").alias("least")).first()
            if enough["k"] == n:
                least = enough["least"] * (1 - 1e-9)
                postings = in_blocks(bounds.where(F.col("bound") >= least))
        found = sums(single(postings), self._part(legs), "row")
        # What scores less than as many results that are known is none of the best.
        return found if least is None else found.where(F.col("score") >= least)

    def _results(self, scored: DataFrame) -> DataFrame:
        return scored.join(self.rows.select("leg", "row", "id", "parent_id", "title"), ["leg", "row"]).where("id IS NOT NULL").groupBy("id", "parent_id", "title").agg(F.max("score").alias("relevance"))

    def search(self, words: str | list[str], n: int | None = None, legs: list[str] | None = None) -> DataFrame:
        """(id, parent_id, title, relevance): each result's best score among its texts in these legs, best first, ties by id. All
        terms must occur in a text. Words without a term find nothing."""
        terms = self.terms(words if isinstance(words, str) else " ".join(words))
        ranked = self._results(self.scored(terms, [x for x in legs or self.names if x in self.legs], n)).orderBy(F.desc("relevance"), "id")
        return ranked if n is None else ranked.limit(n)

    def create_function(self, name: str = "text_search") -> None:
        """Makes the search a table function of the session, to be called in FROM: name(words, match_count, sources, notes). Legs
        whose names begin with "note" are searched for notes, the others for sources. Only for an index without stems."""
        if self.stemmed:
            raise ValueError("SQL has no stems; use an index without them")
        for view, table in (("rows", self.rows), ("postings", self.postings)):
            table.createOrReplaceTempView(f"{name}_{view}")
        legs = [(leg, n, float(mean or 1.0)) for leg, (n, mean) in self.legs.items()]
        self.spark.createDataFrame(legs, "leg string, n long, mean double").createOrReplaceTempView(f"{name}_legs")
        terms = f"array_distinct(array_remove(transform(split(words, r'{TOKEN_BOUNDS}'), x -> lower(x)), ''))"
        near = f"array_contains(transform({terms}, x -> cast(crc32(cast(x AS binary)) % {self.buckets} AS int)), bucket)"
        asked = "if(leg LIKE 'note%', notes, sources)"
        self.spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION {name}(words STRING, match_count INT, sources BOOLEAN, notes BOOLEAN)
            RETURNS TABLE(id STRING, parent_id STRING, title STRING, relevance DOUBLE) RETURN
            SELECT id, parent_id, title, relevance FROM (
              SELECT id, parent_id, title, max(score) AS relevance, row_number() OVER (ORDER BY max(score) DESC, id) AS place FROM (
                SELECT p.leg, p.row, count(*) AS k, sum(ln(1 + (l.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * {K1 + 1} / (p.tf + {K1} * ({1 - B} + {B} * p.len / l.mean))) AS score
                FROM (SELECT leg, term, block * {1 << BLOCK_BITS} + x.ats AS row, x.tfs AS tf, x.lens AS len FROM (SELECT leg, term, block, explode(arrays_zip(ats, tfs, lens)) AS x FROM {name}_postings WHERE {near} AND array_contains({terms}, term) AND {asked})) AS p
                JOIN (SELECT leg, term, sum(df) AS df FROM {name}_postings WHERE {near} AND array_contains({terms}, term) AND {asked} GROUP BY leg, term) AS d ON d.leg = p.leg AND d.term = p.term
                JOIN {name}_legs AS l ON l.leg = p.leg
                GROUP BY p.leg, p.row
              ) AS s JOIN {name}_rows AS r ON r.leg = s.leg AND r.row = s.row
              WHERE k = size({terms}) AND id IS NOT NULL GROUP BY id, parent_id, title
            ) WHERE place <= match_count
        """)
