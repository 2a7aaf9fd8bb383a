"""Helpers shared by the corpus operators.

Every operator names the columns it needs and selects only those, so extra
columns of the input, whatever their names, never clash with working columns.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words (ASCII white space) are those
#: that bytes.split() without an argument splits at.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch, and of what is broadcast at most where a table's size decides how it is joined.
BATCH_BYTES, BROADCAST_BYTES = 4 << 20, 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``.

    Only where the setting is missing and the session is a local one (tests) a
    temporary folder takes its place; a cluster without the setting is an error,
    because other machines could not read a folder of this one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    known = sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a file of a table of few columns holds at least, where a bound of its rows is known.
ROWS_A_FILE = 50_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, with column pruning and a known size,
    for what several later jobs read or what a loop goes on with. ``rows``: a bound of its rows, if known and if its last
    stage is light; a small table then has few files and tasks, whatever the number of shuffle partitions."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def is_held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches between Spark and Python hold about BATCH_BYTES, unless the session asks for another
    size than Spark's own: a worker's memory follows the batch, and texts may be long."""
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def tidy() -> None:
    """At the end of a task's work: gives freed memory back to the system, as Spark keeps its Python workers for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, by a scan that moves nothing but one sum for each task."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).alias("n")).first()["n"]


def only(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of these distinct ids. Ids of up to BROADCAST_BYTES, which are counted, are broadcast, so the rows stay where
    they are; more are joined by shuffle."""
    size = ids.agg(F.coalesce(F.sum(F.octet_length(F.col(id_col).cast("string")) + 24), F.lit(0))).first()[0]
    return rows.join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, id_col, "left_semi")


def keyed_columns(df: DataFrame, text_col: str) -> tuple[list[Column], int]:
    """All columns under names that clash with none, and the place of the text among them: rows go through a task whole, the text once."""
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)], df.columns.index(text_col)


def renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of keyed_columns() under their own names again."""
    return df.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)))


def squeezed(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with a binary column compressed row by row: for texts that are shuffled more than once."""
    names = rows.columns
    at = names.index(column)

    def squeeze(batches):
        import pyarrow as pa
        import zstandard

        to = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = [None if t is None else to.compress(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(small, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=names)
        tidy()

    return rows.mapInArrow(squeeze, rows.schema)


def unsqueezed(column):
    """The Arrow column as it was before squeezed()."""
    import pyarrow as pa
    import zstandard

    of = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else of.decompress(t) for t in column.to_pylist()], pa.binary())
