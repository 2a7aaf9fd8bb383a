"""Tables that are changed by key: only the buckets that a batch touches are written again, and a batch counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import rows

BUCKET = "_bucket"


class KeyedTable:
    """A folder of Parquet files, one sub-folder for each bucket of keys.

    A batch has a name. It is worked out from the buckets that it touches into a staged table, which then replaces these
    buckets; then its name is noted. A batch that failed is repeated under its name: what was staged is used again, so a
    change that depends on the old rows is not made twice; a batch whose name is noted does nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self, key: Column) -> Column:
        return (F.crc32(key.cast("string").cast("binary")) % self.buckets).cast("int")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _all(self) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not self._exists(f"{self.path}/rows"):
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._all().where(F.col(self.key).isNotNull()).drop(BUCKET)

    def _apply(self, batch: str, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        done, staged = f"{self.path}/_done/{batch}", f"{self.path}/_staged/{batch}"
        if self._exists(f"{done}/_SUCCESS"):
            return
        if not self._exists(f"{staged}/_SUCCESS"):
            keyed = changes.where(F.col(self.key).isNotNull())
            touched = [r[0] for r in keyed.select(self._bucket(F.col(self.key))).distinct().collect()]  # at most as many as there are buckets
            old = self._all().where(F.col(BUCKET).isin(touched) & F.col(self.key).isNotNull()).drop(BUCKET)
            new = change(old, keyed).select(*self.schema.names).withColumn(BUCKET, self._bucket(F.col(self.key)))
            # A row without a key for each bucket, so that one which has lost all its rows is written, too.
            marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), BUCKET)
            new.unionByName(marks).repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").parquet(staged)
        self._replace(self.spark.read.schema(self._all().schema).parquet(staged))
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(done)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _replace(self, staged: DataFrame) -> None:
        staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")

    def upsert(self, batch: str, changes: DataFrame) -> None:
        """New keys are inserted; non-null columns of known ones replace what is there. Keys of ``changes`` are distinct."""
        wide = changes.select(*(F.col(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        self._apply(batch, wide, lambda old, new: rows.upsert_merge(old, new, self.key))

    def update(self, batch: str, changes: DataFrame) -> None:
        """As upsert(), but unknown keys are left out."""
        self._apply(batch, changes, lambda old, new: rows.update_merge(old, new, self.key))

    def insert(self, batch: str, new: DataFrame) -> None:
        """Rows of new keys; those of known keys are left out."""
        self._apply(batch, new, lambda old, fresh: rows.insert_ignoring_duplicates(old, fresh.select(*self.schema.names), self.key))

    def change(self, batch: str, keys: DataFrame, **values: Column) -> None:
        """The rows of these keys get values made of their old ones."""
        def changed(old: DataFrame, hit: DataFrame) -> DataFrame:
            marked = old.join(hit.select(self.key).distinct().withColumn("_hit", F.lit(True)), self.key, "left")
            return rows.update_where(marked, F.col("_hit"), **values)

        self._apply(batch, keys, changed)

    def delete(self, batch: str, ids: DataFrame) -> None:
        self._apply(batch, ids, lambda old, gone: rows.delete_ids(old, gone.select(self.key), self.key))

    def sink(self, name: str, write: Callable[[str, DataFrame], None]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch of the stream is one of the table, however often it is tried."""
        return lambda df, batch: write(f"{name}-{batch}", df)
