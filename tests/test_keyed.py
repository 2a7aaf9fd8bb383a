import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=8)
    t.insert("first", spark.createDataFrame([(f"k{i}", f"name {i}", i) for i in range(40)], SCHEMA))
    return t


def rows(t):
    return {r.id: (r.name, r.n) for r in t.read().collect()}


def files(t):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{t.path}/rows") for f in names if f.endswith(".parquet")}


def test_merges_inserts_and_deletes(spark, table):
    want = {f"k{i}": (f"name {i}", i) for i in range(40)}
    assert rows(table) == want
    table.upsert("u", spark.createDataFrame([("k1", None, 100), ("new", "n", None), (None, "no key", 1)], SCHEMA))
    table.update("v", spark.createDataFrame([("k2", "two"), ("unknown", "x")], "id string, name string"))
    table.insert("i", spark.createDataFrame([("k3", "clash", 0), ("k40", "forty", 40)], SCHEMA))
    table.delete("d", spark.createDataFrame([("k4",), ("k4",), ("nobody",)], "id string"))
    want |= {"k1": ("name 1", 100), "new": ("n", None), "k2": ("two", 2), "k40": ("forty", 40)}
    del want["k4"]
    assert rows(table) == want


def test_only_touched_buckets_are_written(spark, table):
    before = files(table)
    table.upsert("one", spark.createDataFrame([("k7", "seven", 7)], SCHEMA))
    after = files(table)
    kept = [f for f in before if after.get(f) == before[f]]
    assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in kept}) == 1


def test_a_bucket_may_lose_all_its_rows(spark, table):
    table.delete("all", spark.createDataFrame([(f"k{i}",) for i in range(40)], "id string"))
    assert rows(table) == {}
    table.insert("again", spark.createDataFrame([("k0", "back", 1)], SCHEMA))
    assert rows(table) == {"k0": ("back", 1)}


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_failed_batch_is_repeated_once(spark, table, monkeypatch, when):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 40, 3)], "id string")
    more = lambda: table.change("more", keys, n=F.col("n") + 1)
    real = KeyedTable._replace

    def broken(self, staged):
        if when == "after":
            # Some buckets have been replaced when the writer is lost.
            real(self, staged.where("_bucket < 4"))
        raise OSError("lost")

    monkeypatch.setattr(KeyedTable, "_replace", broken)
    with pytest.raises(OSError):
        more()
    monkeypatch.setattr(KeyedTable, "_replace", real)
    want = {f"k{i}": (f"name {i}", i + (i % 3 == 0)) for i in range(40)}
    for _ in range(2):
        more()
        assert rows(table) == want
    assert not os.path.exists(f"{table.path}/_staged/more")


def test_batches_of_a_stream(spark, table):
    put = table.sink("stream", table.upsert)
    for _ in range(2):
        put(spark.createDataFrame([("k5", "five", 55)], SCHEMA), 0)
    put(spark.createDataFrame([("k5", None, 56)], SCHEMA), 1)
    put(spark.createDataFrame([("k5", "late repeat", 0)], SCHEMA), 0)
    assert rows(table)["k5"] == ("five", 56)
