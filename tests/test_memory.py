import datetime as dt
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from tesserae.streaming.jobs import read_table_stream
from tesserae.streaming.memory import history, remembered, rocks_db

COLUMNS = ["thread", "turn", "role", "text", "at"]


def put(folder: Path, name: str, rows):
    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    table = {c: [r[i] for r in rows] for i, c in enumerate(COLUMNS[:4])} | {"at": pa.array([start + dt.timedelta(hours=r[4]) for r in rows], pa.timestamp("us", tz="UTC"))}
    pq.write_table(pa.table(table), folder / f"{name}.parquet")


def run(spark, tmp_path, batches, **how):
    """Each batch's rows, as they come."""
    folder, out = tmp_path / "in", []
    folder.mkdir()
    for i, rows in enumerate(batches):
        put(folder, f"part-{i}", rows)
        like = spark.read.parquet(str(folder))
        with rocks_db(spark):
            result = remembered(read_table_stream(spark, str(folder), like, files=1), **how)
            # The same log each time: a new run goes on with the state of the last.
            query = result.writeStream.foreachBatch(lambda df, _: out.append([tuple(r) for r in df.collect()])).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            query.awaitTermination()
    return out


def test_messages_are_added_over_batches_and_runs(spark, tmp_path):
    batches = [[("a", 0, "user", "hi", 0), ("b", 0, "user", "yo", 0)], [("a", 2, "user", None, 1), ("a", 1, "ai", "hello", 1)], [("a", 1, "ai", "again", 2), ("b", 1, None, "x", 2)]]
    out = [r for rows in run(spark, tmp_path, batches) for r in rows]
    all_a = [(0, "user", "hi"), (1, "ai", "hello"), (2, "user", "")]
    assert sorted(r for r in out if r[0] == "a") == sorted([("a", 1, 0, history(all_a[:1]), False), ("a", 3, 2, history(all_a), False), ("a", 3, 2, history(all_a), False)])
    assert ("b", 2, 1, history([(0, "user", "yo"), (1, "", "x")]), False) in out


def test_quiet_threads_are_forgotten(spark, tmp_path):
    hour = 3600 * 1000
    batches = [[("a", 0, "user", "hi", 0), ("b", 0, "user", "yo", 20)], [("b", 1, "ai", "on", 30)], [("a", 5, "user", "new", 40), ("b", 2, "ai", "z", 41)]]
    out = [r for rows in run(spark, tmp_path, batches, live_ms=24 * hour) for r in rows]
    assert [r for r in out if r[0] == "a"] == [("a", 1, 0, history([(0, "user", "hi")]), False), ("a", 0, -1, history([]), True), ("a", 1, 5, history([(5, "user", "new")]), False)]
    assert [r[1] for r in out if r[0] == "b"] == [1, 2, 3]


def test_without_a_time_to_live_no_thread_goes_to_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "part", [("a", 0, "user", "hi", 0)])
    stream = read_table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")))
    plans = [remembered(stream, live_ms=ms)._jdf.queryExecution().analyzed().toString() for ms in (None, 1000)]
    assert ["PySpark" in p for p in plans] == [False, True]


def test_many_turns_and_repeats_within_and_over_batches(spark, tmp_path):
    messages = [(f"t{i % 7}", i // 7, "user", f"text {i}") for i in range(300)]
    batches = [[(*m, 0) for m in messages[k::3] * 2] for k in range(3)] + [[(t, n, "ai", "later", 1) for t, n, _, _ in messages]]
    last = {r[0]: r for rows in run(spark, tmp_path, batches) for r in rows}
    for t in {m[0] for m in messages}:
        own = [m[1:] for m in messages if m[0] == t]
        assert last[t] == (t, len(own), max(m[0] for m in own), history(own), False)
