"""Structured Streaming: job status from a stream of events, windows with late data, conversation state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState


def read_table_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 8) -> DataFrame:
    """A table's files as a stream. ``path`` is a folder of Parquet files, or a pattern that names one file."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_status(events: DataFrame) -> DataFrame:
    """(command, status, events): each job's latest status by time, then event id."""
    return events.groupBy("command").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, status, n): events in tumbling windows; later than ``delay`` behind the stream they are late."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def run_to_end(result: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there now. Each batch's changed rows are written as a part of a table, again if the batch
    is tried again; the result is each key's row of the last batch. Nothing is held on the driver."""
    name, spark = f"{folder}/stream-{uuid.uuid4().hex}", result.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{name}/rows/batch={batch}")

    spark.createDataFrame([], result.schema).write.parquet(f"{name}/rows/batch=-1")
    result.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{name}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{name}/rows")
    values = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row")).select(*keys, "row.*")


def conversation_state(messages: DataFrame) -> DataFrame:
    """(conv_id, n, last_turn, last_role): messages are added to the state of their conversation, batch after batch."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, turn, role = state.get if state.exists else (0, -1, "")
        for b in batches:
            n += len(b)
            last = b.loc[b["turn"].idxmax()]
            if last["turn"] > turn:
                turn, role = int(last["turn"]), last["role"]
        state.update((n, turn, role))
        yield pd.DataFrame({"conv_id": [key[0]], "n": [n], "last_turn": [turn], "last_role": [role]})

    return messages.groupBy("conv_id").applyInPandasWithState(add, "conv_id long, n long, last_turn long, last_role string", "n long, last_turn long, last_role string", "update", "NoTimeout")
