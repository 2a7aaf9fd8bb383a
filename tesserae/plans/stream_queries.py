"""Queries that run a stream over the tables to its end."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tesserae.operators.lineage import shared_folder, stored
from tesserae.plans.registry import query
from tesserae.sources.catalog import STATUS_OF_EVENT
from tesserae.streaming import jobs
from tesserae.streaming.memory import remembered, rocks_db


def _checkpoints(spark) -> str:
    """The shared folder of the session; a temporary one only in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stream-checkpoint-")


def _events(c):
    like = c.raw("events")
    s = jobs.read_table_stream(c.spark, f"{c.sf_dir}/events.parquet*", like)
    status = F.create_map(*(F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair))[F.col("event_type")]
    return s.select("event_id", "ts", F.concat(F.lit("command:"), (F.col("user_id") % 50).cast("string")).alias("command"), status.alias("status"))


@query("stream_latest_status", "SELECT command, max_by(status, (ts, event_id)) AS status, count(*) AS events FROM job_event GROUP BY command", "job_event")
def latest(c):
    return jobs.run_to_end(jobs.latest_status(_events(c)), _checkpoints(c.spark), ["command"])


@query("stream_hourly_counts", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, status, count(*) AS n FROM job_event GROUP BY ALL", "job_event")
def hourly(c):
    return jobs.run_to_end(jobs.windowed_counts(_events(c)), _checkpoints(c.spark), ["start", "status"]).select(F.unix_timestamp("start").alias("start"), "status", "n")


@query("conversation_messages", "SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles, max_by(text, turn) AS last FROM conversations GROUP BY conv_id")
def messages(c):
    # A conversation's turns are a bounded list; its texts stay out of it.
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return c.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.transform(turns, lambda x: x["role"]).alias("roles"), F.max_by("text", "turn").alias("last"))


@query("stream_conversation_state", "SELECT conv_id, count(*) AS n, max(turn)::BIGINT AS last_turn, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def state(c):
    like = c.raw("conversations")
    rows = jobs.read_table_stream(c.spark, f"{c.sf_dir}/conversations.parquet*", like).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
    return jobs.run_to_end(jobs.conversation_state(rows), _checkpoints(c.spark), ["conv_id"])


@query("stream_conversation_memory", "SELECT conv_id::VARCHAR AS thread, count(*) AS n, max(turn)::BIGINT AS last_turn, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history FROM conversations GROUP BY conv_id")
def memory(c):
    """All messages of each conversation, kept as state over four batches."""
    rows = c.raw("conversations").select(F.col("conv_id").cast("string").alias("thread"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(None).cast("timestamp").alias("at"))
    # Each conversation's turns are dealt to many files, a fourth of which make a batch, so most conversations are in several batches.
    files = max(4, int(c.spark.conf.get("spark.sql.shuffle.partitions")))
    parts = stored(rows.repartition(files, "thread", "turn"), "messages")
    a_batch = -(-len(parts.inputFiles()) // 4)
    with rocks_db(c.spark):
        out = jobs.run_to_end(remembered(jobs.read_table_stream(c.spark, parts._stored_at, parts, files=a_batch)), shared_folder(c.spark), ["thread"])
    return out.drop("expired")
