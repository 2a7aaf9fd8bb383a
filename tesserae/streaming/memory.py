"""Memory of conversations: messages are kept as state, batch after batch, until their thread has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = "thread string, n long, last_turn long, history string, expired boolean"


def history(messages: list[tuple[int, str, str]]) -> str:
    """A digest of the messages in the order of their turns."""
    return md5("\n".join(f"{role}: {text}" for _, role, text in sorted(messages)).encode()).hexdigest()


class Memory(StatefulProcessor):
    """A thread's messages as a list that grows by what is new: a turn that is there already stays as it is, so a batch that is
    tried again adds nothing. A timer of the stream's time ends the thread."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn long, role string, text string")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(int(t), str(r), str(x)) for t, r, x in self.messages.get()] if self.messages.exists() else []
        known, new, latest = {m[0] for m in held}, [], 0
        for batch in rows:
            for turn, role, text, at in zip(batch["turn"], batch["role"], batch["text"], batch["at"], strict=True):
                latest = max(latest, int(pd.Timestamp(at).timestamp() * 1000))
                if int(turn) not in known:
                    known.add(int(turn))
                    new.append((int(turn), role or "", text or ""))
        if new:
            self.messages.appendList(new)
        old = int(self.until.get()[0]) if self.until.exists() else 0
        end = latest + self.live_ms
        if end > old:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(end)
            self.until.update((end,))
        held += new
        yield pd.DataFrame({"thread": [key[0]], "n": [len(held)], "last_turn": [max(known)], "history": [history(held)], "expired": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.messages.clear()
        self.until.clear()
        yield pd.DataFrame({"thread": [key[0]], "n": [0], "last_turn": [-1], "history": [history([])], "expired": [True]})

    def close(self) -> None:
        pass


@contextmanager
def rocks_db(spark: SparkSession):
    """Lists and timers need this state store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _kept(messages: DataFrame) -> DataFrame:
    """remembered() without a time to live, as streaming plans without Python: a state of the turns that are known, and a state of
    each thread's messages, which the rows of the first state's new turns enter."""
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    new = messages.dropDuplicates(["thread", "turn"]).select("thread", message.alias("message"))
    # A thread that gets nothing new is in the batch's rows too; collect_list() leaves its null out.
    touched = messages.select("thread", F.lit(None).cast(new.schema["message"].dataType).alias("message"))
    held = new.unionByName(touched).groupBy("thread").agg(F.array_sort(F.collect_list("message")).alias("held"))
    lines = F.transform("held", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    digest = F.md5(F.array_join(lines, "\n").cast("binary"))
    return held.select("thread", F.size("held").cast("long").alias("n"), F.element_at("held", -1)["turn"].alias("last_turn"), digest.alias("history"), F.lit(False).alias("expired"))


def remembered(messages: DataFrame, live: str | None = None, live_ms: int | None = None) -> DataFrame:
    """(thread, n, last_turn, history, expired) of each thread that a batch changes: a stream of (thread, turn, role, text, at).

    Without a time to live the state stays; with ``live_ms`` a thread is forgotten once the watermark (``live`` behind the
    latest time ``at``) is that much later than its last message. Only that way needs Python, for its timers, and costs some calls
    to the state a thread and batch. Run it within rocks_db().
    """
    if not live_ms:
        return _kept(messages)
    messages = messages.withWatermark("at", live or "0 seconds")
    return messages.groupBy("thread").transformWithStateInPandas(Memory(live_ms), OUTPUT, "Update", "EventTime")
