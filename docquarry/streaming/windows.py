"""Event-time windows, a stateful rate limiter, and an index that grows by a stream."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from docquarry.operators.chunks import dedup


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on a stream as on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", every: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by type in windows of ``width`` that begin every ``every``; works on a stream as on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width, every), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user with less than ``gap`` between them, as one session each; works on a stream as on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))


def limit_calls(calls: DataFrame, most: int, seconds: float) -> DataFrame:
    """``calls(user_id, event_id, at)`` with ``accepted``: fewer than ``most`` accepted calls in the last ``seconds``.

    Partitions are sorted and read as a stream: memory holds the accepted calls of one window of one user.
    """

    def run(frames):
        user, held = None, deque()
        for f in frames:
            flags = []
            for u, at in zip(f.user_id, f["at"], strict=True):
                if u != user:
                    user, held = u, deque()
                while held and held[0] <= at - seconds:
                    held.popleft()
                flags.append(len(held) < most)
                if flags[-1]:
                    held.append(at)
            yield pd.DataFrame({"user_id": f.user_id, "event_id": f.event_id, "accepted": flags})

    dealt = calls.select("user_id", "event_id", "at").repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return dealt.mapInPandas(run, "user_id long, event_id long, accepted boolean")


def limit_stream(calls: DataFrame, most: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """The limiter on a stream of ``calls(user_id, event_id, ts)``: a user's accepted times of one window are its state.

    Within a micro-batch calls go in order of time; one that is older than accepted ones counts those before it only.
    """

    def run(key, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        flags = []
        for at in rows["at"]:
            held = [t for t in held if t > at - seconds]
            flags.append(len(held) < most)
            if flags[-1]:
                held.append(at)
        state.update((held,))
        yield pd.DataFrame({"user_id": rows.user_id, "event_id": rows.event_id, "accepted": flags})

    timed = calls.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    keyed = timed.select("user_id", "event_id", F.col("ts").cast("double").alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, accepted boolean", "held array<double>", "append", "NoTimeout")


def append_new(batches: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Append the documents of a stream whose content hash is not yet in the index (a Parquet folder) or earlier in the batch.

    A batch that is run again after a failure finds its own rows in the index and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hashed = dedup(batch).join(batch.select("doc_id", "text"), "doc_id").select("hash", "doc_id", "text").dropDuplicates(["hash"])
        try:
            known = spark.read.schema("hash string, doc_id long, text string").parquet(index)
        except AnalysisException:  # the first batch
            known = hashed.limit(0)
        hashed.join(known.select("hash"), "hash", "left_anti").write.mode("append").parquet(index)

    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
