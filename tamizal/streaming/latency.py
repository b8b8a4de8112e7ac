"""Streams: windowed latency, sessions, appended logs, the cache as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """Event time as a timestamp with zone, as watermarks need it; the watermark on streams."""
    typed = events.withColumn(at, F.col(at).cast("timestamp"))
    return typed.withWatermark(at, late) if events.isStreaming else typed


def windowed(events: DataFrame, at: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and greatest value by window and kind; events later than the watermark are dropped. Works on tables alike."""
    src = _timed(events, at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return src.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("w.start").alias("begins"), kind, "n", "total", "most")


def sessions(events: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no more than a gap apart."""
    src = _timed(events, at, late)
    return src.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def append_log(events: DataFrame, path: str, checkpoint: str, at: str = "ts") -> StreamingQuery:
    """Append a stream to a log partitioned by day, exactly once."""
    return events.withColumn("day", F.to_date(at)).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def cached_stream(asked: DataFrame, version: str = "1") -> DataFrame:
    """key, answer, hit and hits of each question (key, norm, answer) in order of arrival: the first of a norm is answered, later ones hit.

    State is kept by norm, so similar but differently worded questions don't meet here; that needs the batch lookup.
    """

    def run(norm: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        answer, hits = state.get if state.exists else (None, 0)
        for pdf in batches:
            out = []
            for key, given in zip(pdf["key"], pdf["answer"]):
                if answer is not None:
                    hits += 1
                    out.append((key, answer, True, hits))
                else:
                    answer = given
                    out.append((key, given, False, 0))
            yield pd.DataFrame(out, columns=["key", "answer", "hit", "hits"])
        if answer is not None:
            state.update((answer, hits))

    return asked.groupBy("norm").applyInPandasWithState(run, "key string, answer string, hit boolean, hits bigint", "answer string, hits bigint", "append", GroupStateTimeout.NoTimeout)
