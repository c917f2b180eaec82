"""Streaming: session events from a folder of JSON lines, keyed state, and a pending queue.

State is kept per session by ``applyInPandasWithState``: reads since the last index query (the
streak), edited files and counts.  Sessions end by an explicit event; summaries are recomputed by
key in ``foreachBatch``, so replays change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import SCHEMAS


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["session_events"]).option("maxFilesPerTrigger", per_trigger).json(path).where("e is not null and session is not null")


_OUT = "session string, seq long, streak int, reads int, edits int, nudge boolean"
_STATE = "streak int, reads int, edits int, last long"


def session_state(events: DataFrame, limit: int = 3) -> DataFrame:
    """One row a read: the session's streak and counts so far, and whether it is told to query the
    index (at the limit and twice the limit).  Events of a session come in ``seq`` order within a
    batch; an event that was seen before is dropped."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, reads, edits, last = state.get if state.exists else (0, 0, 0, -1)
        rows = []
        for r in pd.concat(list(parts)).sort_values("seq", kind="stable").itertuples():
            if r.seq <= last:
                continue
            last = int(r.seq)
            if r.e == "mcp":
                streak = 0
            elif r.e == "edit":
                edits += 1
            elif r.e == "read":
                streak, reads = streak + 1, reads + 1
                rows.append((key[0], last, streak, reads, edits, streak in (limit, 2 * limit)))
        state.update((streak, reads, edits, last))
        yield pd.DataFrame(rows, columns=["session", "seq", "streak", "reads", "edits", "nudge"])

    return events.groupBy("session").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")


def windowed_tokens(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Tokens and events by kind in windows of event time; later events than the watermark go."""
    at = events.withColumn("at", F.timestamp_seconds("ts"))
    return at.withWatermark("at", late).groupBy(F.window("at", width), "e").agg(F.count("*").alias("n"), F.sum(F.coalesce("tok", F.lit(0))).alias("tokens"))


def pending_sink(path: str):
    """foreachBatch body: the files of a batch, each once, replace the same batch's earlier output."""

    def run(df: DataFrame, epoch: int) -> None:
        df.where("f is not null").groupBy("f").agg(F.min("ts").alias("since")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return run


def run_available(stream: DataFrame, checkpoint: str, table: str, mode: str = "append"):
    """Everything there is now, into a memory table: a look at a small stream (the driver holds it)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def write_available(stream: DataFrame, path: str) -> DataFrame:
    """Everything there is now, written as Parquet under ``path`` (with the checkpoint beside it)."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def summaries_sink(path: str):
    """foreachBatch body: sessions that a stop event of the batch ends are distilled anew from all their
    events and replace what was written for them (a repeated batch writes the same)."""
    from ..operators.sessions import distill

    def run(df: DataFrame, epoch: int) -> None:
        ended = df.where(F.col("e").isin("stop", "session-end")).select("session").distinct()
        own = df.join(ended, "session", "left_semi")
        distill(own, "session", "seq", "e", "text", "f").withColumn("batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return run
