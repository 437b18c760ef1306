"""Streams of frames: count windows, change sessions, running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "user_id long, session long, n long, mean_value double"
WINDOW = "user_id long, frame long, n long, sum_value double, max_value double"


def running_statistics(stream: DataFrame, key: str = "m") -> DataFrame:
    """Count, mean and sample variance per key; for the update or complete mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.var_samp("value").alias("var_value"))


def timed_counts(stream: DataFrame, width: str, late: str, key: str = "m") -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are dropped with
    their windows' state."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks know no other type
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n"))


def sliding_windows(stream: DataFrame, size: int) -> DataFrame:
    """Per frame the aggregate of it and the ``size - 1`` before; the state holds
    these values only. Frames of a user must come in order across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept = state.get if state.exists else (0, [])
        kept = list(kept)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for value in rows["value"]:
            seen += 1
            kept = [*kept, float(value)][-size:]
            out.append((key[0], seen, len(kept), sum(kept), max(kept)))
        state.update((seen, kept))
        yield pd.DataFrame(out, columns=["user_id", "frame", "n", "sum_value", "max_value"])

    return stream.groupBy("user_id").applyInPandasWithState(step, WINDOW, "seen long, kept array<double>", "append", GroupStateTimeout.NoTimeout)


def change_sessions(stream: DataFrame, threshold: float) -> DataFrame:
    """A session of a user goes on while a frame's value differs from the last one
    by no more than the threshold; a finished session is emitted when the next one
    begins. The state holds the open session's numbers and the last value: ``open_sessions``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, n, total, last = state.get if state.exists else (0, 0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for value in rows["value"].astype(float):
            if n and abs(value - last) > threshold:
                out.append((key[0], session, n, total / n))
                session, n, total = session + 1, 0, 0.0
            n, total, last = n + 1, total + value, value
        state.update((session, n, total, last))
        yield pd.DataFrame(out, columns=["user_id", "session", "n", "mean_value"]).astype({"n": "int64"})

    return stream.groupBy("user_id").applyInPandasWithState(
        step, SESSION, "session long, n long, total double, last double", "append", GroupStateTimeout.NoTimeout
    )


def open_sessions(state: DataFrame) -> DataFrame:
    """The sessions that ``change_sessions`` has not ended, from its state."""
    held = F.col("value.groupState")
    return state.select(F.col("key.user_id").alias("user_id"), held["session"].alias("session"), held["n"].alias("n"), (held["total"] / held["n"]).alias("mean_value")).where("n > 0")


def merged_frames(stream: DataFrame) -> DataFrame:
    """The best response per user, type and position over all frames so far."""
    return stream.groupBy("user_id", "m").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n_frames"))


def dispatched(commands: DataFrame, handlers: dict, checkpoint: str):
    """A command stream (value: ``name arguments``): each batch's rows go to their
    handler, a function of a DataFrame of arguments."""

    def run(batch: DataFrame, _: int) -> None:
        parsed = batch.select(F.substring_index(F.trim("value"), " ", 1).alias("command"), F.regexp_extract(F.trim("value"), r"^\S+\s*(.*)$", 1).alias("arguments"))
        for name, handler in handlers.items():
            handler(parsed.where(F.col("command") == name).select("arguments"))

    return commands.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
