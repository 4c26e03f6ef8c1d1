"""Kernel events over unbounded streams.

The state of a stream is its last values, its position and its last event, so
the step is the batch operator's definition, one frame at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(state: tuple[list[float], int, int | None], value: float, kernel: list[float], threshold: float, delay: int) -> tuple[tuple, bool]:
    """(values, position, last event) and a value -> next state, event or not."""
    values, pos, last = state
    values = [*values, value][-len(kernel) :]
    hit = len(values) == len(kernel) and None not in values and sum(a * b for a, b in zip(kernel, values, strict=True)) > threshold
    hit = hit and pos >= 2 and (last is None or pos > last + delay)
    return (values, pos + 1, pos if hit else last), hit


def event_filter_stream(frames: DataFrame, metric: str, kernel: list[float], threshold: float, delay: int = 0) -> DataFrame:
    """(stream_id, frame, pos, event) of a streaming DataFrame; frames of a micro-batch
    are taken in order of frame, across micro-batches in order of arrival."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, pos, last = state.get if state.exists else ([], 0, None)
        now = (list(values), pos, last)
        rows = []
        for r in pd.concat(list(parts)).sort_values("frame").itertuples():
            at = now[1]
            now, hit = step(now, r.value, kernel, threshold, delay)
            rows.append((key[0], r.frame, at, hit))
        state.update(now)
        yield pd.DataFrame(rows, columns=["stream_id", "frame", "pos", "event"])

    d = frames.select("stream_id", "frame", F.col(metric).cast("double").alias("value"))
    out = "stream_id string, frame bigint, pos bigint, event boolean"
    kept = "values array<double>, pos bigint, last bigint"
    return d.withColumn("stream_id", F.col("stream_id").cast("string")).groupBy("stream_id").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, size: str, late: str, time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts per event-time window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def write_idempotent(df: DataFrame, path: str, checkpoint: str):
    """Each micro-batch overwrites its own folder, so a repeated one changes nothing."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
