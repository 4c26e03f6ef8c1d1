"""A frame source with frame-range push-down.

Frames are generated (a square that moves two pixels a frame); a decoder takes
the generator's place: it is asked for frame ranges only, in parallel partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

DDL = "stream_id string, frame bigint, height int, width int, channels int, origin struct<x:int,y:int>, data binary"


class Range(InputPartition):
    def __init__(self, stream: str, frames: list[int]):
        self.stream, self.frames = stream, frames


def render(frame: int, height: int, width: int) -> np.ndarray:
    i = np.zeros((height, width, 3), np.uint8)
    x = (2 * frame) % max(1, width - 8)
    i[height // 2 - 4 : height // 2 + 4, x : x + 8] = 255
    return i


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.streams = options.get("streams", "video").split(",")
        self.height, self.width = int(options.get("height", 48)), int(options.get("width", 64))
        count, offset = int(options.get("frames", 100)), int(options.get("offset", 0))
        limit = int(options.get("limit", -1))  # an absolute frame number
        end = offset + count if limit < 0 else min(offset + count, limit)
        self.rows = list(range(offset, max(offset, end)))
        if "rows" in options:
            wanted = {int(r) for r in options["rows"].split(",")}
            self.rows = [r for r in self.rows if r in wanted]
        self.per_task = int(options.get("per_task", 50))

    def partitions(self) -> list[Range]:
        step = self.per_task
        return [Range(s, self.rows[k : k + step]) for s in self.streams for k in range(0, len(self.rows), step)] or [Range(self.streams[0], [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        origin = pa.array([{"x": 0, "y": 0}] * len(part.frames), pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        n = len(part.frames)
        cols = [pa.array([part.stream] * n), pa.array(part.frames, pa.int64()), *[pa.array([v] * n, pa.int32()) for v in (self.height, self.width, 3)], origin, pa.array([render(f, self.height, self.width).tobytes() for f in part.frames], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["stream_id", "frame", "height", "width", "channels", "origin", "data"])


class PushReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on frame decide what is decoded; Spark applies the others."""
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            test = tests.get(type(f))
            if test is not None and f.attribute == ("frame",):
                self.rows = [r for r in self.rows if test(r, f.value)]
            else:
                yield f


class SyntheticFrames(DataSource):
    """format("frames"): options streams, frames, offset, limit, rows, height, width, per_task.

    With the option pushdown filters on frame reach the decoder; Spark then keeps
    them with the loaded relation, so each query must load its own.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> Reader:
        return (PushReader if self.options.get("pushdown", "false") == "true" else Reader)(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SyntheticFrames)
