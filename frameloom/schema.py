"""Schemas of frames, detections and the clip catalog."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")])
LABELLED_BOX = T.StructType([T.StructField("label", T.StringType()), *BOX.fields])

FRAMES = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("origin", POINT),
        T.StructField("data", T.BinaryType()),
    ]
)
DETECTIONS = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("idx", T.IntegerType()), *LABELLED_BOX.fields, T.StructField("score", T.DoubleType())])
#: end_time is exclusive.
CLIP = (
    "clip_id bigint, video_name string, start_time int, end_time int, origin_x int, origin_y int, height int, width int,"
    " video_ref string, is_background boolean, translation array<struct<t:int,x:int,y:int>>, other string"
)

LABEL = "label string, clip_id bigint, video_name string"
BACKGROUND = "background_id bigint, clip_id bigint, video_name string"
TRACKS = "stream_id string, frame bigint, track_id bigint, x0 int, y0 int, x1 int, y1 int"
FRAME_RATE = 30.0
