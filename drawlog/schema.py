"""Table schemas of the draw log and of captured vector assets."""

from __future__ import annotations

from pyspark.sql import types as T

COMMAND = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("args", T.ArrayType(T.DoubleType())),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("frame_id", T.StringType()),
        T.StructField("canvas_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("path_id", T.StringType()),
        T.StructField("command", COMMAND),
        T.StructField("args", T.ArrayType(T.DoubleType())),
        T.StructField("transform", T.ArrayType(T.DoubleType())),
        T.StructField("fill_style", T.StringType()),
        T.StructField("stroke_style", T.StringType()),
        T.StructField("line_width", T.DoubleType()),
        T.StructField("fill_rule", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

VECTOR_ASSET = T.StructType(
    [
        T.StructField("svgId", T.StringType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("shapes", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("markup", T.StringType()),
    ]
)

SURFACE = ["session_id", "frame_id", "canvas_id"]
FRAME = ["session_id", "frame_id"]
PATH = ["session_id", "frame_id", "path_id"]

# Limits of the event format.
MAX_SESSION_EVENTS = 250_000
MAX_BATCH_BYTES = 2_000_000
MAX_BATCH_EVENTS = 100
MAX_PAINTS = 5_000
MAX_SEED_BYTES = 500_000
MAX_MARKUP_BYTES = 2_000_000
MAX_ASSET_SHAPES = 100_000
MIN_LISTED_EDGE = 16.0
DEFAULT_FRAME = "main"
DEFAULT_CANVAS = "canvas-unknown"
