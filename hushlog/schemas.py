"""Column names and Spark types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# How a record reached us; decides which routing steps apply.
STRUCTURED, NUMERIC, CONSOLE = "structured", "numeric", "console"

LOG_EVENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event_ms", T.LongType()),
        T.StructField("logger", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

RAW_LINE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_ms", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

# Records of one key form one sequence, ordered by ORDER.
KEY = ["logger", "level", "leader_template"]
ORDER = ["event_ms", "source", "seq"]
