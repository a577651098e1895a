"""Application-log records from the supported log APIs, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlog.functions.classify import level_name
from hushlog.functions.text import fill_placeholders
from hushlog.schemas import LOG_EVENT, NUMERIC, STRUCTURED


def to_log_events(df: DataFrame, kind: str, message: Column, level: Column) -> DataFrame:
    """Shape a table with ``source, seq, event_ms, logger`` as LogEvent rows."""
    values = {
        "kind": F.lit(kind),
        "event_ts": F.timestamp_millis("event_ms"),
        "message": message,
        "level": level,
    }
    return df.select(
        [
            values.get(field.name, F.col(field.name)).cast(field.dataType).alias(field.name)
            for field in LOG_EVENT.fields
        ]
    )


def from_structured(
    df: DataFrame,
    message: str | Column = "message",
    params: str | Column | None = None,
    untyped: bool = False,
) -> DataFrame:
    """Structured log records; ``{}`` placeholders are filled from an array of parameters.

    ``untyped`` is for message objects that were turned into text: null prints as ``null``.
    """
    text = F.col(message) if isinstance(message, str) else message
    if params is not None:
        text = fill_placeholders(text, F.col(params) if isinstance(params, str) else params)
    elif untyped:
        text = F.coalesce(text.cast("string"), F.lit("null"))
    else:
        text = F.coalesce(text, F.lit(""))
    return to_log_events(df, STRUCTURED, text, F.col("level"))


def from_numeric_level(df: DataFrame, level_value: str = "level_value") -> DataFrame:
    """Records with numeric severities; null or empty messages stay as they are and pass."""
    return to_log_events(df, NUMERIC, F.col("message"), level_name(F.col(level_value)))


def union_sources(*dfs: DataFrame) -> DataFrame:
    """One log from many sources; ``source`` keeps them apart, keys are shared."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
