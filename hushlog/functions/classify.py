"""Row predicates and classes: line kinds, gap length, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlog.options import Options

# A line that continues a stack trace holds only white space, or opens with one of
# these after it (white space at the end of the line does not count).
_SPACE = "[\\x00-\\x20]"
TRACE_LINE = (
    f"^{_SPACE}*+(?:at (?s:.*[^\\x00-\\x20])|Caused by:|Suppressed:|\\.\\.\\.|\\z)"
)

# Message words that choose the gap length, first group that matches wins.
CHUNK_WORDS = ("chunk", "loading")
COORDINATE_WORDS = ("entity", "tick", "particle")
SAVE_WORDS = ("save", "world")

# Lowest number of each severity of the numeric log API.
NUMERIC_LEVELS = ((1000, "ERROR"), (900, "WARN"), (800, "INFO"), (500, "DEBUG"))

# Fixed value: the one level that is less specific than TRACE.
BEYOND_TRACE = "ALL"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_trace_line(line: Column) -> Column:
    """Blank-but-not-empty lines and lines that open like a frame, cause or ellipsis."""
    return F.coalesce((line != "") & line.rlike(TRACE_LINE), F.lit(False))


def is_exception(line: Column) -> Column:
    error = line.contains("Error") & (line.contains(".") | line.contains(":"))
    return F.coalesce(line.contains("Exception") | error, F.lit(False))


def is_trace_message(message: Column) -> Column:
    marks = ("Exception", "Error", "\tat ", "Caused by:")
    return F.coalesce(_any([message.contains(mark) for mark in marks]), F.lit(False))


def window_ms(message: Column, opts: Options) -> Column:
    """Gap length in ms, by the words in the raw message; null takes the general gap."""
    # lower() turns the dotted capital I into two characters, a plain i is wanted
    dotted = "İ"
    text = F.lower(
        F.when(message.contains(dotted), F.translate(message, dotted, "i")).otherwise(message)
    )

    def has(words: tuple[str, ...]) -> Column:
        return _any([text.contains(word) for word in words])

    return (
        F.when(has(CHUNK_WORDS), F.lit(opts.chunk_ms))
        .when(has(COORDINATE_WORDS), F.lit(opts.coordinates_ms))
        .when(has(SAVE_WORDS), F.lit(2 * opts.general_ms))
        .otherwise(F.lit(opts.general_ms))
    )


def threshold(level: Column, opts: Options) -> Column:
    """Rows of a burst that are let through, by severity."""
    return (
        F.when(level.isin("FATAL", "ERROR"), F.lit(opts.error_threshold))
        .when(level == "WARN", F.lit(opts.warn_threshold))
        .when(level == "INFO", F.lit(opts.info_threshold))
        .otherwise(F.lit(opts.debug_threshold))
    )


def level_name(value: Column) -> Column:
    named = None
    for lowest, name in NUMERIC_LEVELS:
        reached = value >= lowest
        named = F.when(reached, name) if named is None else named.when(reached, name)
    return F.when(value.isNotNull(), named.otherwise("TRACE"))
