"""Count notices: which suppressed rows report, and what the notice says.

The count rule alone is a plain column.  With the time rule each report depends on the one before
it; ``report_chain`` finds them, and they are looked up by the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlog.functions import text
from hushlog.functions.checkpoints import stored
from hushlog.functions.classify import is_trace_message
from hushlog.options import Options
from hushlog.operators.cluster import BROADCAST_BYTES
from hushlog.operators.report_chain import reports_by_time
from hushlog.operators.traces import cleaned
from hushlog.schemas import CONSOLE, KEY

# Fixed value: longest message quoted in a notice.
NOTICE_CHARS = 100
# Fixed value: loggers with this prefix get no notice of their own.
CONSOLE_LOGGER_PREFIX = "System."


def mark_reports(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add ``report`` to decided rows: suppressed rows that emit a count notice.

    With ``opts.report_by_time`` jobs run when called: the rows are worked out once and written to
    the shared folder, and what follows reads the columns it needs from there.
    """
    if not opts.report_by_time:
        return df.withColumn("report", _by_count(opts))
    decided = stored(df.drop("report"), "decided")
    place = [*KEY, "life_no", "burst_no", "n"]
    told = reports_by_time(decided, opts).select(
        F.struct(*(F.col(c).cast(decided.schema[c].dataType).alias(c) for c in place)).alias("lookup"),
        F.lit(True).alias("report"),
    )
    # lengths of the texts plus a generous overhead per row
    row_bytes = sum((F.coalesce(F.octet_length(f"lookup.{c}"), F.lit(0)) for c in KEY), F.lit(128))
    size = told.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        told = F.broadcast(told)
    return (
        decided.withColumn("lookup", F.struct(*place))
        .join(told, "lookup", "left")
        .withColumn("report", F.coalesce("report", F.lit(False)))
        .drop("lookup")
    )


def _by_count(opts: Options):
    every = max(opts.show_count_after, 1)
    first = F.greatest(F.col("threshold") + 1, F.lit(every))
    due = (F.col("n") >= first) & ((F.col("n") - first) % every == 0)
    return ~F.col("allowed") & due


def next_reports(n: np.ndarray, ms: np.ndarray, every: int, wait_ms: int) -> np.ndarray:
    """Index of the report after each row if that row reports; len(n) when outside the run.

    ``n`` counts up by one and ``ms`` never falls, so a count jump is an offset and a time jump a
    binary search.
    """
    by_count = np.arange(len(n)) + every
    by_time = np.searchsorted(ms, ms + wait_ms, side="right")
    return np.minimum(np.minimum(by_count, by_time), len(n))


def first_report(
    n: np.ndarray, ms: np.ndarray, reported_n: int, reported_ms: int, every: int, wait_ms: int
) -> int:
    """Index of the first report of a run after a report at (reported_n, reported_ms)."""
    by_count = max(reported_n + every - int(n[0]), 0)
    by_time = int(np.searchsorted(ms, reported_ms + wait_ms, side="right"))
    return min(by_count, by_time, len(n))


def with_notice(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add ``text`` to marked rows: the notice a report shows, null where none is shown.

    Records of the log APIs get a shortened notice unless the switch is off; console notices stand
    in for the suppressed row, with stack traces cleaned, whatever the switch says.
    """
    is_console = F.col("kind") == CONSOLE
    suffix = text.suppressed_suffix(F.col("n"), F.col("duration_ms"))
    own = F.concat(
        F.lit("["),
        F.coalesce("logger", F.lit("null")),
        F.lit("] "),
        text.shorten(F.col("message"), NOTICE_CHARS),
        suffix,
    )
    message = F.when(is_trace_message(F.col("message")), cleaned(F.col("message"), opts)).otherwise(F.col("message"))
    silent = F.coalesce(F.col("logger").startswith(CONSOLE_LOGGER_PREFIX), F.lit(False))
    shown = (
        F.when(~F.col("report"), None)
        .when(is_console, F.concat(F.coalesce(message, F.lit("")), suffix))
        .when(F.lit(opts.show_notices) & ~silent, own)
    )
    return df.withColumn("text", shown)


def notices(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """One row per report that is shown, with its ``text``."""
    return (
        with_notice(df.filter("report"), opts)
        .filter(F.col("text").isNotNull())
        .select(
            "kind",
            "source",
            "seq",
            "event_ms",
            "logger",
            "level",
            F.col("leader_template").alias("template"),
            (F.col("n") - 1).alias("suppressed"),
            "duration_ms",
            "text",
        )
    )
