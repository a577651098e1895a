"""The log that survives, and suppression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlog.operators.bursts import burst_table
from hushlog.operators.reports import with_notice
from hushlog.operators.route import DENY, passed
from hushlog.options import Options
from hushlog.schemas import CONSOLE, STRUCTURED

OUTPUT = ["kind", "source", "seq", "event_ms", "logger", "level", "message"]


def deduplicated(marked: DataFrame, routed: DataFrame, opts: Options = Options()) -> DataFrame:
    """Passed rows, allowed rows and notices.

    ``marked`` holds the checked rows with ``allowed`` and ``report``; ``routed`` the whole log.
    A console notice keeps the place of its row, other notices come from the notice logger.
    """
    shown = with_notice(marked.filter("allowed OR report"), opts).filter(
        F.col("allowed") | F.col("text").isNotNull()
    )
    own = ~F.col("allowed") & (F.col("kind") != CONSOLE)
    changed = {
        "kind": F.when(own, STRUCTURED).otherwise(F.col("kind")),
        "logger": F.when(own, opts.notice_logger).otherwise(F.col("logger")),
        "level": F.when(own, "INFO").otherwise(F.col("level")),
        "message": F.when(F.col("allowed"), F.col("message")).otherwise(F.col("text")),
    }
    kept = shown.select([changed.get(name, F.col(name)).alias(name) for name in OUTPUT])
    return passed(routed).select(OUTPUT).unionByName(kept)


def _rates(processed: Column, suppressed: Column) -> list[Column]:
    rate = F.when(processed > 0, suppressed * 100.0 / processed).otherwise(F.lit(0.0))
    return [processed.alias("processed"), suppressed.alias("suppressed"), rate.alias("rate_pct")]


def suppression_stats(decided: DataFrame, *by: str) -> DataFrame:
    """Processed and suppressed rows and the rate in percent, overall or per ``by``."""
    totals = decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("allowed")).alias("held")
    )
    return totals.select(*by, *_rates(F.col("rows"), F.col("held")))


def suppression_totals(checked: DataFrame, *by: str, opts: Options = Options()) -> DataFrame:
    """Like :func:`suppression_stats`, from keyed rows and without deciding each row.

    A burst of ``c`` rows suppresses ``c - threshold`` of them, so burst counts are enough.  ``by``
    may name key columns.
    """
    totals = burst_table(checked, opts).groupBy(*by).agg(
        F.sum("n_rows").alias("rows"), F.sum("suppressed").alias("held")
    )
    rows, held = F.coalesce("rows", F.lit(0)), F.coalesce("held", F.lit(0))
    return totals.select(*by, *_rates(rows, held))


def route_stats(routed: DataFrame, *by: str) -> DataFrame:
    """Rows per route; rows of deny-listed loggers are in no other counter."""
    return routed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("route") == "check").alias("processed"),
        F.count_if(F.col("route") == DENY).alias("denied_by_list"),
    )
