"""Built-in streaming aggregates: bursts per key and running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlog.functions import classify
from hushlog.options import Options
from hushlog.schemas import KEY


def burst_summary(keyed: DataFrame, opts: Options = Options(), delay: str = "10 seconds") -> DataFrame:
    """Start, end, rows and suppressed rows of each burst, as session windows.

    Each row's own gap holds, so the result equals the batch bursts when all rows of a key share
    one gap (near copies not merged).  Works on static tables too.
    """
    gap = F.least(F.col("window_ms"), F.lit(opts.idle_ms)).cast("string")
    bursts = (
        keyed.withColumn("gap", F.concat(gap, F.lit(" milliseconds")))
        .withWatermark("event_ts", delay)
        .groupBy(*KEY, F.session_window("event_ts", F.col("gap")))
        .agg(
            F.min("event_ms").alias("first_ms"),
            F.max("event_ms").alias("last_ms"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
    over = F.col("n_rows") - classify.threshold(F.col("level"), opts)
    return bursts.withColumn("suppressed", F.greatest(over, F.lit(0)).cast("long")).drop(
        "session_window"
    )


def stream_stats(
    decided: DataFrame, *by: str, every: str = "1 minute", delay: str = "10 seconds"
) -> DataFrame:
    """Processed and suppressed rows per time slice (and ``by``) of a stream of decisions."""
    return (
        decided.withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", every), *by)
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(~F.col("allowed")).alias("suppressed"),
        )
        .select(F.unix_millis("window.start").alias("slice_ms"), *by, "processed", "suppressed")
    )
