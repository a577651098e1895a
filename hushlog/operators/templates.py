"""Templates of messages and per-template statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlog.functions import classify
from hushlog.functions import template as tpl
from hushlog.options import Options


def with_template(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add ``template``: the message with volatile tokens replaced by wildcards."""
    return df.withColumn("template", tpl.template(F.col("message"), opts))


def with_window_class(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add ``window_ms``: the gap that ends a burst of this kind of message."""
    return df.withColumn("window_ms", classify.window_ms(F.col("message"), opts))


def with_threshold(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Add ``threshold``: rows of a burst let through at this severity."""
    return df.withColumn("threshold", classify.threshold(F.col("level"), opts))


def with_label(df: DataFrame) -> DataFrame:
    """Add ``label``: the printable form of the template key."""
    return df.withColumn("label", tpl.label(F.col("logger"), F.col("level"), F.col("template")))


def keyed(df: DataFrame, opts: Options = Options(), leaders: DataFrame | None = None) -> DataFrame:
    """Add template, gap length and the key template that groups near copies.

    ``leaders`` is the table of :func:`hushlog.operators.cluster.cluster_templates`; without it
    every template stands for itself.
    """
    return led(with_window_class(with_template(df, opts), opts), leaders)


def led(df: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """Add the key template to rows that have a template."""
    if leaders is None:
        return df.withColumn("leader_template", F.col("template"))
    from hushlog.operators.cluster import with_leader

    return with_leader(df, leaders)


def template_stats(df: DataFrame, top: int | None = None) -> DataFrame:
    """First seen, last seen and count per (logger, level, template).

    Partial aggregates are built before the shuffle, so a hot template costs one row per task.
    ``top`` keeps the most frequent templates.
    """
    stats = df.groupBy("logger", "level", "template").agg(
        F.min("event_ms").alias("first_ms"),
        F.max("event_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    if top is None:
        return stats
    return stats.orderBy(
        F.desc("n_rows"), "first_ms", "logger", "level", "template"
    ).limit(top)
