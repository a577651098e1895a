"""Routing: which records are checked, passed on unchecked, or dropped outright."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlog.functions.classify import BEYOND_TRACE
from hushlog.options import Options
from hushlog.schemas import CONSOLE, NUMERIC, STRUCTURED

PASS, DENY, CHECK = "pass", "deny", "check"

# A list of loggers up to this size is sent to every task; a longer one is joined by shuffle.
LIST_BYTES = 64 << 20


def _with_listed(df: DataFrame, names: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """``df`` with a flag column of a free name, and that flag; None without any name on the list.

    A null logger is on no list, and a null on a list names none.
    """
    if names is None:
        return df, None
    taken = {column.lower() for column in df.columns}
    name, flag = "listed_logger", "is_listed"
    while name in taken or flag in taken:
        name, flag = f"_{name}", f"_{flag}"
    names = names.select(F.col("logger").alias(name)).filter(F.col(name).isNotNull()).distinct()
    # lengths of the names plus a generous overhead per row
    size = names.agg(F.sum(F.octet_length(name).cast("long") + 64)).first()[0]
    if size is None:
        return df, None
    names = names.withColumn(flag, F.lit(True))
    if size <= LIST_BYTES:
        names = F.broadcast(names)
    # at most one match, so no row comes twice; beyond the broadcast adaptive execution splits hot loggers
    joined = df.join(names, df["logger"] == names[name], "left").drop(name)
    return joined, F.coalesce(F.col(flag), F.lit(False))


def route(
    df: DataFrame,
    opts: Options = Options(),
    deny: DataFrame | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """Add ``route``: ``pass``, ``deny`` or ``check``; the first step that applies decides.

    Logger lists match whole names.  Only checked rows count as processed.  ``deny`` and ``allow`` are
    tables with a column ``logger`` that lengthen the lists of the options; they are measured when
    this is called.  ``df`` may be a stream.  As with the options, an empty list restricts nothing.
    """
    columns = df.columns
    df, in_deny = _with_listed(df, deny)
    df, in_allow = _with_listed(df, allow)
    kind, logger, level = F.col("kind"), F.col("logger"), F.col("level")
    own_notice = (kind == STRUCTURED) & (logger == opts.notice_logger)
    empty_numeric = (kind == NUMERIC) & (F.coalesce(F.col("message"), F.lit("")) == "")
    console_off = (kind == CONSOLE) & F.lit(not opts.console_enabled)
    unranked = level.isNull() | (level == BEYOND_TRACE)
    decision = (
        F.when(own_notice | empty_numeric | console_off, PASS)
        .when(F.lit(opts.passes_all), PASS)
        .when(unranked, PASS)
    )
    if opts.deny_loggers:
        decision = decision.when(logger.isin(*opts.deny_loggers), DENY)
    if in_deny is not None:
        decision = decision.when(in_deny, DENY)
    if opts.allow_loggers or in_allow is not None:
        listed = F.lit(False) if in_allow is None else in_allow
        if opts.allow_loggers:
            listed = listed | F.coalesce(logger.isin(*opts.allow_loggers), F.lit(False))
        decision = decision.when(~listed, PASS)
    routed = df.withColumn("route", decision.otherwise(CHECK))
    return routed.select(*[column for column in columns if column != "route"], "route")


def checked(df: DataFrame) -> DataFrame:
    return df.filter(F.col("route") == CHECK)


def passed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("route") == PASS)
