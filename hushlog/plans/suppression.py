"""The whole job: route, key, find bursts, decide, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlog.functions.checkpoints import cut, stored
from hushlog.operators.bursts import decide, key_grains, with_bursts
from hushlog.operators.cluster import (
    BROADCAST_BYTES,
    cluster_templates,
    numbered_leaders,
    with_leader_number,
)
from hushlog.operators.output import OUTPUT, deduplicated
from hushlog.operators.reports import mark_reports
from hushlog.operators.route import DENY, checked, route
from hushlog.operators.templates import led, template_stats, with_template, with_window_class
from hushlog.options import Options
from hushlog.schemas import ORDER


def decisions(
    events: DataFrame,
    opts: Options = Options(),
    leaders: DataFrame | None = None,
    deny: DataFrame | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """Checked rows of a log with their place in a burst, ``allowed`` and ``report``.

    Runs a job when called: rows get their templates once and are kept in the shared folder, since
    finding bursts reads narrow columns of them several times.
    """
    rows = with_window_class(with_template(checked(route(events, opts, deny, allow)), opts), opts)
    # without leaders the key template is the template, which need not be kept twice
    keys = led(stored(rows, "keyed")) if leaders is None else stored(led(rows, leaders), "keyed")
    return mark_reports(decide(with_bursts(keys, opts, key_grains(keys, opts)), opts), opts)


def leaders_of(
    events: DataFrame,
    opts: Options = Options(),
    deny: DataFrame | None = None,
    allow: DataFrame | None = None,
) -> DataFrame | None:
    """Leader table of a log's templates; None when near copies are not merged."""
    if not opts.fuzzy:
        return None
    rows = checked(route(events, opts, deny, allow))
    return cluster_templates(template_stats(with_template(rows, opts)), opts)


def quiet_log(
    events: DataFrame,
    opts: Options = Options(),
    deny: DataFrame | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """The log without its noise: what passes, what is allowed, and count notices.

    ``deny`` and ``allow`` are lists of loggers as tables (see ``route``).  Runs the suppression when called and keeps the surviving rows in the shared folder.
    """
    if opts.fuzzy:
        return _quiet_near_copies(route(events, opts, deny, allow), opts)
    marked = decisions(events, opts, leaders_of(events, opts, deny, allow), deny, allow)
    # what survives is used more than once and is the small part of a noisy log
    kept = cut(marked.filter("allowed OR report"))
    return deduplicated(kept, route(events, opts, deny, allow), opts)


def _quiet_near_copies(routed: DataFrame, opts: Options) -> DataFrame:
    """``quiet_log`` with near copies merged.

    The log is read and its templates are worked out once.  Bursts and reports are found on rows without
    texts, whose key is the number of their leader; what survives takes its texts from the stored rows.
    """
    rows = stored(
        with_window_class(with_template(routed.filter(F.col("route") != DENY), opts), opts)
        .select(*OUTPUT, "route", "template", "window_ms")
        .withColumn("row_id", F.monotonically_increasing_id()),
        "keyed",
    )
    told = checked(rows)
    numbers = numbered_leaders(template_stats(told), opts)
    short = told.select("row_id", *ORDER, "logger", "level", "template", "window_ms")
    keys = stored(with_leader_number(short, numbers).drop("template"), "numbered")
    marked = mark_reports(decide(with_bursts(keys, opts, key_grains(keys, opts)), opts), opts)
    # what survives is used more than once and is the small part of a noisy log
    kept = cut(
        marked.filter("allowed OR report").select("row_id", "n", "duration_ms", "allowed", "report")
    )
    if kept.count() * 64 <= BROADCAST_BYTES:
        kept = F.broadcast(kept)
    return deduplicated(told.select(*OUTPUT, "row_id").join(kept, "row_id"), rows, opts)
