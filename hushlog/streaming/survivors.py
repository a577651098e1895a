"""The surviving log of a stream, appended as it is decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlog.operators.output import deduplicated
from hushlog.operators.route import CHECK, route
from hushlog.operators.templates import keyed
from hushlog.options import Options
from hushlog.streaming.suppress import suppress_stream


def surviving_stream(
    events: DataFrame,
    opts: Options = Options(),
    delay: str = "10 seconds",
    leaders: DataFrame | None = None,
    deny: DataFrame | None = None,
    allow: DataFrame | None = None,
) -> DataFrame:
    """What passes, what is allowed, and count notices, in append mode.

    Passed rows come out at once, checked ones when the watermark has passed them. ``leaders`` is the
    batch job's leader table, ``deny`` and ``allow`` are lists of loggers as tables. Notices and cleaned traces are made row by row, so one stateful step is
    all there is. A row without a ``kind`` belongs to no log and only moves the watermark on.
    """
    routed = route(events, opts, deny, allow)
    mark = F.col("kind").isNull()
    rows = keyed(routed.filter((F.col("route") == CHECK) | mark), opts, leaders)
    return deduplicated(suppress_stream(rows, opts, delay), routed.filter(~mark), opts)
