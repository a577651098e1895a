"""Incremental suppression: the batch decisions, one key's state at a time.

Rows wait in their key's state until the watermark has passed them and are then taken in
``(event_ms, source, seq)`` order, so the result equals the batch plan; latency is the watermark
delay.  Rows behind the watermark are dropped and counted in the progress of the step (``late_rows`` in
``streaming/run.py``); a stream's first watermark is the start of 1970, so earlier rows are, too.  A key
idle for ten general gaps is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushlog.functions import classify
from hushlog.operators.reports import first_report, next_reports
from hushlog.options import Options
from hushlog.schemas import KEY, ORDER
from hushlog.streaming.waiting import as_bytes, gathered, parted, pieces, schema_of

_WAITING = {
    "kind": "string",
    "source": "string",
    "seq": "long",
    "event_ms": "long",
    "message": "string",
    "window_ms": "int",
    "threshold": "int",
}
_KEY_FIELDS = ", ".join(f"{name} string" for name in KEY)
_OUTPUT = (
    _KEY_FIELDS
    + ", "
    + ", ".join(f"{name} {kind}" for name, kind in _WAITING.items())
    + ", n long, first_ms long, duration_ms long, allowed boolean, report boolean"
)
_STATE = "last_ms long, first_ms long, n long, told_ms long, told_n long, waiting binary"


def advance(
    known: tuple[int, int, int, int, int] | None, rows: pd.DataFrame, opts: Options
) -> tuple[tuple[int, int, int, int, int], pd.DataFrame]:
    """Decide ordered rows of one key, given (last_ms, first_ms, n, told_ms, told_n) so far."""
    every, wait_ms = max(opts.show_count_after, 1), opts.report_every_ms
    ms = rows["event_ms"].to_numpy(np.int64)
    last_ms, first_ms, n_so_far, told_ms, told_n = known or (0, 0, 0, 0, 0)
    pause = ms - np.concatenate([[last_ms], ms[:-1]])
    new_life = pause > opts.idle_ms
    new_burst = pause > np.minimum(rows["window_ms"].to_numpy(np.int64), opts.idle_ms)
    if known is None:
        new_life[0] = new_burst[0] = True
    at = np.arange(len(ms))
    start = np.maximum.accumulate(np.where(new_burst, at, -1))
    n = np.where(start >= 0, at - start + 1, n_so_far + at + 1)
    first = np.where(start >= 0, ms[np.maximum(start, 0)], first_ms)
    allowed = n <= rows["threshold"].to_numpy(np.int64)
    report = np.zeros(len(ms), dtype=bool)
    edges = np.unique(np.concatenate([[0], np.flatnonzero(new_burst), [len(ms)]]))
    for begin, end in zip(edges[:-1], edges[1:]):
        if new_burst[begin]:
            told_n = 0
        if new_life[begin]:
            told_ms = int(ms[begin])
        # the threshold is one per key, so suppressed rows are the tail of a burst
        begin += int(np.count_nonzero(allowed[begin:end]))
        if begin == end:
            continue
        here_n, here_ms = n[begin:end], ms[begin:end]
        i = first_report(here_n, here_ms, told_n, told_ms, every, wait_ms)
        after = next_reports(here_n, here_ms, every, wait_ms)
        while i < len(here_n):
            report[begin + i] = True
            told_n, told_ms = int(here_n[i]), int(here_ms[i])
            i = int(after[i])
    state = (int(ms[-1]), int(first[-1]), int(n[-1]), int(told_ms), int(told_n))
    decided = rows.assign(
        n=n, first_ms=first, duration_ms=ms - first, allowed=allowed, report=report
    )
    return state, decided


def _step(opts: Options):
    schema = schema_of(_WAITING)

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        known, held = None, None
        if state.exists:
            *values, held = state.get
            known = None if values[0] is None else tuple(values)
        watermark = state.getCurrentWatermarkMs()
        rows = gathered(held, () if state.hasTimedOut else batches, schema)
        ready, waiting = parted(rows, watermark, ORDER)
        for piece in pieces(ready):
            known, decided = advance(known, piece, opts)
            decided.insert(0, KEY[0], key[0])
            decided.insert(1, KEY[1], key[1])
            decided.insert(2, KEY[2], key[2])
            yield decided
        if not len(waiting) and (known is None or known[0] + opts.idle_ms < watermark):
            if state.exists:
                state.remove()
            return
        state.update((*(known or (None,) * 5), as_bytes(waiting)))
        wake_ms = pc.min(waiting["event_ms"]).as_py() if len(waiting) else known[0] + opts.idle_ms
        state.setTimeoutTimestamp(max(wake_ms, watermark + 1))

    return step


def suppress_stream(
    keyed: DataFrame, opts: Options = Options(), delay: str = "10 seconds"
) -> DataFrame:
    """Decisions for a stream of keyed rows, in append mode.

    Near copies are merged by joining the batch job's leader table before this step.
    """
    rows = (
        keyed.withColumn("threshold", classify.threshold(F.col("level"), opts))
        .select(*KEY, *_WAITING, "event_ts")
        .withWatermark("event_ts", delay)
    )
    return rows.groupBy(*KEY).applyInPandasWithState(
        _step(opts), _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
