"""Incremental assembly of console lines into messages, one source's state at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushlog.functions.classify import is_exception, is_trace_line
from hushlog.options import Options
from hushlog.streaming.waiting import as_bytes, gathered, parted, pieces, schema_of

#: A century: only the end row of a stream that is run to its end lies that far ahead.
AT_THE_END_MS = 100 * 365 * 86_400_000

_WAITING = {
    "seq": "long",
    "event_ms": "long",
    "line": "string",
    "resets": "boolean",
    "opens": "boolean",
}
_OUTPUT = "source string, seq long, event_ms long, message string, n_lines long"
_STATE = "open_seq long, open_ms long, open_text string, open_lines long, last_ms long, waiting binary"


def _take(rows: pd.DataFrame, group: list | None) -> tuple[list[list], list | None]:
    """Messages that ordered lines complete, and the group left open: [seq, ms, lines]."""
    done = []
    for seq, ms, line, resets, opens in zip(*(rows[name].tolist() for name in _WAITING)):
        if group is not None and not resets:
            group[2].append(line)
            continue
        if group is not None:
            done.append(group)
            group = None
        if opens:
            group = [seq, ms, [line]]
        elif line:
            done.append([seq, ms, [line]])
    return done, group


def _messages(source: str, done: list[list]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "source": source,
            "seq": [g[0] for g in done],
            "event_ms": [g[1] for g in done],
            "message": ["\n".join(g[2]) for g in done],
            "n_lines": [len(g[2]) for g in done],
        }
    )


def _step(quiet_ms: int):
    schema = schema_of(_WAITING)

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        group, last_ms, held = None, None, None
        if state.exists:
            seq, ms, body, _, last_ms, held = state.get
            if seq is not None:
                group = [seq, ms, body.split("\n")]
        watermark = state.getCurrentWatermarkMs()
        rows = gathered(held, () if state.hasTimedOut else batches, schema)
        ready, waiting = parted(rows, watermark, ["event_ms", "seq"])
        for piece in pieces(ready):
            done, group = _take(piece, group)
            if done:
                yield _messages(key[0], done)
        if len(ready):
            last_ms = ready["event_ms"][-1].as_py()
        if group is not None and last_ms + quiet_ms < watermark:
            yield _messages(key[0], [group])
            group = None
        if group is None and not len(waiting):
            if state.exists:
                state.remove()
            return
        open_group = (None,) * 4 if group is None else (*group[:2], "\n".join(group[2]), len(group[2]))
        state.update((*open_group, last_ms, as_bytes(waiting)))
        wake_ms = pc.min(waiting["event_ms"]).as_py() if len(waiting) else last_ms + quiet_ms
        state.setTimeoutTimestamp(max(wake_ms, watermark + 1))

    return step


def assemble_stream(
    lines: DataFrame,
    opts: Options = Options(),
    delay: str = "10 seconds",
    close_after_ms: int = AT_THE_END_MS,
) -> DataFrame:
    """Messages of a stream of ``source, seq, event_ms, event_ts, line``, in append mode.

    Lines wait for the watermark and are taken in order. As in a batch, only a line that is no trace
    line, or the end of the stream, closes a group. A smaller ``close_after_ms`` also closes one
    once its source has had no line for so long; trace lines that come later stand alone.
    """
    line = F.col("line")
    if not (opts.detect_multiline and opts.console_enabled and opts.enabled):
        return lines.withWatermark("event_ts", delay).filter(line != "").select(
            "source",
            "seq",
            "event_ms",
            line.alias("message"),
            F.lit(1).cast("long").alias("n_lines"),
        )
    rows = lines.select(
        "source",
        "seq",
        "event_ms",
        "event_ts",
        "line",
        ((line != "") & ~is_trace_line(line)).alias("resets"),
        is_exception(line).alias("opens"),
    ).withWatermark("event_ts", delay)
    return rows.groupBy("source").applyInPandasWithState(
        _step(close_after_ms), _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
