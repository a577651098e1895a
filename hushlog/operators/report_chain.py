"""Which suppressed rows report when a report depends on the one before it.

What a stretch of rows does to the last report is a small function: only the rows that could be its
first report matter, and each of them leads to one last report.  Functions of neighbouring
stretches are composed, so the reports of a key are found without any task reading all its rows:

1. every stretch of at most a minute and about ``block_rows`` rows becomes a function;
2. while a life is long, the functions of ``FAN`` neighbouring spans are composed into one;
3. from the start of each life the functions are followed, then those below them, level by level;
4. every stretch is read once more from the report that really precedes it.

All stretches of a batch are worked on at once; nothing loops over bursts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlog.functions.checkpoints import forget, stored
from hushlog.options import Options
from hushlog.schemas import KEY

#: A stretch lies within one span of time.
SPAN_MS = 60_000
#: Spans of a life whose functions are followed one after the other, or composed into one.
FAN = 1024

_LIFE = [*KEY, "life_no"]
_PLACE = ["burst_no", "n"]
# A function: the rows that may report first, and the last report that follows from each.
_FIRST = ["first_burst", "first_n", "first_at"]
_LAST = ["last_burst", "last_n", "last_at"]
# The report before a stretch.
_BEFORE = ["before_burst", "before_n", "before_at"]
# No burst has this number: the count starts anew.
_NO_BURST = -1

State = tuple[np.ndarray, np.ndarray, np.ndarray]


class Stretches:
    """Rows of several stretches behind one another, each within one span of one life.

    ``starts`` are the places where a stretch begins (the first is 0).  Within a burst ``n`` counts
    up by one; within a stretch ``at`` never falls.
    """

    def __init__(self, starts, burst, n, at, every: int, wait_ms: int) -> None:
        self.starts, self.burst, self.n, self.at = starts, burst, n, at
        self.every, self.wait_ms = every, wait_ms
        rows = len(n)
        begins = np.zeros(rows, dtype=bool)
        begins[starts] = True
        self.of = np.cumsum(begins) - 1
        self.end = np.append(starts[1:], rows)
        # parts: the rows of one burst in one stretch
        fresh = begins.copy()
        fresh[1:] |= burst[1:] != burst[:-1]
        part_start = np.flatnonzero(fresh)
        self.part = np.cumsum(fresh) - 1
        self.part_end = np.append(part_start[1:], rows)
        # in a burst without a report yet the count alone decides from here on
        due = part_start + np.maximum(every - n[part_start], 0)
        due = np.where(due < self.part_end, due, rows)
        self.due_later = np.append(np.minimum.accumulate(due[::-1])[::-1], rows)[1:]
        # one rising line of times: stretches lie further apart than any wait reaches
        rel = at - at[starts][self.of]
        self.apart = int(rel.max()) + wait_ms + 2
        self.line = self.of * self.apart + rel

    def _by_count(self, row: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """``spot`` if it is still in the burst of ``row``, else where a later burst is due."""
        part = self.part[row]
        return np.where(spot < self.part_end[part], spot, self.due_later[part])

    def following(self) -> np.ndarray:
        """For each row the report after it if it reports; the row itself if its stretch has none."""
        row = np.arange(len(self.n))
        by_time = np.searchsorted(self.line, self.line + self.wait_ms, side="right")
        step = np.minimum(self._by_count(row, row + self.every), by_time)
        return np.where(step < self.end[self.of], step, row)

    def first(self, before: State) -> np.ndarray:
        """First report of each stretch behind the report ``before``; its end if it has none."""
        burst, n, at = before
        row = self.starts
        told = np.where(burst == self.burst[row], n, 0)
        by_count = self._by_count(row, row + np.maximum(told + self.every - self.n[row], 0))
        late = np.clip(at + self.wait_ms - self.at[row], -1, self.wait_ms)
        stretch = np.arange(len(row))
        by_time = np.searchsorted(self.line, stretch * self.apart + late, side="right")
        return np.minimum(np.minimum(by_count, by_time), self.end)

    def possible(self) -> np.ndarray:
        """Whether a row may be the first report of its stretch, whatever came before."""
        rows = np.arange(len(self.n))
        start = self.starts
        # the latest report there can have been lies just before the stretch
        sure = self.first((self.burst[start], self.n[start] - 1, self.at[start]))
        other_burst = self.part != self.part[start][self.of]
        same_time = np.append(False, self.at[1:] == self.at[:-1])
        sure = np.minimum(sure, self.end - 1)[self.of]
        # behind the first burst only the clock tells rows apart, and it tells the first of a time
        return (rows <= sure) & ((rows == sure) | ~other_burst | ~same_time)


def _last_of(following: np.ndarray) -> np.ndarray:
    """Where the chain of reports from each row ends."""
    while True:
        further = following[following]
        if np.array_equal(further, following):
            return further
        following = further


class Step:
    """The function of a stretch, as arrays over the rows that may report first."""

    def __init__(self, first: State, last: State, every: int, wait_ms: int) -> None:
        self.first, self.last = first, last
        self.every, self.wait_ms = every, wait_ms
        burst, n, _ = first
        self.own = int(np.searchsorted(burst, burst[0], side="right"))
        due = np.flatnonzero(n[self.own :] >= every)
        self.due = self.own + int(due[0]) if len(due) else len(n)

    def spot(self, state: State) -> np.ndarray:
        """Which of the possible first reports follows ``state``; their number if none does."""
        burst, n, at = state
        told = np.where(burst == self.first[0][0], n, 0)
        count = np.maximum(told + self.every - self.first[1][0], 0)
        by_count = np.where(count < self.own, count, self.due)
        by_time = np.searchsorted(self.first[2], at + self.wait_ms, side="right")
        return np.minimum(by_count, by_time)

    def after(self, state: State) -> State:
        spot = self.spot(state)
        none = spot == len(self.first[0])
        spot = np.where(none, 0, spot)
        return tuple(np.where(none, was, last[spot]) for was, last in zip(state, self.last))

    def then(self, other: "Step") -> "Step":
        """This stretch and the next one as one function."""
        burst, n, at = (part[:1] for part in self.first)
        last = other.after(self.last)
        if int(self.spot((burst, n - 1, at))[0]) < len(self.first[0]):
            return Step(self.first, last, self.every, self.wait_ms)
        # it may hold no report: then a row of the next one is the first
        first = tuple(np.concatenate(pair) for pair in zip(self.first, other.first))
        last = tuple(np.concatenate(pair) for pair in zip(last, other.last))
        whole = Step(first, last, self.every, self.wait_ms)
        sure = int(whole.spot((burst, n - 1, at))[0])
        rows = np.arange(len(first[0]))
        fresh = np.append(True, first[2][1:] != first[2][:-1])
        keep = (rows <= sure) & ((rows == sure) | (first[0] == burst[0]) | fresh)
        return Step(
            tuple(c[keep] for c in first), tuple(c[keep] for c in last), self.every, self.wait_ms
        )


def _numbers(table: pa.RecordBatch | pa.Table, names: list[str]) -> list[np.ndarray]:
    return [np.asarray(table.column(name)) for name in names]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts), pa.int64()))


def _steps_of_rows(names: list[str], block_rows: int, every: int, wait_ms: int):
    """One function per stretch; a stretch also ends where ``block_rows`` rows are at hand."""

    def functions(table: pa.Table) -> pa.RecordBatch:
        burst, n, at = _numbers(table, [*_PLACE, "event_ms"])
        opens = np.asarray(table.column("opens"))
        starts = np.flatnonzero(np.append(True, opens[1:]))
        rows = Stretches(starts, burst, n, at, every, wait_ms)
        last = _last_of(rows.following())
        kept = np.flatnonzero(rows.possible())
        edges = np.searchsorted(kept, starts[1:])
        columns = [np.split(part[kept], edges) for part in (burst, n, at)]
        columns += [np.split(part[last[kept]], edges) for part in (burst, n, at)]
        heads = table.select(names).take(pa.array(starts))
        flat = [heads.column(name).combine_chunks() for name in names]
        return pa.RecordBatch.from_arrays(
            [*flat, *map(_lists, columns)], [*names, *_FIRST, *_LAST]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= block_rows:
                yield functions(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield functions(pa.Table.from_batches(held))

    return run


def _step_at(batch: pa.RecordBatch, row: int, every: int, wait_ms: int) -> Step:
    parts = [
        batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in [*_FIRST, *_LAST]
    ]
    return Step(tuple(parts[:3]), tuple(parts[3:]), every, wait_ms)


def _steps_of_steps(names: list[str], every: int, wait_ms: int):
    """One function per group of functions that arrive in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, step = None, None

        def done() -> pa.RecordBatch:
            parts = [_lists([part]) for part in (*step.first, *step.last)]
            return pa.RecordBatch.from_arrays([*head.columns, *parts], [*names, *_FIRST, *_LAST])

        for batch in batches:
            opens = batch.column("opens").to_pylist()
            for row in range(len(batch)):
                here = _step_at(batch, row, every, wait_ms)
                if opens[row] and step is not None:
                    yield done()
                    step = None
                if step is None:
                    head, step = batch.select(names).slice(row, 1), here
                else:
                    step = step.then(here)
        if step is not None:
            yield done()

    return run


def _reports_before(names: list[str], every: int, wait_ms: int):
    """The report before each function; a row with the report before its group leads the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            is_row = np.asarray(batch.column("is_row"))
            rows, states = np.flatnonzero(is_row == 1), []
            for row in range(len(batch)):
                if is_row[row] == 0:
                    state = tuple(
                        np.array([batch.column(name)[row].as_py()], dtype=np.int64) for name in _BEFORE
                    )
                else:
                    states.append([int(part[0]) for part in state])
                    state = _step_at(batch, row, every, wait_ms).after(state)
            picked = batch.select(names).take(pa.array(rows, pa.int64()))
            before = np.array(states, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, *(pa.array(before[:, i]) for i in range(3))], [*names, *_BEFORE]
            )

    return run


def _reports_of_rows(names: list[str], every: int, wait_ms: int):
    """The rows that report, from stretches in order, each behind a row with the report before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [_NO_BURST, 0, 0]
        for batch in batches:
            is_row = np.asarray(batch.column("is_row")) == 1
            place, heads = np.flatnonzero(is_row), np.flatnonzero(~is_row)
            before = np.stack(_numbers(batch, _BEFORE), axis=1)
            if len(place):
                led = np.append(True, np.diff(place) > 1)
                starts = np.flatnonzero(led)
                states = before[np.maximum(place[starts] - 1, 0)]
                if is_row[0]:
                    states[0] = state
                burst, n, at = (c[place] for c in _numbers(batch, [*_PLACE, "event_ms"]))
                rows = Stretches(starts, burst, n, at, every, wait_ms)
                following = rows.following()
                first = rows.first(tuple(states.T))
                reports = np.zeros(len(place), dtype=bool)
                spot = first[first < rows.end]
                while len(spot):
                    reports[spot] = True
                    further = following[spot]
                    spot = further[further != spot]
                told = np.flatnonzero(reports)
                yield batch.select(names).take(pa.array(place[told]))
                state = states[-1].tolist()
                if len(told) and told[-1] >= starts[-1]:
                    state = [int(part[told[-1]]) for part in (burst, n, at)]
            if not is_row[-1]:
                state = before[heads[-1]].tolist()

    return run


def _schema(df: DataFrame, names: list[str], lists: list[str] = [], longs: list[str] = []) -> T.StructType:
    fields = [T.StructField(name, df.schema[name].dataType) for name in names]
    fields += [T.StructField(name, T.ArrayType(T.LongType())) for name in lists]
    return T.StructType(fields + [T.StructField(name, T.LongType()) for name in longs])


def _opens(df: DataFrame, group: list[str], gap: Column | None = None) -> DataFrame:
    """``df`` in the order of its groups, with ``opens`` where a group (or, after a gap, a stretch) begins."""
    rows = Window.partitionBy(*group).orderBy(*_PLACE)
    opens = F.row_number().over(rows) == 1
    if gap is not None:
        before = F.lag(F.struct(*_PLACE)).over(rows)
        opens = opens | F.coalesce(_gap_after(before, gap), F.lit(False))
    # the window already leaves the groups whole and in order, so this sort costs nothing
    return df.withColumn("opens", opens).sortWithinPartitions(*group, *_PLACE)


def _gap_after(before: Column, block_rows: Column) -> Column:
    """Rows of a later block lie between a row and the one ``before`` it in its block."""
    cut_off = (F.col("block") > 0) | ((before["n"] + 1) % block_rows == 0)
    return (before["burst_no"] != F.col("burst_no")) & cut_off


def _led(df: DataFrame, heads: DataFrame, group: list[str]) -> DataFrame:
    """``df`` in the order of its groups, each of ``heads`` just before the row it stands for."""
    mixed = df.withColumn("is_row", F.lit(1)).unionByName(
        heads.withColumn("is_row", F.lit(0)), allowMissingColumns=True
    )
    filled = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in _BEFORE]
    mixed = mixed.select(*(c for c in mixed.columns if c not in _BEFORE), *filled)
    return mixed.repartition(*group).sortWithinPartitions(*group, *_PLACE, "is_row")


def reports_by_time(decided: DataFrame, opts: Options, fan: int = FAN) -> DataFrame:
    """``KEY, life_no, burst_no, n`` of the rows that report, as a stored table.

    ``decided`` is read twice, a few narrow columns only.
    """
    every, wait_ms = max(opts.show_count_after, 1), opts.report_every_ms
    # a cell is a life's rows of one span and block, so a burst of any size is spread over tasks
    rows = decided.filter(~F.col("allowed")).select(
        *_LIFE,
        "life_start_ms",
        *(F.col(name).cast("long").alias(name) for name in (*_PLACE, "event_ms")),
        F.expr(f"event_ms div {SPAN_MS}").alias("span"),
        F.expr(f"n div {opts.block_rows}").alias("block"),
    )
    cell = [*_LIFE, "span", "block"]
    names = [*_LIFE, "life_start_ms", "span", *_PLACE]
    steps = stored(
        _opens(rows, cell, F.lit(opts.block_rows)).mapInArrow(
            _steps_of_rows(names, opts.block_rows, every, wait_ms), _schema(rows, names, [*_FIRST, *_LAST])
        ),
        "steps",
    )
    lives = steps.groupBy(*_LIFE).agg((F.max("span") - F.min("span")).alias("reach"))
    reach = lives.agg(F.max("reach")).first()[0] or 0
    levels = [steps]
    while reach >= fan:
        wide = F.expr(f"span div {fan ** len(levels)}")
        composed = _opens(levels[-1].withColumn("wide", wide), [*_LIFE, "wide"]).mapInArrow(
            _steps_of_steps(names, every, wait_ms), _schema(rows, names, [*_FIRST, *_LAST])
        )
        levels.append(stored(composed, "steps"))
        reach //= fan
    zero = F.lit(0).cast("long")
    heads = (
        levels[-1]
        .groupBy(*_LIFE)
        .agg(F.min(F.struct(*_PLACE)).alias("at"), F.min("life_start_ms").cast("long").alias("before_at"))
        .select(*_LIFE, "at.*", F.lit(_NO_BURST).cast("long").alias("before_burst"), zero.alias("before_n"), "before_at")
    )
    found, wide, kept = None, zero, [*_LIFE, "span", *_PLACE]
    while levels:
        level = levels.pop()
        mixed = _led(level.withColumn("wide", wide), heads.withColumn("wide", wide), [*_LIFE, "wide"])
        before = stored(
            mixed.mapInArrow(_reports_before(kept, every, wait_ms), _schema(rows, kept, longs=_BEFORE)),
            "before",
        )
        for done in (level, found):
            if done is not None:
                forget(done)
        # the functions just followed stand for this much time, and lead those below them
        heads, found, wide = before, before, F.expr(f"span div {fan ** len(levels)}")
    block = F.expr(f"n div {opts.block_rows}").alias("block")
    mixed = _led(rows.drop("life_start_ms"), found.select("*", block), cell)
    mixed = mixed.withColumn("event_ms", F.coalesce("event_ms", F.lit(0).cast("long")))
    place = [*_LIFE, *_PLACE]
    reports = stored(
        mixed.mapInArrow(_reports_of_rows(place, every, wait_ms), _schema(rows, place)), "reports"
    )
    forget(found)
    return reports
