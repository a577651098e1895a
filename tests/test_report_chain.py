"""Reports as composed functions, against the record-by-record rule."""

import random

import numpy as np
import pytest
from model import suppress
from pyspark.sql import functions as F
from test_bursts import SCHEMA, SMALL, random_rows

from hushlog import Options
from hushlog.operators import report_chain as chain
from hushlog.operators.bursts import decide, with_bursts
from hushlog.operators.reports import mark_reports

FROM = 5  # first suppressed position of a burst


def life(rng, count, step):
    """Suppressed rows of one life: burst, n, at."""
    burst, n, at, rows = 1, FROM, 0, []
    for _ in range(count):
        if rng.random() < 0.05:
            burst, n = burst + 1, FROM
        at += rng.choice(step)
        rows.append((burst, n, at))
        n += 1
    return rows


def followed(rows, state, every, wait_ms):
    told_burst, told_n, told_at = state
    reports = []
    for i, (burst, n, at) in enumerate(rows):
        if n - (told_n if burst == told_burst else 0) >= every or at - told_at > wait_ms:
            told_burst, told_n, told_at = burst, n, at
            reports.append(i)
    return reports, (told_burst, told_n, told_at)


def function_of(rows, every, wait_ms):
    burst, n, at = (np.array(c, dtype=np.int64) for c in zip(*rows))
    stretch = chain.Stretches(np.array([0]), burst, n, at, every, wait_ms)
    last, kept = chain._last_of(stretch.following()), np.flatnonzero(stretch.possible())
    parts = (burst, n, at)
    return chain.Step(
        tuple(p[kept] for p in parts), tuple(p[last[kept]] for p in parts), every, wait_ms
    )


@pytest.mark.parametrize("every", [1, 3, 8, 50])
@pytest.mark.parametrize("step", [[0], [0, 0, 1], [0, 1, 5], [3, 40]])
def test_functions_and_their_compositions(every, step):
    rng, wait_ms = random.Random(f"{every}{step}"), 20
    for _ in range(60):
        rows = life(rng, rng.randrange(3, 80), step)
        edges = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randrange(5)))})
        steps = [function_of(rows[a:b], every, wait_ms) for a, b in zip(edges, edges[1:])]
        # any grouping of neighbours is the same function
        left = steps[0]
        for other in steps[1:]:
            left = left.then(other)
        right = steps[-1]
        for other in reversed(steps[:-1]):
            right = other.then(right)
        before = [(-1, 0, rows[0][2] - back) for back in (0, 1, wait_ms, wait_ms + 1, 10**6)]
        before += [(1, n, rows[0][2] - back) for n in range(FROM) for back in (0, 7, wait_ms + 3)]
        states = tuple(np.array(c, dtype=np.int64) for c in zip(*before))
        want = [followed(rows, state, every, wait_ms)[1] for state in before]
        one_by_one = states
        for each in steps:
            one_by_one = each.after(one_by_one)
        for got in (left.after(states), right.after(states), one_by_one):
            assert list(zip(*(c.tolist() for c in got))) == want


def test_a_function_is_as_long_as_count_and_wait_ask():
    rows = [(1, FROM + i, i // 100) for i in range(50_000)]
    assert len(function_of(rows, 100, 10).first[0]) == 100
    # behind the first burst one row of each time is enough
    rows = [(1, FROM, 0)] + [(2, FROM + i, i // 100) for i in range(50_000)]
    assert len(function_of(rows, 10**6, 10).first[0]) <= 13


def compare(spark, rows, opts, fan):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    decided = chain.stored(decide(with_bursts(df, opts), opts))
    told = chain.reports_by_time(decided, opts, fan)
    place = ["logger", "level", "leader_template", "life_no", "burst_no", "n"]
    keys = {(r["source"], r["seq"]): (r["logger"], r["level"], r["leader_template"]) for r in rows}
    want = sorted(
        str((*keys[at], e["life_no"], e["burst_no"], e["n"]))
        for at, e in suppress(rows, opts).items()
        if e["report"]
    )
    assert sorted(str(tuple(r)) for r in told.select(*place).collect()) == want
    return len(want)


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_long_lives_over_several_levels(spark, fan):
    """Lives of many minutes, cut into spans, composed in groups of two, three or not at all."""
    opts = Options(**SMALL, fuzzy=False, show_count_after=9, block_rows=8)
    rows = [
        r | {"logger": "a", "level": "INFO"}
        for r in random_rows("long", 2500, [1, 1, 50, 700, 2100, 6000], spread=2)
    ]
    rows += [r | {"logger": "b", "seq": r["seq"] + 5000} for r in random_rows("two", 900, [0, 0, 1, 400])]
    ages = {}
    for (_, seq), e in suppress(rows, opts).items():
        if seq < 5000:
            ages.setdefault((rows[seq]["leader_template"], e["life_no"]), []).append(rows[seq]["event_ms"])
    assert max(max(a) - min(a) for a in ages.values()) > 8 * chain.SPAN_MS
    assert compare(spark, rows, opts, fan) > 50


def test_one_hot_key_with_the_longest_count(spark):
    """No task reads a whole life, however rarely it reports."""
    opts = Options(fuzzy=False, show_count_after=10_000, block_rows=2000)
    rng, now, rows = random.Random(4), 0, []
    for seq in range(60_000):
        now += rng.choice([0, 0, 0, 1, 3])
        rows.append(dict(kind="structured", source="s", seq=seq, event_ms=now, logger="a", level="INFO",
                         leader_template="t", message="m", window_ms=2000))
    assert compare(spark, rows, opts, 2) >= 6


def test_input_is_worked_out_once(spark):
    """The rows are written before anything reads them, and empty logs have no reports."""
    opts = Options(fuzzy=False, show_count_after=5)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = random_rows("once", 400, [0, 1, 30])
    df = decide(with_bursts(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), opts), opts)
    marked = mark_reports(df.mapInPandas(counted, df.schema), opts)
    assert marked.count() == 400 and marked.filter("report").count() > 10
    assert reads.value == 400
    assert mark_reports(df.filter("false"), opts).filter(F.col("report").isNull() | F.col("report")).count() == 0
