import random

import pytest
from model import suppress
from pyspark.sql import functions as F

from hushlog import Options
from hushlog.operators.bursts import _with_cell, burst_table, decide, with_bursts
from hushlog.operators.reports import mark_reports
from hushlog.operators.templates import keyed

SCHEMA = (
    "kind string, source string, seq long, event_ms long, logger string, level string,"
    " leader_template string, message string, window_ms int"
)


def random_rows(seed, count, step, spread=3, sources=2, windows=(100, 500, 2000, 4000), fixed=True):
    """A log with crowded times, ties, pauses and idle spells."""
    rng = random.Random(seed)
    now, rows = rng.choice([0, -5_000, 1_700_000_000_000]), []
    for seq in range(count):
        now += rng.choice(step)
        t = rng.randrange(spread)
        rows.append(
            {
                "kind": "structured",
                "source": f"s{rng.randrange(sources)}",
                "seq": seq,
                "event_ms": now,
                "logger": rng.choice(["a", None]),
                "level": rng.choice(["ERROR", "INFO", "TRACE"]),
                "leader_template": f"t{t}",
                "message": f"m{t}",
                "window_ms": windows[t % len(windows)] if fixed else rng.choice(windows),
            }
        )
    return rows


STEPS = {
    "dense": [0, 0, 0, 1, 2],
    "gaps": [0, 1, 5, 100, 101, 500, 501],
    "idle": [0, 1, 1, 1, 1, 1, 1, 1, 1, 2000, 2001, 20_000, 20_001, 90_000],
    "slow": [150, 190, 450],
    "constant": [0],
}
SMALL = dict(error_threshold=2, info_threshold=4, debug_threshold=1)
FIELDS = ["life_no", "burst_no", "n", "first_ms", "duration_ms", "allowed", "report"]


def all_patterns(seed, fixed):
    """Every time pattern in one log, told apart by logger."""
    rows = []
    for name, step in STEPS.items():
        for row in random_rows(f"{seed}{name}", 1200, step, fixed=fixed):
            logger = None if row["logger"] is None and name == "dense" else name
            rows.append(row | {"logger": logger, "source": f"{row['source']}-{name}"})
    return rows


@pytest.mark.parametrize(
    "hot_rows, block_rows, fixed",
    [(1_000_000, 65_536, True), (1_000_000, 16, False), (3, 4, True), (2, 3, False)],
)
def test_equals_the_per_record_model(spark, hot_rows, block_rows, fixed):
    opts = Options(
        **SMALL, fuzzy=not fixed, show_count_after=7, hot_rows=hot_rows, block_rows=block_rows
    )
    rows = all_patterns(hot_rows, fixed)
    if hot_rows == 3:
        # positions far apart, as ids made from a clock are
        rows = [row | {"seq": row["seq"] * 10**12 + 7} for row in rows]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    got = mark_reports(decide(with_bursts(df, opts), opts), opts).collect()
    expected = suppress(rows, opts)
    assert len(got) == len(rows)
    assert {(r.source, r.seq): {f: r[f] for f in FIELDS} for r in got} == expected
    assert sum(e["report"] for e in expected.values()) > 50

    bursts = burst_table(df, opts)
    total = bursts.agg(F.sum("n_rows"), F.sum("suppressed"), F.count("*")).first()
    assert tuple(total[:2]) == (len(rows), sum(not e["allowed"] for e in expected.values()))
    assert total[2] == sum(e["n"] == 1 for e in expected.values())


def test_count_rule_equals_the_model_without_time(spark):
    opts = Options(**SMALL, fuzzy=False, show_count_after=5, report_by_time=False)
    rows = random_rows("count", 800, [0, 1, 1, 2, 300])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = mark_reports(decide(with_bursts(df, opts), opts), opts).filter("report").collect()
    levels = {(r["source"], r["seq"]): r["level"] for r in rows}
    assert {(r.source, r.seq) for r in got} == {
        place
        for place, e in suppress(rows, opts).items()
        if not e["allowed"] and _due(e["n"], levels[place], opts)
    }


def _due(n, level, opts):
    limit = {"ERROR": opts.error_threshold, "INFO": opts.info_threshold}.get(
        level, opts.debug_threshold
    )
    told = 0
    for k in range(limit + 1, n + 1):
        if k - told >= opts.show_count_after:
            told = k
    return told == n


def log(spark, rows, opts):
    df = spark.createDataFrame(
        [("structured", "s", i, *r) for i, r in enumerate(rows)],
        "kind string, source string, seq long, event_ms long, logger string, level string,"
        " message string",
    )
    return decide(with_bursts(keyed(df, opts), opts), opts)


def test_limit_rows_pass_and_a_pause_resets(spark):
    opts = Options(fuzzy=False)
    limits = {"INFO": 20, "ERROR": 5, "FATAL": 5, "WARN": 10, "DEBUG": 3, "TRACE": 3, "CUSTOM": 3}
    rows = [
        (1000 + i, "test", level, "msg") for level, n in limits.items() for i in range(n + 1)
    ]
    # a gap equal to the window stays in the burst, one more millisecond ends it
    rows += [(ms, "general", "INFO", "m") for ms in (0, 2000, 4001)]
    rows += [(ms, "save", "INFO", "saving") for ms in (0, 2000, 4001)]
    rows += [(ms, "long", "INFO", "save now") for ms in (0, 4000, 8001)]
    got = log(spark, rows, opts).orderBy("seq").collect()
    for level, limit in limits.items():
        passed = [r.allowed for r in got if r.logger == "test" and r.level == level]
        assert passed == [True] * limit + [False]
    for logger, bursts in {"general": [1, 1, 2], "save": [1, 1, 2], "long": [1, 1, 2]}.items():
        assert [r.burst_no for r in got if r.logger == logger] == bursts


def test_first_notice_after_every_five(spark):
    opts = Options(fuzzy=False, show_count_after=5)
    rows = [(1000 + i, "test", "INFO", "msg") for i in range(300)]
    got = mark_reports(log(spark, rows, opts), opts).filter("report").orderBy("n").collect()
    assert [r.n for r in got] == list(range(21, 301, 5))
    assert got[0].duration_ms == 20


def test_input_order_and_partitioning_do_not_matter(spark):
    opts = Options(**SMALL, fuzzy=False)
    rows = random_rows("order", 600, STEPS["gaps"])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    one = with_bursts(df.coalesce(1).orderBy(F.desc("seq")), opts)
    many = with_bursts(df.repartition(7, "seq"), opts)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


@pytest.mark.parametrize("far_apart", [1, 10**9])
def test_one_crowded_moment_is_split_evenly(spark, far_apart):
    """All rows share a key and a time: ranks are still taken in small groups."""
    opts = Options(fuzzy=False, hot_rows=100, block_rows=50)
    df = spark.range(6000).select(
        F.lit("k").alias("logger"),
        F.lit("INFO").alias("level"),
        F.lit("t").alias("leader_template"),
        F.lit(5).cast("long").alias("event_ms"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
        (F.floor(F.col("id") / 3) * far_apart).alias("seq"),
        F.lit(2000).alias("window_ms"),
    )
    cells = _with_cell(df, opts).groupBy("cell").count().agg(F.max("count"), F.count("*")).first()
    assert cells[0] <= 2 * opts.block_rows and cells[1] <= 2 * 6000 / opts.block_rows
    placed = with_bursts(df, opts)
    assert placed.agg(F.max("n"), F.countDistinct("n")).first() == (6000, 6000)
    assert placed.filter("n = 2001").first().source == "s1"


def test_no_task_orders_a_whole_key(spark):
    """Row-level sorts are bounded by a cell, and no Python runs outside the report fold."""
    opts = Options(fuzzy=False)
    rows = random_rows("plan", 50, STEPS["dense"])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    plan = decide(with_bursts(df, opts), opts)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line]
    assert windows and all("cell" in w or "stretch" in w for w in windows)
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("fuzzy", [True, False])
def test_merged_copies_have_the_gap_of_the_first_row_after_a_pause(spark, fuzzy):
    opts = Options(fuzzy=fuzzy)
    rows = [(0, "save xx"), (3000, "note xx"), (3050, "save xx")]
    df = spark.createDataFrame(
        [("structured", "s", i, ms, "a", "INFO", text) for i, (ms, text) in enumerate(rows)],
        "kind string, source string, seq long, event_ms long, logger string, level string,"
        " message string",
    )
    led = keyed(df, opts).withColumn("leader_template", F.lit("save xx"))
    got = with_bursts(led, opts).orderBy("seq").collect()
    assert [r.burst_no for r in got] == [1, 2, 2]
