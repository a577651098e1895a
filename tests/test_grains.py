"""Moments as wide as the gaps of their key."""

import pytest
from model import suppress
from pyspark.sql import functions as F
from test_bursts import FIELDS, SCHEMA, SMALL, all_patterns

from hushlog import Options
from hushlog.operators.bursts import _with_cell, decide, key_grains, with_bursts
from hushlog.operators.reports import mark_reports


@pytest.mark.parametrize(
    "hot_rows, fixed, gaps",
    [
        (1_000_000, True, {}),
        (1_000_000, False, {}),
        (40, True, {}),
        (3, True, {"coordinates_ms": 70, "chunk_ms": 330, "general_ms": 450}),
        (1_000_000, True, {"coordinates_ms": 70, "chunk_ms": 9000, "general_ms": 130}),
    ],
)
def test_grains_change_no_burst(spark, hot_rows, fixed, gaps):
    opts = Options(**SMALL, **gaps, show_count_after=7, hot_rows=hot_rows, block_rows=4)
    rows = all_patterns(11, fixed)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    placed = with_bursts(df, opts, key_grains(df, opts))
    assert placed.columns == with_bursts(df, opts).columns
    got = mark_reports(decide(placed, opts), opts).collect()
    assert {(r.source, r.seq): {f: r[f] for f in FIELDS} for r in got} == suppress(rows, opts)
    assert len(got) == len(rows)


@pytest.mark.parametrize("hot_rows, n_cells", [(1_000_000, 100 * 2000 // 2000 + 100 * 2000 // 100), (15, 2 * 2000)])
def test_long_gaps_take_few_moments(spark, hot_rows, n_cells):
    """Two keys log every 100 ms; only the one with short gaps needs a cell for each row, unless the log is busy."""
    opts = Options(fuzzy=False, hot_rows=hot_rows)
    df = spark.range(4000).selectExpr(
        "concat('k', id % 2) AS logger",
        "'INFO' AS level",
        "'t' AS leader_template",
        "(id div 2) * 100 AS event_ms",
        "'s' AS source",
        "id AS seq",
        "CASE id % 2 WHEN 0 THEN 2000 ELSE 100 END AS window_ms",
    )
    grains = key_grains(df, opts)
    assert sorted(r.grain for r in grains.collect()) == [100, 2000]
    cells = _with_cell(df, opts, grains).select("logger", "cell").distinct()
    assert cells.count() == n_cells
    assert with_bursts(df, opts, grains).agg(F.max("n")).first()[0] == 2000
