"""Wide rows are worked out once, however many narrow passes follow."""

import pytest
from pyspark.sql import functions as F

from hushlog.functions import template as tpl
from hushlog.options import Options
from hushlog.operators.output import deduplicated
from hushlog.operators.route import route
from hushlog.plans.suppression import decisions, leaders_of, quiet_log
from hushlog.sources.lines import assemble_messages, console_events


def counted(spark, df):
    """``df`` and an accumulator of the rows that were taken from it."""
    taken = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            taken.add(batch.num_rows)
            yield batch

    return df.mapInArrow(rows, df.schema), taken


def console_lines(spark, n):
    line = """CASE id % 5 WHEN 0 THEN concat('a.FooException: ', id) WHEN 4 THEN concat('took ', id, 'ms')
              ELSE '\tat a.B.c(B.java:1)' END AS line"""
    return spark.range(n).selectExpr("concat('s', id % 15 div 5) AS source", "id AS seq", "id AS event_ms", line)


def test_lines_are_read_once(spark):
    lines, taken = counted(spark, console_lines(spark, 600))
    messages = assemble_messages(lines, Options(block_rows=50))
    assert messages.count() == 240 and messages.agg(F.sum("n_lines")).first()[0] == 600
    assert taken.value == 600


def test_events_get_their_templates_once(spark):
    lines = console_lines(spark, 600).withColumnRenamed("line", "message")
    events, taken = counted(spark, console_events(lines, "stderr"))
    opts = Options(fuzzy=False, report_by_time=False)
    # 120 exceptions that differ, 120 timings and 360 frames that do not
    assert decisions(events, opts).filter("n > 3 AND message != ''").count() == 117 + 357
    assert taken.value == 600


def test_events_are_read_once_where_near_copies_are_merged(spark):
    kind = "CASE WHEN id % 3 = 0 THEN 'console' ELSE 'structured' END AS kind"
    message = """CASE WHEN id % 29 = 0 THEN NULL WHEN id % 4 = 0 THEN concat('o', id % 7, ' took ', id, 'ms on the way')
                 ELSE concat('a.FooException: o', id % 50, '\n\tat a.B.c(B.java:', id % 11, ')') END AS message"""
    rows = spark.range(900).selectExpr(
        kind,
        "concat('s', id % 5) AS source",
        "id AS seq",
        "id * 3 AS event_ms",
        "timestamp_millis(id * 3) AS event_ts",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'off' ELSE 'l' END AS logger",
        "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS level",
        message,
    )
    opts = Options(deny_loggers=("off",), show_count_after=10)
    events, taken = counted(spark, rows)
    got = sorted(map(str, quiet_log(events, opts).collect()))
    assert taken.value == 900
    # the same on rows that keep their texts, with leaders by text
    marked = decisions(rows, opts, leaders_of(rows, opts))
    assert got == sorted(map(str, deduplicated(marked, route(rows, opts), opts).collect()))
    assert 0 < len(got) < 700 and any("suppressed" in row for row in got)


def test_blocks_may_come_with_the_lines(spark):
    lines = console_lines(spark, 600)
    whole = assemble_messages(lines.withColumn("extra", F.col("seq") % 7)).collect()
    for width in (1, 3, 7):
        cut = lines.withColumn("extra", F.col("seq") % 7).withColumn("run", F.expr(f"seq div {width}"))
        got = assemble_messages(cut, block="run")
        assert got.columns == ["source", "seq", "event_ms", "extra", "message", "n_lines"]
        assert sorted(map(str, got.collect())) == sorted(map(str, whole))


PIECES = ["7", "-7", "1.5", "5ms", "\ue001", "\ue002", "ms", " tick", "@", "abcdef12", "beef", "-", "(", "[", ", ", ")", "]", ".", "x", "-3.5"]


@pytest.mark.parametrize("off", [{}, {"normalize_uuids": False, "normalize_timings": False}])
def test_skipped_scans_change_no_template(spark, monkeypatch, off):
    picks = [F.element_at(F.array(*map(F.lit, PIECES)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PIECES))) + 1).cast("int")) for k in range(6)]
    uuid = F.lit("0a1b2c3d-1111-2222-3333-444455556666")
    df = spark.range(20_000).select(F.concat(*picks, F.when(F.col("id") % 9 == 0, uuid).otherwise("")).alias("m")).cache()
    opts = Options(**off)
    skipping = [r[0] for r in df.select(tpl.template(F.col("m"), opts)).collect()]
    monkeypatch.setattr(tpl, "_MAY_CHANGE", tpl._MAY_HOLD_TOKENS)
    assert skipping == [r[0] for r in df.select(tpl.template(F.col("m"), opts)).collect()]
