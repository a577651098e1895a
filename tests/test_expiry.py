"""Idle keys, late rows and rows without a time."""

import pytest
from model import suppress
from pyspark.sql import functions as F

from hushlog import Options
from hushlog.operators.bursts import burst_table, with_bursts
from hushlog.plans.views import written_in_slices
from hushlog.streaming.run import late_rows, new_folder, run_to_end, state_rows
from hushlog.streaming.suppress import suppress_stream
from test_bursts import SCHEMA

OPTS = Options(fuzzy=False, show_count_after=7)
START = 1_700_000_000_000


def row(seq, ms, template="t"):
    names = [field.split()[0] for field in SCHEMA.split(",")]
    values = {
        "kind": "structured",
        "source": "s",
        "seq": seq,
        "event_ms": START + ms,
        "logger": "app",
        "level": "ERROR",
        "leader_template": template,
        "message": template,
        "window_ms": 2000,
    }
    return {name: values[name] for name in names}


def as_table(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    return df.withColumn("event_ts", F.timestamp_millis("event_ms"))


def decided_in_slices(spark, tables, delay):
    folder = new_folder(spark, "slices") + "/rows"
    for table, n in tables:
        written_in_slices(table, folder, n)
    stream = spark.readStream.schema(tables[0][0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    steps = []
    got = run_to_end(spark, stream, lambda s: suppress_stream(s, OPTS, delay), "decisions", steps=steps)
    return got.collect(), steps


def test_a_key_is_forgotten_and_born_again(spark):
    # the key "seldom" speaks in the first and the last minute, the key "often" all the time
    rows = [row(i, i * 100, "seldom") for i in range(30)]
    rows += [row(100 + i, 240_000 + i * 100, "seldom") for i in range(30)]
    rows += [row(200 + i, i * 1_500, "often") for i in range(160)]
    got, steps = decided_in_slices(spark, [(as_table(spark, rows), 8)], "2 seconds")
    want = suppress(rows, OPTS)
    fields = ["n", "first_ms", "duration_ms", "allowed", "report"]
    assert {(r.source, r.seq): {f: r[f] for f in fields} for r in got} == {
        place: {f: e[f] for f in fields} for place, e in want.items()
    }
    # one state while only "often" is known, two at both ends; the row that ends the stream waits for ever
    known = state_rows(steps)
    alone = known.index(1)
    assert 2 in known[:alone] and 2 in known[alone:] and known[-1] == 1
    lives = with_bursts(as_table(spark, rows), OPTS).groupBy("leader_template").agg(F.max("life_no").alias("n"))
    assert {r.leader_template: r.n for r in lives.collect()} == {"seldom": 2, "often": 1}
    assert late_rows(steps) == 0


def test_late_rows_are_counted(spark):
    rows = [row(i, i * 1_000) for i in range(120)]
    late = [row(900 + i, 5_000 + i) for i in range(3)]
    # a stream's first watermark is the year 1970: nothing from before that comes in time
    ancient = [row(990, -START), row(991, -START - 5)]
    got, steps = decided_in_slices(spark, [(as_table(spark, rows), 4), (as_table(spark, late), 1)], "10 seconds")
    assert sorted(r.seq for r in got) == list(range(120))
    assert late_rows(steps) == 3
    got, steps = decided_in_slices(spark, [(as_table(spark, ancient + rows[:9]), 1)], "10 seconds")
    assert sorted(r.seq for r in got) == list(range(9)) and late_rows(steps) == 2


def test_rows_without_a_time_fail_early(spark):
    rows = as_table(spark, [row(1, 1_000), row(2, 2_000)]).withColumn(
        "event_ms", F.when(F.col("seq") == 1, F.col("event_ms"))
    )
    for bursts in (with_bursts, burst_table):
        with pytest.raises(Exception, match="no event_ms"):
            bursts(rows, OPTS).collect()
