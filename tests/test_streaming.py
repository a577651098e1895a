import random

from model import assemble, suppress
from pyspark.sql import functions as F

from hushlog import Options
from hushlog.streaming.assemble import assemble_stream
from hushlog.streaming.run import run_to_end
from hushlog.streaming.summary import burst_summary, stream_stats
from hushlog.streaming.suppress import suppress_stream
from test_bursts import SCHEMA, SMALL, random_rows


def as_stream(spark, df, folder, files=6):
    df.withColumn("event_ts", F.timestamp_millis("event_ms")).repartition(files).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)


def test_decisions_and_bursts_equal_the_model(spark, tmp_path):
    opts = Options(**SMALL, fuzzy=False, show_count_after=7)
    rows = random_rows("stream", 500, [0, 1, 1, 30, 150, 501, 2500, 20_001])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    stream = as_stream(spark, df, str(tmp_path / "rows"))
    expected = suppress(rows, opts)
    # files arrive out of order, so the watermark must lag by the whole log
    decided = run_to_end(spark, stream, lambda s: suppress_stream(s, opts, "30 days"), "decisions")
    got = decided.collect()
    fields = ["n", "first_ms", "duration_ms", "allowed", "report"]
    assert {(r.source, r.seq): {f: r[f] for f in fields} for r in got} == {
        place: {f: e[f] for f in fields} for place, e in expected.items()
    }
    assert len(got) == len(rows)

    bursts = run_to_end(spark, stream, lambda s: burst_summary(s, opts, "30 days"), "bursts")
    assert bursts.count() == sum(e["n"] == 1 for e in expected.values())
    assert bursts.agg(F.sum("suppressed")).first()[0] == sum(
        not e["allowed"] for e in expected.values()
    )

    decisions = as_stream(spark, decided, str(tmp_path / "decisions"))
    stats = run_to_end(spark, decisions, lambda s: stream_stats(s, "level", delay="30 days"), "stats")
    totals = stats.agg(F.sum("processed"), F.sum("suppressed")).first()
    assert tuple(totals) == (len(rows), sum(not e["allowed"] for e in expected.values()))


def test_messages_equal_the_model(spark, tmp_path):
    rng = random.Random(5)
    alphabet = ["", "plain", "a.FooException: x", "\tat a.B(B)", "Caused by: b.BarException", " ", "b"]
    rows, expected = [], {}
    for s in range(6):
        lines = rng.choices(alphabet, k=40)
        rows += [(f"s{s}", i, 1000 + i * 10, line) for i, line in enumerate(lines)]
        for i, message in assemble(lines):
            expected[f"s{s}", i] = message
    df = spark.createDataFrame(rows, "source string, seq long, event_ms long, line string")
    stream = as_stream(spark, df, str(tmp_path / "lines"), files=3)
    got = run_to_end(spark, stream, lambda s: assemble_stream(s, delay="1 hour"), "messages").collect()
    assert {(r.source, r.seq): r.message for r in got} == expected
    assert len(got) == len(expected)


def test_messages_stay_whole_over_long_silence_and_follow_the_options(spark, tmp_path):
    rows = [
        ("s", 0, 1_000, "a.FooException: x"),
        ("t", 0, 21_000, "plain"),
        ("s", 1, 101_500, "\tat a.B(B)"),
        ("t", 1, 200_000, ""),
    ]
    folder = str(tmp_path / "lines")
    for row in rows:
        df = spark.createDataFrame([row], "source string, seq long, event_ms long, line string")
        timed = df.withColumn("event_ts", F.timestamp_millis("event_ms"))
        timed.coalesce(1).write.mode("append").parquet(folder)
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    stream = reader.option("maxFilesPerTrigger", 1).parquet(folder)

    def messages(**given):
        got = run_to_end(spark, stream, lambda s: assemble_stream(s, **given), "messages").collect()
        return sorted((r.source, r.seq, r.message, r.n_lines) for r in got)

    assert messages() == [
        ("s", 0, "a.FooException: x\n\tat a.B(B)", 2),
        ("t", 0, "plain", 1),
    ]
    assert messages(opts=Options(detect_multiline=False)) == [
        ("s", 0, "a.FooException: x", 1),
        ("s", 1, "\tat a.B(B)", 1),
        ("t", 0, "plain", 1),
    ]


def test_surviving_stream_over_several_slices(spark):
    from hushlog.plans.suppression import quiet_log
    from hushlog.plans.views import written_in_slices
    from hushlog.streaming.run import new_folder
    from hushlog.streaming.survivors import surviving_stream

    trace = "java.io.IOException: x\n\tat a.B.c(B.java:1)\n\tat a.B.c(B.java:2)"
    rows = []
    for i in range(400):
        kind, logger, message = [("structured", "app", f"step {i % 3}"), ("console", "System.err", trace)][i % 2]
        level = None if i % 50 == 0 else "ERROR"
        rows.append((kind, "s", i, i * 700, "deny" if i % 31 == 0 else logger, level, message))
    schema = "kind string, source string, seq long, event_ms long, logger string, level string, message string"
    events = spark.createDataFrame(rows, schema).withColumn("event_ts", F.timestamp_millis("event_ms"))
    opts = Options(fuzzy=False, deny_loggers=("deny",), show_count_after=7)
    folder = new_folder(spark, "slices") + "/rows"
    written_in_slices(events, folder, 5)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_to_end(spark, stream, lambda s: surviving_stream(s, opts, "5 seconds"), "survivors")
    want = quiet_log(events, opts)
    assert got.columns == want.columns
    ordered = sorted((tuple(r) for r in want.collect()), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ordered
    assert any("suppressed" in r[6] and r[0] == "console" and "B.java:2" not in r[6] for r in ordered)
    assert any(r[5] is None for r in ordered) and not any(r[4] == "deny" and r[5] for r in ordered)
