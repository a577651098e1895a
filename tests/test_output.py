import pytest
from pyspark.sql import functions as F

from hushlog import Options
from hushlog.functions.text import suppressed_suffix
from hushlog.operators.output import (
    deduplicated,
    route_stats,
    suppression_stats,
    suppression_totals,
)
from hushlog.operators.reports import notices
from hushlog.operators.route import route
from hushlog.operators.templates import keyed
from hushlog.plans.suppression import decisions, quiet_log

MARKED = (
    "kind string, source string, seq long, event_ms long, logger string, level string,"
    " leader_template string, message string, n long, duration_ms long, report boolean"
)
EVENTS = (
    "kind string, source string, seq long, event_ms long, logger string, level string,"
    " message string"
)


def marked(kind, logger, message, seq=1, n=10, ms=5000, report=True):
    return (kind, "s", seq, 1000, logger, "INFO", "t", message, n, ms, report)


def test_suffix_rounds_half_up(spark):
    cases = [(10, 5000, "9 times over 5.0s"), (2, 250, "1 times over 0.3s"), (2, 1050, "1 times over 1.1s")]
    cases += [(5, 0, "4 times over 0.0s"), (5, 49, "4 times over 0.0s"), (7, 123_456, "6 times over 123.5s")]
    df = spark.createDataFrame(cases, "n long, ms long, expected string")
    got = df.select(suppressed_suffix(F.col("n"), F.col("ms")).alias("s"), "expected").collect()
    assert [r.s for r in got] == [f" [suppressed {r.expected}]" for r in got]


def test_notice_texts(spark):
    trace = "a.FooException: x\n\tat a.B.c(B.java:1)\n\tat a.B.c(B.java:2)"
    rows = [
        marked("structured", "app", "x", 1),
        marked("structured", None, None, 2),
        marked("numeric", "app", "y" * 100, 3),
        marked("structured", "app", "y" * 101, 4),
        marked("structured", "System.out", "x", 5),
        marked("console", "System.err", trace, 6),
        marked("console", "System.out", "z" * 150, 7),
        marked("structured", "app", "x", 8, report=False),
    ]
    df = spark.createDataFrame(rows, MARKED)
    suffix = " [suppressed 9 times over 5.0s]"
    own = {
        1: "[app] x" + suffix,
        2: "[null] " + suffix,
        3: f"[app] {'y' * 100}" + suffix,
        4: f"[app] {'y' * 100}..." + suffix,
    }
    inline = {6: trace.rpartition("\n")[0] + suffix, 7: "z" * 150 + suffix}
    got = {r.seq: r.text for r in notices(df).collect()}
    assert got == own | inline
    quiet = notices(df, Options(show_notices=False, clean_traces=False)).collect()
    assert {r.seq: r.text for r in quiet} == inline | {6: trace + suffix}
    assert {r.suppressed for r in quiet} == {9}


def events(spark, rows):
    return spark.createDataFrame(
        [(kind, "s", i, 1000 + i, logger, level, m) for i, (kind, logger, level, m) in enumerate(rows)],
        EVENTS,
    )


def test_surviving_log(spark):
    opts = Options(fuzzy=False, deny_loggers=("bad",), show_count_after=30, report_by_time=False)
    rows = [("console", "System.out", "INFO", "spam")] * 50
    rows += [("structured", "app", "ERROR", "boom 5ms")] * 40
    rows += [("structured", "bad", "ERROR", "never")] * 3
    rows += [("structured", "app", None, "no level")] * 30
    df = events(spark, rows)
    got = quiet_log(df, opts).collect()
    spam = [r for r in got if r.logger == "System.out"]
    assert [r.message for r in sorted(spam, key=lambda r: r.seq)] == ["spam"] * 20 + [
        "spam [suppressed 29 times over 0.0s]"
    ]
    assert sum(r.message == "boom 5ms" for r in got) == 5
    assert sum(r.message == "no level" for r in got) == 30
    own = [r for r in got if r.logger == opts.notice_logger]
    assert [(r.level, r.message) for r in own] == [
        ("INFO", "[app] boom 5ms [suppressed 29 times over 0.0s]")
    ]
    assert not any(r.logger == "bad" for r in got)

    routed = route(df, opts)
    total = route_stats(routed).first()
    assert (total.n_rows, total.processed, total.denied_by_list) == (123, 90, 3)
    decided = decisions(df, opts)
    stats = suppression_stats(decided).first()
    assert (stats.processed, stats.suppressed) == (90, 65)
    assert stats.rate_pct == pytest.approx(6500 / 90)
    by_key = {r.level: r.suppressed for r in suppression_stats(decided, "level").collect()}
    assert by_key == {"INFO": 30, "ERROR": 35}
    quick = suppression_totals(keyed(routed.filter("route = 'check'"), opts), "level", opts=opts)
    assert {r.level: r.suppressed for r in quick.collect()} == by_key
    # the notices pass when the surviving log is read again
    again = deduplicated(decisions(events(spark, [("structured", opts.notice_logger, "INFO", "n")] * 30), opts),
        route(events(spark, [("structured", opts.notice_logger, "INFO", "n")] * 30), opts), opts)
    assert again.count() == 30


def test_switched_off_passes_everything(spark):
    rows = [("structured", "app", "INFO", "same")] * 40
    for opts in (Options(enabled=False), Options(debug_mode=True)):
        assert quiet_log(events(spark, rows), opts.with_(fuzzy=False)).count() == 40
    empty = suppression_totals(
        keyed(events(spark, rows).filter("false"), Options(fuzzy=False)), opts=Options(fuzzy=False)
    )
    assert tuple(empty.first()) == (0, 0, 0.0)


def test_near_copies_share_a_burst(spark):
    opts = Options(similarity_threshold=90, info_threshold=2)
    pumps = [f"pump {name} runs dry, valve shut" for name in ("alpha", "alpna", "alphq", "omega-nine")]
    df = events(spark, [("structured", "plant", "INFO", m) for m in pumps * 3])
    merged = quiet_log(df, opts).filter("kind = 'structured'").groupBy("message").count().collect()
    # the first pump leads two others; only the last one is a template of its own
    assert {r.message: r["count"] for r in merged} == {pumps[0]: 1, pumps[1]: 1, pumps[3]: 2}
    apart = quiet_log(df, opts.with_(fuzzy=False)).groupBy("message").count().collect()
    assert {r["count"] for r in apart} == {2} and len(apart) == 4
