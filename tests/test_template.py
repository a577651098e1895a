import pytest

from hushlog import Options
from hushlog.operators.templates import template_stats, with_label, with_template

UUID = "0f3c9a71-22be-4d10-9c5e-7ab1d4e80f26"
OTHER_UUID = "c40e5d92-81fa-4b3c-b6d7-19e0a25f7c38"

VECTORS = [
    # nothing volatile
    (None, ""),
    ("", ""),
    ("disk is healthy",) * 2,
    ("com.acme.billing.Worker2",) * 2,
    ("job night:sync needs disk:ssd",) * 2,
    # one kind of token
    (f"{UUID} replaced {OTHER_UUID}", "*UUID* replaced *UUID*"),
    ("buffer@7fe03c11 freed", "buffer@* freed"),
    ("mail ops@cafe now",) * 2,
    ("drone idles (3.25, 0.5, -18.75)", "drone idles (*, *, *)"),
    ("grid [3, -12] dirty, grid [0,0] clean", "grid [*, *] dirty, grid [*, *] clean"),
    ("flush 87ms, sync 9ms", "flush *ms, sync *ms"),
    ("behind by 6 ticks", "behind by * ticks"),
    ("drift 0.75, -2.5", "drift *"),
    ("near 4.5, 6.25, 8.125", "near *"),
    # several kinds
    (f"[8, 0] of {UUID} drawn (0.5, 1.5, 2.5) in 3ms", "[*, *] of *UUID* drawn (*, *, *) in *ms"),
    (f"lease@9b00c4de5f held by {UUID} for 2 ticks", "lease@* held by *UUID* for * ticks"),
    # tokens are consumed whole, left to right
    ("ip 192.168.1.1 ok", "ip 192.168.1.1 ok"),
    ("a-1.5 b", "a-1.5 b"),
    ("took 1.5.", "took 1.5."),
    (f"id-{UUID} x", f"id-{UUID} x"),
    ("1.2.3ms", "1.2.*ms"),
    ("log4ms", "log*ms"),
    ("pos(1.0, 2.0, 3.0)", "pos(*)"),
    ("1.5, 2, 3abc", "*abc"),
    ("@0123456789abcdef01 z", "@*01 z"),
    ("$5 \\ 7.5 x", "$5 \\ * x"),
    # a float inside parentheses or brackets is not a triple or a pair
    ("(5.5)", "(*)"),
    ("[5.5]", "[*]"),
    ("(1, 2)", "(1, 2)"),
    ("[1, 2, 3]", "[1, 2, 3]"),
    ("[1,   -2]", "[*, *]"),
    ("(1,2,3)(4,5,6)", "(*, *, *)(*, *, *)"),
    ("x(1,2,3)", "x(1,2,3)"),
    ("-5ms and - 5 tick", "*ms and - * tick"),
    (f"{UUID}0 {UUID.upper()}", f"{UUID}0 *UUID*"),
    ("deadbeef-dead-beef-dead-beefdeadbeef", "*UUID*"),
    ("user@12345 user@123456", "user@12345 user@*"),
    ("line one 5ms\nline two 6.5", "line one *ms\nline two *"),
    ("naïve – 7.25 ünïcode 5ms", "naïve – * ünïcode *ms"),
    ("a5ms", "a*ms"),
]


def templates(spark, messages, opts):
    df = spark.createDataFrame(list(enumerate(messages)), "i int, message string")
    rows = with_template(df, opts).orderBy("i").collect()
    return [row.template for row in rows]


def test_vectors(spark):
    got = templates(spark, [m for m, _ in VECTORS], Options())
    assert got == [expected for _, expected in VECTORS]


@pytest.mark.parametrize(
    "option, message, expected",
    [
        ("normalize_uuids", f"{UUID} left, 4ms", f"{UUID} left, *ms"),
        ("normalize_addresses", "buffer@7fe03c11 freed", "buffer@7fe03c11 freed"),
        ("normalize_timings", "flush 87ms at 0.5", "flush 87ms at *"),
        ("normalize_coordinates", "grid [8, 0] drawn in 3ms", "grid [8, 0] drawn in *ms"),
        ("normalize_coordinates", "near (4.5, 6.25, 8.125) or 0.5", "near (4.5, 6.25, 8.125) or 0.5"),
    ],
)
def test_one_kind_switched_off(spark, option, message, expected):
    assert templates(spark, [message], Options(**{option: False})) == [expected]


def test_all_kinds_switched_off(spark):
    opts = Options(
        normalize_coordinates=False,
        normalize_uuids=False,
        normalize_addresses=False,
        normalize_timings=False,
    )
    message = f"{UUID} freed @7fe03c11 near (3.25, 0.5, -18.75), 87ms"
    assert templates(spark, [message, None], opts) == [message, ""]


def test_stats_group_nulls_and_order_top(spark):
    df = spark.createDataFrame(
        [
            ("a", "INFO", "took 5ms", 10),
            ("a", "INFO", "took 6ms", 30),
            (None, "INFO", "took 7ms", 20),
            (None, "INFO", "took 8ms", 5),
            (None, "INFO", None, 7),
            ("a", None, "took 8ms", 9),
        ],
        "logger string, level string, message string, event_ms long",
    )
    stats = template_stats(with_template(df))
    got = {(r.logger, r.level, r.template): (r.first_ms, r.last_ms, r.n_rows) for r in stats.collect()}
    assert got == {
        ("a", "INFO", "took *ms"): (10, 30, 2),
        (None, "INFO", "took *ms"): (5, 20, 2),
        (None, "INFO", ""): (7, 7, 1),
        ("a", None, "took *ms"): (9, 9, 1),
    }
    top = template_stats(with_template(df), top=1).collect()
    assert [(r.logger, r.n_rows) for r in top] == [(None, 2)]


def test_label(spark):
    df = spark.createDataFrame([("INFO", None, "x")], "level string, logger string, template string")
    assert with_label(df).first().label == "[INFO/null] x"
    plan = with_label(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
