"""Lists of loggers as tables: the same routes as the literal lists."""

import random

import pytest

from hushlog import Options
from hushlog.operators.route import route
from hushlog.plans.suppression import quiet_log

SCHEMA = "kind string, seq long, logger string, level string, message string"


def log(spark, loggers):
    rng = random.Random(3)
    rows = [("structured", i, name, rng.choice(["INFO", "ERROR", None]), "m") for i, name in enumerate(loggers)]
    return spark.createDataFrame(rows, SCHEMA)


def names(spark, loggers):
    return spark.createDataFrame([(name, 1) for name in loggers], "logger string, seq long")


@pytest.mark.parametrize("list_bytes", [64 << 20, -1])
@pytest.mark.parametrize("deny, allow", [(["a"], []), ([], ["a", "b"]), (["a", "x"], ["a", "b"]), ([], [])])
def test_tables_route_like_literal_lists(spark, monkeypatch, deny, allow, list_bytes):
    monkeypatch.setattr("hushlog.operators.route.LIST_BYTES", list_bytes)
    df = log(spark, ["a", "b", "c", None, "A", "a.b", ""] * 6)
    literal = route(df, Options(deny_loggers=deny, allow_loggers=allow))
    # nulls and repeats on a list change nothing
    by_table = route(df, Options(), names(spark, deny * 2 + [None]), names(spark, allow + allow[:1]))
    mixed = route(df, Options(deny_loggers=deny[:1], allow_loggers=allow[:1]), names(spark, deny[1:]), names(spark, allow[1:]))
    want = sorted(map(tuple, literal.collect()), key=str)
    for got in (by_table, mixed):
        assert got.columns == literal.columns
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_many_loggers_and_a_list_made_from_the_log(spark):
    df = spark.range(200_000).selectExpr(
        "'structured' AS kind", "id AS seq", "concat('svc.', id % 150000) AS logger", "'INFO' AS level", "'m' AS message"
    )
    listed = spark.range(100_000).selectExpr("concat('svc.', id) AS logger")
    routed = route(df, Options(), deny=listed)
    assert routed.filter("(route = 'deny') != (seq % 150000 < 100000)").isEmpty()
    assert routed.filter("route = 'deny'").count() == 150_000
    assert "BroadcastHashJoin" in routed._jdf.queryExecution().executedPlan().toString()
    own = df.filter("seq < 10")
    assert route(df, Options(), deny=own, allow=own).filter("route = 'deny'").count() == 20


def test_names_of_the_join_may_be_taken(spark):
    df = log(spark, ["a", "b", None]).selectExpr("*", "'x' AS Listed_Logger", "7 AS is_listed", "'old' AS route")
    got = route(df, Options(), deny=names(spark, ["a"]), allow=names(spark, ["b"]))
    assert sorted(got.columns) == sorted(df.columns)
    assert {(r.Listed_Logger, r.is_listed) for r in got.collect()} == {("x", 7)}


def test_the_surviving_log_follows_the_tables(spark):
    schema = "kind string, source string, seq long, event_ms long, logger string, level string, message string"
    rows = [("structured", "s", i, 1000 + i, ["a", "b", "c"][i % 3], "INFO", "m") for i in range(90)]
    df = spark.createDataFrame(rows, schema)
    got = quiet_log(df, Options(fuzzy=False), deny=names(spark, ["a"]), allow=names(spark, ["a", "b"]))
    counts = {r.logger: r["count"] for r in got.groupBy("logger").count().collect()}
    assert counts == {"b": 20, "c": 30}
