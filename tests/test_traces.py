import random

import pytest

from hushlog import Options
from hushlog.operators.traces import FRAMEWORK_PACKAGES, clean_traces, frames, hot_frames


def at(method, place, indent="\t"):
    return f"{indent}at {method}({place})"


LOCKED = [
    "shop.cart.CheckoutFailed: basket 7 is locked",
    at("shop.cart.Basket.lock", "Basket.java:118"),
    at("org.apache.logging.log4j.Logger.trace", "Logger.java:9"),
    at("shop.web.Front.pay", "Front.kt:77"),
    at("shop.cart.Basket.lock", "Basket.java:131"),
    at("jdk.internal.reflect.Direct.call", "Native Method"),
    at("shop.web.Front.pay", "Front.kt:80"),
    at("shop.Start.main", "Start.kt:3"),
]


def clean(spark, texts, **changes):
    df = spark.createDataFrame(list(enumerate(texts)), "trace_id int, text string")
    rows = clean_traces(df, Options(**changes)).collect()
    assert len(rows) == len(texts)
    return [r.text for r in sorted(rows, key=lambda r: r.trace_id)]


def picked(*places):
    return "\n".join(LOCKED[i] for i in places)


def test_one_trace_under_each_option(spark):
    whole = "\n".join(LOCKED)
    assert clean(spark, [whole]) == [picked(0, 1, 2, 3, 5, 7)]
    assert clean(spark, [whole], clean_traces=False) == [whole]
    assert clean(spark, [whole], drop_framework_frames=True) == [picked(0, 1, 3, 7)]
    assert clean(spark, [whole], max_depth=3) == [picked(0, 1, 2, 3) + "\n\t... 4 more"]
    both = clean(spark, [whole], max_depth=2, drop_framework_frames=True)
    assert both == [picked(0, 1, 3) + "\n\t... 5 more"]


def test_a_cause_starts_anew(spark):
    step = at("shop.Step.run", "Step.java:5")
    text = "\n".join(["shop.Broken", step, step, "Caused by: shop.Deeper", step, step, "\tat nowhere", "... 2 more"])
    short = "\n".join(["shop.Broken", step, "Caused by: shop.Deeper", step, "\tat nowhere", "... 2 more"])
    assert clean(spark, [text]) == [short]
    # no segment has a second frame left, so nothing is cut
    assert clean(spark, [text], max_depth=1) == [short]


def test_the_cut_line_is_indented_like_the_first_frame_it_replaces(spark):
    text = "\n".join(["e", at("p.A.f", "1", "    "), at("p.A.g", "2", "      "), "Suppressed: z", at("p.A.f", "3")])
    assert clean(spark, [text], max_depth=1) == ["e\n" + at("p.A.f", "1", "    ") + "\n      ... 3 more"]


def test_nothing_to_clean(spark):
    odd = [None, "", "one line", "ends in breaks\n\n", "\nstarts with a break"]
    assert clean(spark, odd) == [None, "", "one line", "ends in breaks", "\nstarts with a break"]


METHODS = ["shop.A.run", "shop.A.stop", "shop.b.C.<init>", "sun.reflect.Call.go", ".odd", "d.E.f(g"]
TEXTS = ["", " ", "text", "\t... 7 more", "... more", "  at broken", "\tat noDot(X)", "at a.b.open(X", "Caused"]


def made_trace(rng):
    """Lines without and method of lines with a frame; a number tells each frame line apart."""
    lines, method_of, segment_of = ["shop.Failed: it"], {}, [0]
    for number in range(rng.randrange(1, 20)):
        kind = rng.randrange(8)
        if kind == 0:
            lines.append(rng.choice(["Caused by: x.Y", "\tSuppressed: z"]))
        elif kind <= 2:
            lines.append(rng.choice(TEXTS))
        else:
            method = rng.choice(METHODS)
            lines.append(at(method, f"F:{number}", rng.choice(["\t", "  ", ""])))
            method_of[len(lines) - 1] = method
        segment_of.append(segment_of[-1] + (kind == 0))
    lines.append("end")
    return lines, method_of, segment_of + segment_of[-1:]


@pytest.mark.parametrize("drop", [False, True])
def test_what_stays_of_random_traces(spark, drop):
    made = [made_trace(random.Random(seed)) for seed in range(200)]
    got = clean(spark, ["\n".join(lines) for lines, _, _ in made], drop_framework_frames=drop)
    for (lines, method_of, segment_of), text in zip(made, got):
        first = {}
        for i, method in method_of.items():
            first.setdefault((segment_of[i], method), i)
        plumbing = {i for i, m in method_of.items() if drop and m.startswith(FRAMEWORK_PACKAGES)}
        stay = set(range(len(lines))) - set(method_of) | set(first.values()) - plumbing
        assert text.split("\n") == [lines[i] for i in sorted(stay)]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_a_depth_limit_keeps_a_head_of_the_unlimited_result(spark, limit):
    made = [made_trace(random.Random(1000 + seed)) for seed in range(150)]
    texts = ["\n".join(lines) for lines, _, _ in made]
    cut_traces = 0
    for (lines, method_of, segment_of), all_kept, text in zip(
        made, clean(spark, texts), clean(spark, texts, max_depth=limit)
    ):
        place = {lines[i]: i for i in method_of}
        depths = {}
        for i in (place[line] for line in all_kept.split("\n") if line in place):
            depths[segment_of[i]] = depths.get(segment_of[i], 0) + 1
        if max(depths.values(), default=0) <= limit:
            assert text == all_kept
            continue
        cut_traces += 1
        *head, last = text.split("\n")
        assert all_kept.split("\n")[: len(head)] == head
        ended = all_kept.split("\n")[len(head)]
        assert last == f"{ended[:ended.index('at ')]}... {len(lines) - len(head)} more"
        frames_there = [segment_of[place[line]] for line in head if line in place]
        assert frames_there.count(segment_of[place[ended]]) == limit
        assert all(frames_there.count(s) <= limit for s in set(frames_there))
    assert cut_traces > 10


def test_frame_table(spark):
    df = spark.createDataFrame([("t", "\n".join(LOCKED))], "trace_id string, text string")
    rows = frames(df, Options(drop_framework_frames=True)).orderBy("pos").collect()
    assert [r.kind for r in rows] == ["other"] + ["frame"] * 7
    assert [r.package for r in rows] == [
        None,
        "shop.cart",
        "org.apache.logging.log4j",
        "shop.web",
        "shop.cart",
        "jdk.internal.reflect",
        "shop.web",
        "shop",
    ]
    assert [r.depth for r in rows] == [None, 0, None, 1, None, None, None, 2]
    assert [r.pos for r in rows if r.is_dup] == [4, 6]
    hot = {r.package: (r.n_frames, r.n_kept) for r in hot_frames(df, "package").collect()}
    assert hot["shop.cart"] == (2, 1) and hot["shop"] == (1, 1)
    plan = clean_traces(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_frames_need_no_shuffle(spark):
    text = "Caused by: a.X\n\tat p.A.b(A.java:1)\n\tat p.A.b(A.java:2)\n\n Suppressed: y\n\tat p.A.b(A.java:3)\n\tat q.C.d(C.java:4)"
    traces = spark.createDataFrame([("t", text)], "trace_id string, text string").repartition(2, "text")
    table = frames(traces, Options(max_depth=1))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    got = [(r.pos, r.segment, r.kind, r.is_dup, r.depth, r.kept) for r in table.orderBy("pos").collect()]
    assert got == [
        (0, 1, "cause", False, None, True),
        (1, 1, "frame", False, 0, True),
        (2, 1, "frame", True, None, False),
        (3, 1, "other", False, None, True),
        (4, 2, "cause", False, None, True),
        (5, 2, "frame", False, 0, True),
        (6, 2, "frame", False, 1, False),
    ]
