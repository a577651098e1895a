"""Quality rules as a short-circuit cascade of native expressions.

A rule is a boolean column over the text. A written sample of the table is put to every rule, which
gives its cost (measured, one small job a rule) and shows which rules reject what others leave. The
rules then run in the order of rejection per cost inside one ``CASE``, so that most bad texts meet
only cheap rules. The order never changes which texts are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlog.functions.checkpoints import forget, stored
from hushlog.llm.arrow import without

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Rows expected in the sample that orders the rules; it has no part in any verdict.
SAMPLE_ROWS = 1000
#: A rule's cost is the least time of this many runs over the sample.
RUNS = 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` needs it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_of(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(
        lines_of(text), lambda ls: F.size(ls).cast("long") - F.size(F.array_distinct(ls))
    )


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the sorted ``starts``."""
    steps = F.transform(
        starts,
        lambda at, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW))
        ),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def _repeated_starts(windows: Column) -> Column:
    """Sorted places of the windows that occur twice or more."""
    ordered = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def twins(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(p["h"] == F.get(pairs, j)["h"], F.lit(False))
        kept = F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))
        return F.sort_array(F.transform(kept, lambda p: p["i"]))

    return let(ordered, twins)


def n_repeat_words(text: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
        return F.transform(
            F.coalesce(at, F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )

    def repeated(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(_repeated_starts(w), _covered)
        )

    return let(let(hashes, windows), repeated)


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is never null."""

    name: str
    rejects: Callable[[Column], Column]
    base: bool = False


def _share(part: Column, per_cent: int, whole: Column) -> Column:
    return 100 * part > per_cent * whole


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def _words_share(pattern: str, per_cent: int) -> Callable[[Column], Column]:
    return lambda text: let(
        words_of(text),
        lambda ws: _share(
            F.size(F.filter(ws, lambda word: word.rlike(pattern))), per_cent, F.size(ws)
        ),
    )


def _copied_lines(text: Column) -> Column:
    """More than half of what the lines hold is in lines that came before."""
    return let(
        lines_of(text),
        lambda ls: F.length(F.array_join(ls, ""))
        > 2 * F.length(F.array_join(F.array_distinct(ls), "")),
    )


def _odd_words(text: Column) -> Column:
    words, chars = n_words(text), word_chars(text)
    return (chars < 2 * words) | (chars > 30 * words)


def _lines_share(pattern: str, per_cent: int) -> Callable[[Column], Column]:
    return lambda text: let(
        lines_of(text),
        lambda ls: (F.size(ls) > 3)
        & _share(F.size(F.filter(ls, lambda line: line.rlike(pattern))), per_cent, F.size(ls)),
    )


#: In the order of explanation: thresholds are shares in per cent.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda t: n_words(t) < 10, base=True),
    Rule("repeated_windows", lambda t: _share(n_repeat_words(t), 20, n_words(t)), base=True),
    Rule("symbols", lambda t: _share(n_symbols(t), 20, n_words(t))),
    Rule("shouting", _words_share(r"\A[^\p{L}]*\p{Lu}{2,}[^\p{L}]*\z", 50)),
    Rule("exclamations", lambda t: _share(_count(t, "!"), 30, n_words(t))),
    Rule("copied_lines", _copied_lines),
    Rule("odd_words", _odd_words),
    Rule("few_letters", _words_share(r"\A[^\p{L}]*\z", 50)),
    Rule("bullets", _lines_share(r"\A[ \t]*[-•*·][ \t]", 90)),
    Rule("cut_lines", _lines_share(r"(\.\.\.|…)[ \t\r]*\z", 50)),
)


def _sample(docs: DataFrame, text: str) -> DataFrame:
    """About ``SAMPLE_ROWS`` texts ``t`` of the whole table, written; every task draws its own share."""
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    drawn = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).sample(fraction=share, seed=11)
    return stored(drawn, "sample")


def _seconds(texts: DataFrame, value: Column) -> float:
    job = texts.agg(F.sum(value.cast("long")))
    taken = []
    for _ in range(RUNS):
        start = time.perf_counter()
        job.collect()
        taken.append(time.perf_counter() - start)
    return min(taken)


def rule_costs(texts: DataFrame, rules: Sequence[Rule] = RULES) -> list[float]:
    """Seconds that each rule takes over the texts ``t``, above what reading them takes."""
    one_task = texts.coalesce(1)
    reading = _seconds(one_task, F.length("t"))
    # no rule is free: less than a hundredth of the reading is not told apart
    return [max(_seconds(one_task, r.rejects(F.col("t"))) - reading, reading / 100) for r in rules]


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[Rule]:
    """``rules`` by rejection per cost, each judged on the sample's texts that the ones before left.

    The driver gets times and a count for each set of rules that reject the same rows.
    """
    texts = _sample(docs, text)
    failed = F.array_compact(
        F.array(*[F.when(r.rejects(F.col("t")), F.lit(i)) for i, r in enumerate(rules)])
    )
    seen = texts.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n")).collect()
    cost = rule_costs(texts, rules)
    forget(texts)
    left, order = list(range(len(rules))), []
    while left:
        gain = {
            i: sum(s.n for s in seen if i in s.failed and not set(order) & set(s.failed)) / cost[i]
            for i in left
        }
        best = min(left, key=lambda i: (-gain[i], cost[i], i))
        order.append(best)
        left.remove(best)
    return [rules[i] for i in order]


def rejected_by(text: Column, ordered: Sequence[Rule]) -> Column:
    """The first rule in this order that rejects the text; later ones are not worked out."""
    case = F.lit(None).cast("string")
    for rule in reversed(ordered):
        case = F.when(rule.rejects(text), F.lit(rule.name)).otherwise(case)
    return case


def with_verdict(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text"
) -> DataFrame:
    """``docs`` with ``rejected_by`` (a rule, or null) and ``kept``.

    A null text counts as empty and fails ``few_words``. Rows are judged on their own text alone,
    so repeated rows get the same verdict. Which of several failing rules is named depends on the
    sample and the times measured on it; ``kept`` does not. Columns of these names are replaced. An empty table stays empty.
    """
    ordered = cascade_order(docs, rules, text)
    judged = without(docs, ["rejected_by", "kept"]).withColumn(
        "rejected_by", rejected_by(F.col(text), ordered)
    )
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (null text: all 0) and ``base_failed``."""
    names = [*MEASURES, "base_failed"]
    df = without(docs, names)
    df = df.select("*", *[make(F.col(text)).alias(name) for name, make in MEASURES.items()])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)
