import re
from collections import Counter

from fixtures import SF_DIR, clashing, frame, odd_rows
from pyspark.sql import functions as F

from hushlog.llm.quality_rules import (
    MEASURES,
    RULES,
    Rule,
    cascade_order,
    n_repeat_words,
    rule_costs,
    with_measures,
    with_verdict,
)

WORD = re.compile("[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(i, i + 5))
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_of_odd_texts(spark):
    texts = [r[1] for r in odd_rows()] + [
        "a b c d e a b c d e",
        "a b c d e f a b c d e",
        "x " * 40,
        "one\n\ntwo\none\n  \none",
        "  lead and trail\r\n\x0b\x0c ",
        "a b   c\x1cd é日",
        "# $ % & | < > * #|",
    ]
    docs = frame(spark, [(i, t, "", "", i) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in with_measures(clashing(docs, "n_words")).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][m] for m in MEASURES) == measured(text or ""), repr(text)[:80]


def test_rules_on_plain_cases(spark):
    clean = " ".join(f"word{i} comes here, then" for i in range(30)) + "."
    cases = {
        "few_words": "only a few words",
        "repeated_windows": "again and again and " * 20,
        "symbols": " ".join(f"w{i}x ###" for i in range(40)),
        "shouting": " ".join(f"LOUD{chr(65 + i)}{chr(65 + j)}," for i in range(9) for j in range(9)),
        "exclamations": " ".join(f"wo{i}rd!" for i in range(40)),
        "copied_lines": "\n".join(["a line that comes again, as it seems"] * 3) + "\n" + "x y " * 3,
        "odd_words": " ".join("x" * 40 + str(i) for i in range(20)),
        "few_letters": " ".join(f"{i}{i}" for i in range(100)),
        "bullets": "\n".join(f"- point {i} of the list is here" for i in range(9)),
        "cut_lines": "\n".join(f"more about number {i} of these ..." for i in range(9)),
        "clean": clean,
    }
    docs = frame(spark, [(i, t) for i, t in enumerate(cases.values())], "doc_id long, text string")
    text = F.col("text")
    flags = docs.select("doc_id", *[r.rejects(text).alias(r.name) for r in RULES]).collect()
    names = list(cases)
    for row in flags:
        name = names[row.doc_id]
        if name == "clean":
            assert not any(row[r.name] for r in RULES)
        else:
            assert row[name] is True
    verdicts = {names[r.doc_id]: r.kept for r in with_verdict(docs).collect()}
    assert [n for n, kept in verdicts.items() if kept] == ["clean"]


def test_order_follows_rejection_per_cost_and_keeps_the_verdict(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionAll(
        spark.read.parquet(f"{SF_DIR}/documents.parquet")
    )
    order = cascade_order(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in RULES)
    straight = {r.doc_id: r.kept for r in with_verdict(docs).collect()}
    turned = {r.doc_id: r.kept for r in with_verdict(docs, RULES[::-1]).collect()}
    assert straight == turned


def test_costs_are_measured(spark):
    """Of rules that reject the same rows the one that takes less time comes first."""
    docs = spark.range(600).select(
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), i + F.col("id")))).alias("text")
    ).withColumn("text", F.concat(F.col("text"), F.when(F.rand(3) < 0.3, " end").otherwise("")))
    light = Rule("light", lambda t: t.endswith(" end"))
    heavy = Rule("heavy", lambda t: t.endswith(" end") & (n_repeat_words(t) >= 0) | (n_repeat_words(t) < 0))
    never = Rule("never", lambda t: F.length(t) < 0)
    for rules in ([heavy, never, light], [light, heavy, never]):
        assert [r.name for r in cascade_order(docs, rules)][0] == "light"
    cost = rule_costs(docs.withColumnRenamed("text", "t"), [light, heavy])
    assert cost[1] > 3 * cost[0] > 0


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "Kept", "rejected_by")
    got = with_verdict(docs)
    assert got.count() == len(rows)
    assert [c for c in got.columns if c.lower() == "kept"] == ["kept"]
    assert got.where("text is null and kept").count() == 0
    assert with_verdict(docs.limit(0)).count() == 0
