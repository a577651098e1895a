"""Licence scan: ordered signature rules as native expressions over the text.

A text goes on only if it holds one of a few keywords; then only rules whose own keyword is there
look at its normalised words. A detection is an interval of words. One that lies inside another of
the same or a higher priority is suppressed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlog.llm.arrow import free_names, without
from hushlog.llm.license_rules import BASE, CERTAINTY, Signature, signatures
from hushlog.llm.quality_rules import let

#: Words are runs of digits, a-z and whatever is not ASCII, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EITHER_CASE_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What a text must hold to be looked at. Each keyword of a rule holds one of these, or "cc" and "by".
GATES = (
    "licen", "public", "copyright", "rights", "permission", "redistribut", "advertising", "endorse",
    "proprietary", "reproduced", "warranty", "liable", "software", "gpl", "fdl", "apache", "attribution",
    "bsd", "mpl", "cc0", "wtfpl", "openrail", "cecill", "opensource", "creative", "mozilla", "perl",
    "beer", "zlib", "unencumbered", "mulan", "copied",
)
START, END = "\x01", "\x02"
DETECTION = "array<struct<label:string,priority:int,start:int,end:int>>"


def _rows(rules: Sequence[Signature]) -> Column:
    """The rules by keyword, each keyword once."""
    by_keyword: dict[str, list[Signature]] = {}
    for rule in rules:
        by_keyword.setdefault(rule.keyword, []).append(rule)
    return F.array(
        *[
            F.struct(
                F.lit(f" {keyword}").alias("keyword"),
                F.array(
                    *[
                        F.struct(
                            F.lit(r.label).alias("label"),
                            F.lit(r.priority).alias("priority"),
                            F.lit(rf"(?<= )({r.pattern})(?= )").alias("pattern"),
                        )
                        for r in some
                    ]
                ).alias("rules"),
            )
            for keyword, some in by_keyword.items()
        ]
    )


def normalised(text: Column) -> Column:
    """The words in lower case with a space before and after each."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.array_remove(F.split(F.translate(text, upper, lower), BREAK), "")
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _places(norm: Column, rule: Column) -> Column:
    """Detections of one rule: its matches are marked in the text, and the marked words numbered."""
    marked = F.regexp_replace(norm, rule["pattern"], F.lit(f"{START}$1{END}"))

    def numbered(words: Column) -> Column:
        def at(mark: str) -> Column:
            spots = F.transform(
                words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)
            )
            return F.array_compact(spots)

        return F.zip_with(
            at(START),
            at(END),
            lambda a, b: F.struct(
                rule["label"].alias("label"),
                rule["priority"].alias("priority"),
                a.alias("start"),
                (b + 1).alias("end"),
            ),
        )

    found = let(F.split(F.trim(marked), " "), numbered)
    return F.when(F.regexp_like(norm, rule["pattern"]), found).otherwise(F.array().cast(DETECTION))


def detections(norm: Column, rules: Sequence[Signature]) -> Column:
    """All matches of the rules whose keyword the text holds."""
    near = F.filter(_rows(rules), lambda k: F.contains(norm, k["keyword"]))
    chosen = F.flatten(F.transform(near, lambda k: k["rules"]))
    return F.flatten(F.transform(chosen, lambda r: _places(norm, r)))


def resolved(found: Column) -> Column:
    """Detections in order, without those inside another of the same or a higher priority.

    Of equal intervals the one with the higher priority stays, then the first label by name.
    """
    levels = sorted(CERTAINTY, reverse=True)
    ordered = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"),
                (-d["end"]).alias("back"),
                (-d["priority"]).alias("low"),
                d["label"].alias("label"),
            ),
        )
    )
    state = F.struct(
        F.array(*[F.lit(-1) for _ in levels]).alias("ends"), F.array().cast(DETECTION).alias("kept")
    )

    def step(s: Column, d: Column) -> Column:
        end, priority = -d["back"], -d["low"]
        reached = F.array_max(
            F.transform(s["ends"], lambda e, i: F.when(F.lit(levels[0]) - i >= priority, e).otherwise(-1))
        )
        ends = F.transform(
            s["ends"],
            lambda e, i: F.when(F.lit(levels[0]) - i == priority, F.greatest(e, end)).otherwise(e),
        )
        row = F.struct(d["label"].alias("label"), priority.alias("priority"), d["start"].alias("start"), end.alias("end"))
        return F.struct(
            ends.alias("ends"),
            F.when(reached >= end, s["kept"]).otherwise(F.array_append(s["kept"], row)).alias("kept"),
        )

    return F.aggregate(ordered, state, step, lambda s: s["kept"])


def _gate(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        open_ = F.lit(False)
        for word in GATES:
            open_ = open_ | F.contains(low, F.lit(word))
        return open_

    by = text.rlike(r"[cC][cC][\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[bB][yY]")
    return let(F.lower(text), any_of) | by


def with_licenses(docs: DataFrame, rules: Sequence[Signature] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``licenses``.

    ``base`` holds the places of the base phrases, ``licenses`` the detections that no other one
    suppresses, both as label, priority and interval of words. A null text has no words and no
    detections, an empty table gives an empty one. Rows and other columns stay, whatever their names;
    columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = [Signature(label, 1, phrase, phrase) for label, phrase in BASE]
    every = list(signatures() if rules is None else rules)
    scanned = let(
        normalised(whole),
        lambda norm: F.struct(
            detections(norm, base).alias("base"), resolved(detections(norm, every)).alias("licenses")
        ),
    )
    nothing = F.struct(
        F.array().cast(DETECTION).alias("base"), F.array().cast(DETECTION).alias("licenses")
    )
    base_rows = without(docs, ["n_words", "base", "licenses"])
    scan = free_names(base_rows.columns, 1, "scan")[0]
    df = base_rows.select(
        "*",
        F.size(F.array_remove(F.split(whole, EITHER_CASE_BREAK), "")).cast("long").alias("n_words"),
        F.when(_gate(whole), scanned).otherwise(nothing).alias(scan),
    )
    return df.select("*", f"{scan}.base", f"{scan}.licenses").drop(scan)


def label_list(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def certainty(base: Column, found: Column) -> Column:
    """0 without any detection; else the certainty of the best one, a base phrase counting as 0.75."""
    best = F.array_max(F.transform(found, lambda d: d["priority"]))
    score = F.lit(0.0)
    for level in sorted(CERTAINTY):
        score = F.when(best >= level, F.lit(CERTAINTY[level])).otherwise(score)
    return F.greatest(score, F.when(F.size(base) > 0, F.lit(0.75)).otherwise(F.lit(0.0)))
