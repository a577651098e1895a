import re

import pytest
from fixtures import SF_DIR, clashing, frame, odd_rows
from pyspark.sql import functions as F

from hushlog.llm.license_rules import BASE, CERTAINTY, Signature, signatures
from hushlog.llm.license_scan import _gate, label_list, with_licenses
from hushlog.llm.queries import op4_license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def base_places(words):
    for label, phrase in BASE:
        part = phrase.split()
        for i in range(len(words) - len(part) + 1):
            if words[i : i + len(part)] == part:
                yield label, i


def found(words):
    """Detections by trying every rule on every text, then suppression pair by pair."""
    norm = f" {' '.join(words)} "
    every = set()
    for rule in signatures():
        for match in re.finditer(rf"(?<= )({rule.pattern})(?= )", norm):
            start = norm[: match.start()].count(" ") - 1
            every.add((start, start + match.group().count(" ") + 1, rule.priority, rule.label))
    kept = []
    for d in every:
        for e in every:
            inside = e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
            if inside and e != d and (e[:2] != d[:2] or e[2] > d[2] or e[3] < d[3]):
                break
        else:
            kept.append(d)
    return kept


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. Or CC BY. Or cc-by-sa 3.0",
    "Licensed under the Apache License, Version 2.0. Apache License here; apache 2.0 there",
    "SPDX-License-Identifier: MIT license. The MIT License (MIT)",
    "spdx license identifier GPL v2 or later; GPL-3.0 and GPLv2+, LGPL 2.1, AGPLv3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. Copyright (c) 2019 2020",
    "redistribution and use in source and binary forms, with or without modification, are permitted",
    "http://www.apache.org/licenses/LICENSE-2.0 http://www.gnu.org/licenses/gpl-3.0.html",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ attribution",
    "mit der license und mit. CC\nBy  cc! by? gnu general publicity license",
    "MIT LICENSE " * 300,
    "GNU\n\nGENERAL_PUBLIC   LICENSE é License gnu general public license",
    "no words of that kind in here, but a mit and a cc",
    "Mulan PSL v2 and beerware license; MIT no attribution, 3-clause BSD, all rights reserved",
]


def test_hundreds_of_rules():
    rules = signatures()
    assert len(rules) > 400 and {r.priority for r in rules} == set(CERTAINTY)
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_detections_as_brute_force(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    labelled = with_licenses(docs).withColumn("names", label_list(F.col("licenses")))
    for row in labelled.collect():
        words = words_of(texts[row.doc_id])
        assert row.n_words == len(words)
        assert sorted((d.label, d.start) for d in row.base) == sorted(base_places(words))
        want = found(words)
        got = [(d.start, d.end, d.priority, d.label) for d in row.licenses]
        assert sorted(got) == sorted(want), texts[row.doc_id][:80]
        assert row.names == ",".join(sorted({d[3] for d in want}))


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op4_license_scan(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(texts) and any(r.n_base for r in rows)
    for r in rows:
        places = list(base_places(words_of(texts[r.doc_id])))
        assert r.n_base == len(places)
        assert r.first_word == min((i for _, i in places), default=None)
        assert r.last_word == max((i for _, i in places), default=None)
        assert r.base_labels == ",".join(sorted({label for label, _ in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_gate_is_open_for_every_example(spark):
    names = [re.sub(r"\[sc\]", "s", r.keyword) for r in signatures() if r.keyword.startswith("cc by")]
    docs = frame(spark, [(i, f"see {n} here") for i, n in enumerate(names)], "doc_id long, text string")
    assert docs.where(~_gate(F.col("text"))).count() == 0


@pytest.mark.parametrize("rule", [Signature("x", 3, "same", "same words"), Signature("y", 2, "words", "words")])
def test_own_rules(spark, rule):
    docs = frame(spark, [(1, "the same words, the license")], "doc_id long, text string")
    (row,) = with_licenses(docs, [rule]).collect()
    assert [d.label for d in row.licenses] == [rule.label]


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "licenses", "Base", "n_words")
    got = with_licenses(docs)
    assert len(got.columns) == len(set(c.lower() for c in got.columns))
    assert sorted(r.n_words for r in got.collect()) == sorted(len(words_of(r[1])) for r in rows)
    assert with_licenses(docs.limit(0)).collect() == []
