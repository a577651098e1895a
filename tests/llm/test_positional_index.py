import random

import pytest
from fixtures import clashing, frame, odd_rows

from hushlog.functions.checkpoints import stored
from hushlog.llm.positional_index import (
    build_index,
    decontaminated,
    hit_words,
    search,
    words_of,
)


def brute(texts, items, window, slop=None):
    """Per text: words hit, items with a phrase, items with a close window."""
    out = []
    for text in texts:
        words = words_of(text)
        hit, names, near = set(), set(), set()
        for name, test in items:
            tokens = words_of(test)
            for i in range(max(1, len(tokens) - window + 1) if tokens else 0):
                part = tokens[i : i + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        names |= {name} - {None}
                if slop is not None:
                    span = len(part) + slop
                    stretches = range(max(1, len(words) - span + 1)) if words else ()
                    if any(set(part) <= set(words[at : at + span]) for at in stretches):
                        near |= {name} - {None}
        out.append((len(words), len(hit), names, near))
    return out


def results(found, key="doc_id"):
    rows = found.withColumn("n_hit", hit_words(found.hits)).collect()
    return {r[key]: (r.n_words, r.n_hit, set(r["items"]), set(r.near)) for r in rows}


@pytest.fixture(scope="module")
def made():
    pick = random.Random(4)
    word = lambda: pick.choice(["a", "b", "c", "d", "E", "é", "word", "日本"])
    texts = [" ".join(word() for _ in range(pick.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "a-b.c", " ".join(["a"] * 300)]
    items = [(str(i), " ".join(word() for _ in range(pick.randint(0, 9)))) for i in range(12)]
    items += [("same", items[3][1]), (None, "a b c d e"), ("none", None), ("long", "a " * 6 + "b")]
    return texts, items


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_phrases_and_close_words_as_brute_force(spark, made, block_bytes):
    texts, items = made
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    tests = frame(spark, items, "item_id string, text string")
    index = stored(build_index(docs))
    found = search(index, tests, window=5, slop=2, block_bytes=block_bytes)
    assert results(found) == dict(enumerate(brute(texts, items, 5, 2)))


def test_several_segments(spark, made, monkeypatch):
    texts, items = made
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(7)
    tests = frame(spark, items, "item_id string, text string")
    found = search(build_index(docs), tests, window=3)
    assert results(found) == dict(enumerate(brute(texts, items, 3)))
    with pytest.raises(ValueError):
        search(build_index(docs), tests, window=600)


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "hits", "n_words", "_text")
    tests = frame(spark, [(7, "The CAT sat"), (7, "sat on the mat"), (None, None)], "item_id long, text string")
    found = search(build_index(docs), tests, window=4).collect()
    assert len(found) == len(rows)
    assert sorted(r.n_words for r in found) == sorted(len(words_of(r[1])) for r in rows)
    assert sorted(r.doc_id for r in found if r.hits) == [1, 1, 5]
    kept = decontaminated(docs, tests, window=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2, 3, 4, 6, 7]
    assert search(build_index(docs.limit(0)), tests).collect() == []
    none = search(build_index(docs), tests.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.hits for r in none)
    assert decontaminated(docs.limit(0), tests).collect() == []
