import re

import numpy as np
import public_tokenizers
import pytest
from fixtures import SF_DIR, frame, odd_rows
from test_byte_bpe import library_ids
from test_positional_index import brute as phrase_hits
from test_quality_rules import measured
from test_shingle_join import brute as groups_of

import corpus_pipeline
from hushlog.functions.checkpoints import stored
from hushlog.llm.feistel import pseudonymised

WORD = re.compile("[^\x20\x09-\x0D]+")


def good(text):
    """The rules of the cascade, one by one."""
    words = WORD.findall(text)
    n, chars, symbols, _, repeated = measured(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    unique = list(dict.fromkeys(lines))
    letters = lambda w: any(c.isalpha() for c in w)
    inner = lambda w: w[min((i for i, c in enumerate(w) if c.isalpha()), default=0) :]

    def loud(word):
        core = inner(inner(word)[::-1])
        return len(core) >= 2 and core.isalpha() and core.isupper()

    return not (
        n < 10
        or 100 * repeated > 20 * n
        or 100 * symbols > 20 * n
        or 100 * sum(map(loud, words)) > 50 * n
        or 100 * text.count("!") > 30 * n
        or sum(map(len, lines)) > 2 * sum(map(len, unique))
        or not 2 * n <= chars <= 30 * n
        or 100 * sum(not letters(w) for w in words) > 50 * n
        or (len(lines) > 3 and 100 * sum(bool(re.match(r"[ \t]*[-•*·][ \t]", x)) for x in lines) > 90 * len(lines))
        or (len(lines) > 3 and 100 * sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*\Z", x)) for x in lines) > 50 * len(lines))
    )


def expected(docs, items):
    rows = sorted((d for d in docs if good(d[1] or "")), key=lambda d: d[0])
    rows = [d for i, d in enumerate(rows) if groups_of_all(rows)[i][1] == i]
    hits = phrase_hits([d[1] for d in rows], items, 10)
    rows = [d for d, hit in zip(rows, hits) if not hit[1]]
    texts = [pseudonymised(d[1], corpus_pipeline.SAMPLE_KEY.encode())[0] for d in rows]
    return {d[0]: ids for d, ids in zip(rows, library_ids(texts))}


_CACHE = {}


def groups_of_all(rows):
    key = tuple(d[0] for d in rows)
    if key not in _CACHE:
        _CACHE[key] = groups_of([d[1] for d in rows], 5, 80)
    return _CACHE[key]


def test_run_as_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = expected(docs, items)
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert 0 < len(want) < len(docs)
    assert {r.doc_id: np.frombuffer(r.token_ids, "<u4").tolist() for r in got} == want
    assert all(r.n_tokens == len(want[r.doc_id]) for r in got)


def test_stages_keep_their_columns(spark):
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = source
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF_DIR))
        assert after.dtypes == source.dtypes and 0 < after.count() <= docs.count()
        docs = after


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables(spark, rows):
    longer = [(20 + i, f"a text of its own with more than ten words in it {i} {i * i}", "en", "a", 1) for i in range(3)]
    docs = frame(spark, odd_rows() + longer + longer[:1])
    docs = docs.limit(0) if rows == "none" else docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR))
    ids = [r.doc_id for r in docs.collect()]
    assert not ids if rows == "none" else {20, 21, 22} <= set(ids) and ids.count(20) == 1
