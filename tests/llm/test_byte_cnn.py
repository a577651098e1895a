import zlib

import numpy as np
import pytest
from fixtures import clashing, frame, odd_rows

from hushlog.llm.byte_cnn import (
    EMBEDDED,
    FILTERS,
    WIDEST,
    WINDOW,
    fit,
    predict,
    train,
    windows_of,
    with_language,
)
from hushlog.llm.queries import op3_byte_cnn

TEXTS = {
    "aa": ["banana bandana anagram", "a llama at a gala", "dada baba nana", "java lava mama"],
    "ii": ["kiwi mini bikini", "illicit limit in Tivoli", "civic wigi mili", "piri wiki sini"],
}


@pytest.fixture(scope="module")
def net():
    rows = [(w, k) for k, name in enumerate(sorted(TEXTS)) for t in TEXTS[name] for w in windows_of(t.encode())]
    return train(np.stack([w for w, _ in rows]), np.array([k for _, k in rows]), sorted(TEXTS))


def test_windows():
    assert windows_of(b"").shape == (1, WINDOW + WIDEST - 1)
    data = bytes(range(1, 256)) * 3
    cut = windows_of(data)
    assert b"".join(w[:WINDOW].tobytes() for w in cut).rstrip(b"\0") == data
    assert cut[0][WINDOW:].tobytes() == data[WINDOW : WINDOW + WIDEST - 1]


def test_filters_as_loops(net):
    (window,) = windows_of("an example in few words".encode())
    best = np.full(sum(FILTERS.values()), -np.inf)
    widths = [w for w, k in FILTERS.items() for _ in range(k)]
    for f, width in enumerate(widths):
        filt = net.filters[:, f].reshape(WIDEST, EMBEDDED)
        assert not filt[width:].any()
        for i in range(WINDOW):
            best[f] = max(best[f], (net.embedding[window[i : i + width]] * filt[:width]).sum())
    scores = np.maximum(best + net.bias, 0) @ net.dense + net.offset
    want = np.exp(scores) / np.exp(scores).sum()
    assert np.allclose(net.probabilities(window[None])[0], want, atol=1e-4)


def test_predictions(net):
    names, scores = predict(net, ["banana lava", "mini kiwi", None, "", "12 34 !", "ñ"])
    assert names[:5] == ["aa", "ii", "und", "und", "und"] and names[5] in TEXTS
    assert scores[2:5].tolist() == [0, 0, 0] and all(0 <= s <= 1 for s in scores)


def test_whole_text_counts(net):
    names, _ = predict(net, ["banana lava " * 10 + "mini kiwi " * 500])
    assert names == ["ii"]


def test_query_on_texts_it_has_not_seen(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op3_byte_cnn(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in unseen)
    assert right >= 0.95 * len(unseen), (right, len(unseen))


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "Score", "lang_pred")
    net = fit(docs)
    assert net.labels == ["de", "en", "fr"]
    got = with_language(docs, net).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred == "und" for r in got if not r.text or not r.text.strip())
    nothing = fit(docs.limit(0))
    assert nothing.labels == []
    assert {r.lang_pred for r in with_language(docs, nothing).collect()} == {"und"}
    assert with_language(docs.limit(0), net).collect() == []
    one = fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in with_language(docs, one).where("doc_id = 1").collect()} == {"fr"}
