import random

import public_tokenizers
import sentencepiece
from fixtures import SF_DIR, clashing, frame, odd_rows

from hushlog.llm.queries import op1_token_counts
from hushlog.llm.token_counts import merger, with_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library_counts(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [len(ids) for ids in model.encode(texts, num_threads=1)]


def test_random_texts_as_library():
    pick = random.Random(7)
    parts = [*"aabcthe ing.,01▁é日😀À\n\t\x00 ", "  ", "     ", "tion", "aaaa", "</s>", "́"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 50))) for _ in range(4000)]
    texts += [" " * n for n in range(70)] + ["x" + " " * n + "y" for n in range(40)]
    texts += ["a" * n for n in range(40)] + ["thethe" * 5000, "0" * 64]
    assert merger(PATH).count(texts).tolist() == library_counts(texts)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("hushlog.llm.token_counts.REMEMBERED", 3)
    texts = ["one two three four", "five six one", "seven"]
    assert merger(PATH).count(texts).tolist() == library_counts(texts)


def test_query_counts_every_document(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas().set_index("doc_id")
    got = op1_token_counts(spark, SF_DIR).toPandas().set_index("doc_id").sort_index()
    assert got.columns.tolist()[:3] == ["n_bytes", "n_tokens", "over_limit"]
    texts = docs.text.sort_index().tolist()
    assert got.n_tokens.tolist() == library_counts(texts)
    assert got.n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert got.over_limit.tolist() == [n > 4096 for n in got.n_tokens]


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "N_TOKENS", "over_limit")
    got = with_token_counts(docs, PATH).collect()
    assert len(got) == len(rows)
    want = library_counts([r[1] or "" for r in rows])
    assert sorted(r.n_tokens for r in got) == sorted(want)
    assert {r.n_tokens for r in got if not r.text} == {0}
    assert with_token_counts(docs.limit(0), PATH).collect() == []
