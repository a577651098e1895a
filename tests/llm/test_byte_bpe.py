import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from fixtures import SF_DIR, clashing, frame, odd_rows
from tokenizers import Tokenizer

from hushlog.llm.byte_bpe import byte_bpe
from hushlog.llm.chunk_bpe import ChunkEncoder, chunk_ends, with_decoded, with_token_ids
from hushlog.llm.queries import op6_token_files, op9_chunk_bpe
from hushlog.llm.token_files import pack, token_file_ids, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def runs(ids, sizes):
    return [run.tolist() for run in np.split(ids, np.cumsum(sizes)[:-1])]


def random_texts(n, most, seed):
    pick = random.Random(seed)
    parts = [*"ab.,0é日😀'ñ\n\t\x1c\x85", " the", " in", " word", " and", "  ", " ", "   ", " \n"]
    parts += ["<|endoftext|>", "<|", "'s", "'ll", " \n\n "]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, most))) for _ in range(n)]


def test_texts_as_library():
    texts = random_texts(4000, 30, 3) + [" " * 300_000, "x" * 200_000, "ab " * 50_000]
    assert runs(*byte_bpe(PATH).encode(texts)) == library_ids(texts)
    assert byte_bpe(PATH).encode([])[1].tolist() == []


def test_pieces_as_library():
    texts = random_texts(3000, 6, 9) + [" " + t for t in random_texts(3000, 4, 10)] + [" a", ""]
    assert runs(*byte_bpe(PATH).encode_pieces(texts)) == library_ids(texts)
    assert byte_bpe(PATH).encode_pieces([])[1].tolist() == []


def test_chunks_as_library(monkeypatch):
    pick = random.Random(5)
    passages = random_texts(40, 400, 8)
    texts = ["".join(pick.sample(passages, 3)) for _ in range(150)] + ["", "a", "x" * 5000, " " * 999]
    encoder = ChunkEncoder(byte_bpe(PATH))
    want = library_ids(texts)
    assert runs(*encoder.encode(texts)) == want
    assert encoder.encoded < encoder.met
    before = encoder.encoded
    assert runs(*encoder.encode(texts)) == want
    assert encoder.encoded == before
    monkeypatch.setattr("hushlog.llm.chunk_bpe.REMEMBERED_CHUNKS", 1)
    assert runs(*encoder.encode(texts[:20])) == want[:20]
    decoded = byte_bpe(PATH).decode(*encoder.encode(texts))
    assert decoded == [LIBRARY.decode(ids, skip_special_tokens=False) for ids in want]


def test_chunks_end_at_the_same_places_in_other_texts():
    shared = " ".join(f"word{i * i}" for i in range(500))
    ends = [
        {end - len(before.encode()) for end in chunk_ends((before + shared).encode()).tolist()}
        for before in ("", "something else before it, ", "é" * 77)
    ]
    common = {e for e in ends[0] if e > 100}
    assert len(common) > 5 and common <= ends[1] and common <= ends[2]


def test_bytes_round_trip():
    pick = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 3, 4, 5, 0, 1000])
    ranks = pick.integers(0, 1 << pick.integers(1, 32, sizes.sum()))
    control, n_control, data, n_data = pack(ranks, sizes)
    assert n_control.tolist() == [-(-n // 4) for n in sizes] and len(data) == n_data.sum()
    assert unpack(control, data, sizes).tolist() == ranks.tolist()


def test_files_hold_every_document(spark):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    texts = texts.set_index("doc_id").text.sort_index()
    got = op6_token_files(spark, SF_DIR).toPandas().set_index("doc_id").sort_index()
    start = 0
    for doc_id, ids in zip(texts.index, library_ids(texts.tolist())):
        row, data = got.loc[doc_id], np.array([*ids, 2], dtype="<u4").tobytes()
        assert (row.start, row.n_tokens) == (start, len(ids) + 1)
        assert row.ids_crc32 == zlib.crc32(data)
        start += len(ids) + 1
    assert len(got) == len(texts)


def test_chunk_query(spark):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    texts = texts.set_index("doc_id").text.sort_index()
    got = op9_chunk_bpe(spark, SF_DIR).toPandas().set_index("doc_id")
    for doc_id, text, ids in zip(texts.index, texts, library_ids(texts.tolist())):
        row = got.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == len(texts)


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "token_ids", "Decoded", "IDS")
    got = with_decoded(with_token_ids(docs, PATH), PATH).collect()
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in rows)
    assert with_decoded(with_token_ids(docs.limit(0), PATH), PATH).collect() == []
    read = token_file_ids(docs, PATH, str(tmp_path / "some"), end=2).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert sum(r.n_tokens for r in read) == sum(len(i) + 1 for i in library_ids([r[1] or "" for r in rows]))
    assert token_file_ids(docs.limit(0), PATH, str(tmp_path / "none")).collect() == []
