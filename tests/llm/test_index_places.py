import pytest
from fixtures import clashing, frame

from hushlog.functions.checkpoints import stored
from hushlog.llm.positional_index import build_index, decontaminated, search

ROWS = [(1, "a b c d e"), (1, "x y z w v"), (1, "a b c x y"), (None, "q a b c q"), (None, "x y z q q"), (2, ""), (2, None)]
ITEMS = [("p", "a b c"), ("q", "x y z"), ("r", "b c d")]


def rows(found):
    return sorted((tuple(sorted(map(tuple, r.hits))), tuple(sorted(r.items)), tuple(r.near), r.doc_id or 0, r.n_words) for r in found.collect())


@pytest.mark.parametrize("slop", [None, 1])
def test_blocks_do_not_mix_documents_with_equal_ids_and_lengths(spark, slop):
    index = stored(build_index(frame(spark, ROWS, "doc_id long, text string").repartition(2)))
    tests = frame(spark, ITEMS, "item_id string, text string")
    one, many = (rows(search(index, tests, window=3, slop=slop, block_bytes=b)) for b in (1 << 20, 1))
    spans = lambda found: [(sum(b - a for a, b in r[0]) > 0, *r[1:2], sorted(r[2]), *r[3:]) for r in found]
    assert sorted(map(str, spans(one))) == sorted(map(str, spans(many)))
    assert sorted(r[1] for r in many) == [(), (), ("p",), ("p",), ("p", "r"), ("q",), ("q",)]


def test_own_columns_stay(spark):
    docs = clashing(frame(spark, ROWS, "doc_id long, text string"), "_text_key", "_text0", "segment", "terms")
    kept = decontaminated(docs, frame(spark, ITEMS, "item_id string, text string"), window=3).collect()
    assert sorted(str(r.text) for r in kept) == ["", "None"]
    assert all((r["_text_key"], r["_text0"], r.segment, r.terms) == ("own",) * 4 for r in kept)
