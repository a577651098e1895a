import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import SF_DIR, clashing, frame, odd_rows

from hushlog.llm.shingle_join import (
    components,
    one_of_each,
    segment_keys,
    shingle_sets,
    similar_sets,
    sketches,
)


def sets_of(texts, width):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        out.append(frozenset(grams if grams else [tuple(words)] if words else []))
    return out


def linked(a, b, per_cent):
    return bool(a and b) and 100 * len(a & b) >= per_cent * len(a | b)


def brute(texts, width, per_cent):
    """Size and least reachable place for each text, from all pairs."""
    sets = sets_of(texts, width)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if linked(sets[i], sets[j], per_cent):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, n, lengths):
    """Texts, many of which differ from another one in a few words; chains and stars of them."""
    pick = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and pick.random() < 0.7:
            words = pick.choice(texts).split()
            for _ in range(pick.randint(0, 1 + len(words) // 40)):
                at = pick.randrange(len(words) + 1)
                words[at : at + pick.randint(0, 1)] = [f"x{pick.randrange(1000)}"] * pick.randint(0, 1)
        else:
            words = [f"w{pick.randrange(300)}" for _ in range(pick.choice(lengths))]
        texts.append(" ".join(words) or "x")
    return texts


@pytest.mark.parametrize(("width", "per_cent"), [(3, 90), (5, 80), (1, 50)])
def test_as_all_pairs(spark, width, per_cent):
    texts = near_copies(width, 260, [1, 2, 3, 9, 10, 12, 20, 60, 150, 400])
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_sets(docs, width, per_cent).collect()}
    assert got == dict(enumerate(brute(texts, width, per_cent)))


@pytest.mark.parametrize("per_cent", [50, 80, 90])
def test_linked_sets_share_a_key(per_cent):
    texts = near_copies(3, 300, [5, 9, 11, 14, 30, 100, 300])
    gram, owner, n = shingle_sets(texts, 2)
    key, key_owner, needed = segment_keys(gram, owner, n, per_cent)
    keys = defaultdict(set)
    for k, o in zip(key.tolist(), key_owner.tolist()):
        keys[o].add(k)
    sets = sets_of(texts, 2)
    assert n.tolist() == [len(s) for s in sets]
    checked = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] != sets[j] and linked(sets[i], sets[j], per_cent):
                same = [sum(k % 2 == bit for k in keys[i] & keys[j]) for bit in (0, 1)]
                for one in (i, j):
                    assert any(s >= need for s, need in zip(same, needed[one])), (len(sets[i]), len(sets[j]))
                checked += 1
    assert checked > 50


def test_shingles_are_told_apart():
    gram, owner, n = shingle_sets(["a b", "b a", "a", "a b c", "a b c a b c", "", None, "A\tB\x0bC"], 3)
    assert n.tolist() == [1, 1, 1, 1, 3, 0, 0, 1]
    assert len(np.unique(gram)) == 6


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 2), (2, 1), (500, 501)]
    got = {r.node: r.root for r in components(frame(spark, edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {1: 1, 2: 1, 3: 1, 500: 500, 501: 500}
    assert got == want


def test_one_of_each(spark):
    texts = near_copies(11, 150, [3, 10, 40, 120])
    docs = frame(spark, [(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in one_of_each(docs, 3, 80).collect()}
    groups = defaultdict(list)
    for i, (_, root) in enumerate(brute(texts, 3, 80)):
        groups[root].append(1000 - i)
    assert kept == {min(ids) for ids in groups.values()}


def test_odd_rows(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows), "component_id", "_n", "node", "fragment")
    got = similar_sets(docs, 3, 90).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].component_id == by_id[5].component_id == 1
    assert (by_id[2].n_shingles, by_id[2].component_id) == (0, 2)
    assert by_id[3].component_id == 3 and by_id[7].component_id == 7
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    kept = one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7]
    assert similar_sets(docs.limit(0)).collect() == []
    assert one_of_each(docs.limit(0)).collect() == []


def test_sketches_never_tell_more_differences_than_there_are():
    texts = near_copies(5, 120, [1, 5, 30, 200, 900]) + ["", None]
    gram, owner, n = shingle_sets(texts, 2)
    found, sets = sketches(gram, n), sets_of(texts, 2)
    bits = [sum(int(w) % (1 << 64) << 64 * k for k, w in enumerate(row)) for row in found.tolist()]
    apart = [(len(sets[i] ^ sets[j]), (bits[i] ^ bits[j]).bit_count()) for i in range(len(texts)) for j in range(i)]
    assert all(seen <= true for true, seen in apart)
    assert np.mean([seen > 60 for true, seen in apart if true > 120]) > 0.9


def test_group_of_copies_that_hardly_link(spark):
    """Copies with more changes than a link allows, some of which share their changes."""
    pick = random.Random(21)
    base = [f"w{pick.randrange(10_000)}" for _ in range(120)]
    texts = []
    for _ in range(220):
        words = (pick.choice(texts).split() if texts and pick.random() < 0.5 else base).copy()
        for _ in range(pick.randint(0, 5)):
            words[pick.randrange(len(words))] = f"x{pick.randrange(40)}"
        texts.append(" ".join(words))
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_sets(docs, 3, 90).collect()}
    assert got == dict(enumerate(brute(texts, 3, 90)))
    assert 5 < len({root for _, root in got.values()}) < 200


def test_own_columns_stay(spark):
    docs = clashing(frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, "x")], "doc_id long, text string"), "_row", "_row0", "_id")
    kept = one_of_each(docs, 3, 90).orderBy("doc_id").collect()
    assert [(r.doc_id, r["_row"], r["_row0"], r["_id"]) for r in kept] == [(1, "own", "own", "own"), (3, "own", "own", "own")]
