import hashlib
import random
import zlib

import pytest
from fixtures import frame
from pyspark.sql import functions as F

from hushlog.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns of each conversation, in order."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = (role or "").encode(), (text or "").encode()
            token = hashlib.sha256(b"%016X" % len(role) + role + text).hexdigest()
            found.setdefault(c, []).append((turn is not None, turn or 0, token, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def exchanged(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        origin = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(origin, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, inside in members.items():
        below = [v for v in members if v[: len(node)] == node]
        kids = [v for v in below if len(v) == len(node) + 1]
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(node))
        rows.append(
            (
                min(inside),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(inside),
                len(kids),
                sum(not any(w[:-1] == v for w in below) for v in below),
                sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(rows, key=str)


def found(trie):
    assert trie.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    return sorted((tuple(r) for r in trie.collect()), key=str)


def turns_of(rng, c, most):
    return [(c, i, rng.choice("ua"), rng.choice(["x", "yy", "é"])) for i in range(rng.randrange(most))]


def plain(rows):
    n = pt.lengths(rows)
    return pt.prefix_trie(rows, n)


def test_deep_and_wide_tries(spark):
    """Depths beyond several cuts, shared prefixes of every length, copies."""
    rng = random.Random(4)
    base = [("u", rng.choice("ab") * 3) for _ in range(37)]
    rows = []
    for c in range(60):
        kept = base[: rng.randrange(38)]
        more = [("a", rng.choice("xy")) for _ in range(rng.randrange(4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(kept + more)]
    rows += [(100 + c, i, *t) for c in range(9) for i, t in enumerate(base)]
    got = found(plain(pt.numbered(frame(spark, rows, SCHEMA).repartition(3))))
    assert got == brute(ordered(rows))


def test_exchanged_heads_and_odd_rows(spark):
    rng = random.Random(8)
    rows = [t for c in [*range(-12, 31), 99, 1002] for t in turns_of(rng, c, 14)]
    rows += [(3, None, None, None), (3, None, None, None), (3, 1, "u", "x"), (None, 1, "u", "x"), (7, 2, "", None)]
    rows += [(200, 5, "u", "tie"), (200, 5, "a", "tie"), (200, 5, "u", "tie"), (201, 0, "u", "z" * 300_000)]
    docs = frame(spark, rows, SCHEMA).withColumn("end", F.lit("own")).withColumn("pos", F.lit(7))
    got = found(pt.prefix_trie(*pt.rebuilt(pt.numbered(docs))))
    assert got == brute(exchanged(ordered(rows)))


def test_turnless_and_empty(spark):
    one = pt.numbered(frame(spark, [(1, 0, "u", "x")], SCHEMA))
    convs = frame(spark, [(1, 0), (4, 0)], "conv long, n long")
    assert found(pt.prefix_trie(one.limit(0), convs)) == [
        (1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,4").hexdigest())
    ]
    assert found(plain(pt.numbered(frame(spark, [], SCHEMA)))) == []


def test_members_in_several_pieces(spark, monkeypatch):
    rows = spark.range(5000).select(F.lit(pt.ROOT).alias("end"), F.col("id").alias("conv"))
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    monkeypatch.setattr(pt, "IDS_A_PIECE", 700)
    assert [r.ends_sha256 for r in pt._digests(rows, "end", "conv").collect()] == [want]


def test_long_conversation_over_several_ranges(spark):
    turns = spark.range(20_000).selectExpr("7 AS conv_id", "id AS turn", "'u' AS role", "CAST(id AS STRING) AS text")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = pt.numbered(turns.unionByName(turns.limit(3).withColumn("conv_id", F.lit(8))))
        assert rows.where("conv = 7").select("bytes").distinct().count() == 5
        assert rows.where("conv = 7").agg(F.sum("pos")).first()[0] == 20_000 * 20_001 // 2
        wrong = rows.where("conv = 7").join(turns.select(F.col("turn") + 1, F.octet_length("text")).toDF("pos", "b"), "pos")
        assert wrong.where("b <> bytes").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


@pytest.mark.parametrize("n", [1, 4, 7])
def test_single_chain(spark, n):
    rows = [(5, i, "u", str(i)) for i in range(n)]
    assert found(plain(pt.numbered(frame(spark, rows, SCHEMA)))) == brute(ordered(rows))
