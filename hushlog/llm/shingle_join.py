"""Jaccard join on word shingles with a vertically partitioned order of n-grams.

All n-grams stand in one global order, that of a 64-bit hash. The order is cut into fragments, and a
document's set falls into segments, one for each fragment. Fragments serve twice:

* Two sets that link differ in at most H n-grams. Cut into more than H fragments, they have segments
  in common, and a set knows how many it must share with any partner. So equal segments are the
  candidates, and sets that share too few of theirs drop out.
* For candidates the overlap is counted fragment by fragment, apart from each other, and the partial
  counts are summed per pair.

Only links that join components matter. Equal sets are one node. In each segment's group the node
with the most company, the hub, is compared with all others. What that leaves apart differs from the
hub in more n-grams than a link allows. Two such sets differ from each other where just one of them
differs from the hub, so linked ones have more than half of their differences from the hub in common,
and one of the first few. Random changes of one text have hardly any in common, so a group of many
copies that don't link makes few candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from hushlog.functions.checkpoints import forget, stored
from hushlog.llm.arrow import free_names, pieces, without

#: Fragments above the least number: so many empty ones a set may have without further ado.
SLACK = 2
#: Sizes in one class differ by at most this factor (and never by less than one).
CLASS_RATIO = 1.5
#: Words of 64 bits by which pairs are told apart before their overlap is counted.
SKETCH = 8
#: Fragments of the counting step.
COUNTED = 8
#: How often sets that share too few keys are taken out, before and after the hubs' links.
FILTERED = 2
#: Up to so many candidate texts (16 bytes each) are found by a broadcast, more by a shuffle.
BROADCAST_ROWS = 1 << 20

M1, M2, M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


@cache
def class_starts() -> np.ndarray:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_RATIO)))
    return np.array(starts)


def most_apart(total: np.ndarray, per_cent: int) -> np.ndarray:
    """Largest symmetric difference of two linked sets with so many n-grams together."""
    return total * (100 - per_cent) // (100 + per_cent)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles, the text of each, and the number per text."""
    words = [(t or "").encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = [w for one in words for w in one]
    ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids))
    word = hashes[np.fromiter(map(ids.__getitem__, flat), dtype=np.int64, count=len(flat))]
    begin = np.cumsum(sizes) - sizes
    long = np.repeat(sizes >= width, sizes)
    left = np.repeat(begin + sizes, sizes) - np.arange(len(flat))
    at = np.flatnonzero(long & (left >= width))
    gram = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        gram = mixed(gram + word[at + k], M1)
    text = np.repeat(np.arange(len(words)), sizes)[at]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):  # the whole sequence as one, marked by its length
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            more = sizes[short] > k
            whole[more] = mixed(whole[more] + word[begin[short[more]] + k], M1)
        gram = np.append(gram, mixed(whole + sizes[short].astype(np.uint64), M2))
        text = np.append(text, short)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))[: len(gram)]
    gram, text = gram[new], text[new]
    return gram, text, np.bincount(text, minlength=len(texts)).astype(np.int64)


def signatures(gram: np.ndarray, text: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16 bytes for each set that equal sets share."""
    out = np.zeros((len(n), 2), dtype=np.uint64)
    for k, by in enumerate((M1, M2)):
        np.add.at(out[:, k], text, mixed(gram, by))
    out[:, 0] += n.astype(np.uint64)
    return [row.tobytes() for row in out]


def sketches(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``SKETCH`` words for each set: the parity of the n-grams that fall on each bit.

    Where two sketches differ the sets differ, too, so they have as many differences at least.
    """
    out = np.zeros((len(n), SKETCH), dtype=np.int64)
    filled = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[filled]
    bit = np.uint64(1) << (gram & np.uint64(63))
    word = (gram >> np.uint64(6)) % np.uint64(SKETCH)
    for k in range(SKETCH if len(filled) else 0):
        held = np.where(word == k, bit, np.uint64(0))
        out[filled, k] = np.bitwise_xor.reduceat(held, starts).view(np.int64)
    return out


def segment_keys(
    gram: np.ndarray, text: np.ndarray, n: np.ndarray, per_cent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that linked sets share, the text of each, and how many each text must share at least.

    A scheme belongs to a class of sizes. Each set takes that of its own class, and the next one's
    where a partner may be that large; of the two, the last bit of a key tells which (odd or even).
    A set shares all its fragments with a linked one but for as many as they have differences. A set with too many empty
    fragments in a scheme adds the least n-grams of its order, as many as two such sets need to meet,
    and must share one key.
    """
    starts = class_starts()
    own = np.searchsorted(starts, n, "right") - 1
    most = n * 100 // per_cent
    found_key, found_text = [], []
    needed = np.ones((len(n), 2), dtype=np.int32)
    for step in (0, 1):
        scheme = own + step
        upper = starts[scheme + 1] - 1
        apart = most_apart(n + np.minimum(most, upper), per_cent)
        takes = (n > 0) & (apart > 0) & (most >= starts[scheme])
        cuts = (most_apart(2 * upper, per_cent) + 1 + SLACK).astype(np.uint64)
        chosen = takes[text]
        g, t = gram[chosen], text[chosen]
        if not len(g):
            continue
        fragment = ((g >> np.uint64(32)) * cuts[t]) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (fragment[1:] != fragment[:-1])))
        key = np.add.reduceat(mixed(g, M2), first)
        tag = (scheme[t[first]].astype(np.uint64) << np.uint64(40)) + fragment[first]
        keys, texts = [mixed(key ^ mixed(tag, M1), M3)], [t[first]]
        full = np.bincount(t[first], minlength=len(n))
        odd = takes & (full <= apart)
        needed[np.arange(len(n)), scheme & 1] = np.where(odd, 1, np.maximum(full - apart, 1))
        if odd.any():
            prefix = n - -(-n * per_cent // 100) + 1
            begin = np.cumsum(n) - n
            near = odd[text] & (np.arange(len(gram)) - begin[text] < prefix[text])
            tag = scheme[text[near]].astype(np.uint64) << np.uint64(40)
            keys.append(mixed(gram[near] ^ mixed(tag, M2), M1))
            texts.append(text[near])
        for key, of in zip(keys, texts):
            found_key.append(key & ~np.uint64(1) | (scheme[of] & 1).astype(np.uint64))
            found_text.append(of)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty.astype(np.uint64), *found_key]), np.concatenate([empty, *found_text]), needed


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def _with_sets(docs: DataFrame, keep: list[str], width: int, per_cent: int, text: str) -> DataFrame:
    """``keep``, a hash of the text, signature, size, segment keys, how many of them must be shared, and
    sketch."""
    rows = docs.select(*keep, F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    schema = StructType(
        [
            *rows.schema.fields[:-1],
            StructField("_sig", BinaryType()),
            StructField("_n", LongType()),
            StructField("_keys", ArrayType(LongType())),
            StructField("_need0", IntegerType()),
            StructField("_need1", IntegerType()),
            StructField("_sketch", ArrayType(LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                gram, owner, n = shingle_sets(batch.column(len(keep) + 1).to_pylist(), width)
                key, key_owner, needed = segment_keys(gram, owner, n, per_cent)
                columns = [
                    *batch.columns[:-1],
                    pa.array(signatures(gram, owner, n), pa.binary()),
                    pa.array(n),
                    _lists(key, key_owner, len(n)),
                    pa.array(needed[:, 0]),
                    pa.array(needed[:, 1]),
                    pa.FixedSizeListArray.from_arrays(sketches(gram, n).reshape(-1), SKETCH).cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _parts(rows: DataFrame, width: int) -> DataFrame:
    """Signature, fragment and its part of the set, for texts of ``rows``."""
    schema = "_sig binary, fragment int, part array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                gram, owner, n = shingle_sets(batch.column(0).to_pylist(), width)
                sig = signatures(gram, owner, n)
                place = owner * COUNTED + (gram >> np.uint64(61)).astype(np.int64)
                rows_ = np.unique(place)
                columns = [
                    pa.array([sig[i] for i in (rows_ // COUNTED).tolist()], pa.binary()),
                    pa.array((rows_ % COUNTED).astype(np.int32)),
                    _lists(gram, np.searchsorted(rows_, place), len(rows_)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_sig", "fragment", "part"])

    return rows.select("text").mapInArrow(run, schema)


def _grams(rows: DataFrame, width: int) -> DataFrame:
    """Signature and n-grams in their order, for texts of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                gram, owner, n = shingle_sets(batch.column(0).to_pylist(), width)
                columns = [pa.array(signatures(gram, owner, n), pa.binary()), _lists(gram, owner, len(n))]
                yield pa.RecordBatch.from_arrays(columns, names=["_sig", "grams"])

    return rows.select("text").mapInArrow(run, "_sig binary, grams array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is linked with) of every node in ``a`` and ``b``.

    Every node hooks on its least neighbour, the trees are flattened by pointer jumping, and the
    edges between the trees that are left go into the next round.
    """
    edges = stored(edges.select("a", "b"), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("root")
        ), "roots")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stored(
                parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")),
                "roots",
            )
            moved = jumped.where("moved").limit(1).count()
            forget(parent)
            parent = jumped.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            top = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            joined = labels.join(top, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            old, labels = labels, stored(joined, "roots")
            forget(old)
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(a, "a").join(b, "b").where("ra <> rb")
        rest = stored(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        forget(edges)
        edges = rest
        if not edges.limit(1).count():
            forget(edges)
            return labels


class _Linker:
    """Looks into the texts of some nodes."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, per_cent: int, text: str):
        self.docs, self.nodes, self.width, self.per_cent, self.text = docs, nodes, width, per_cent, text

    def _wanted(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Some ``nodes`` with their signatures, and texts that have these (perhaps repeatedly)."""
        wanted = stored(self.nodes.select("node", "_sig", "_text").join(nodes, "node"), "wanted")
        keys = wanted.select("_text").distinct()
        if wanted.count() <= BROADCAST_ROWS:  # counted just now
            keys = F.broadcast(keys)
        texts = self.docs.select(F.xxhash64(self.text).alias("_text"), F.col(self.text).alias("text"))
        return wanted, texts.join(keys, "_text", "left_semi")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b, na, nb) those that link, from the overlaps in each fragment."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted, texts = self._wanted(nodes)
        parts = _parts(texts, self.width).groupBy("_sig", "fragment").agg(F.first("part").alias("part"))
        parts = stored(parts.join(wanted.select("node", "_sig"), "_sig").select("node", "fragment", "part"), "parts")
        left = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("pa"))
        right = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("pb"))
        partial = (
            pairs.join(left, "a")
            .join(right, ["b", "fragment"])
            .select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("same"))
        )
        same = partial.groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"))
        union = F.col("na") + F.col("nb") - F.col("same")
        linked = stored(same.where(100 * F.col("same") >= self.per_cent * union).select("a", "b"), "links")
        forget(parts)
        forget(wanted)
        return linked

    def near(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, na, nb) less those that differ too much by their sketches."""
        one = self.nodes.select(F.col("node").alias("a"), F.col("_sketch").alias("sa"))
        other = self.nodes.select(F.col("node").alias("b"), F.col("_sketch").alias("sb"))
        apart = sum(F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH))
        most = (100 - self.per_cent) * (F.col("na") + F.col("nb"))
        near = pairs.join(one, "a").join(other, "b").where((100 + self.per_cent) * apart <= most)
        return near.select("a", "b", "na", "nb")

    def grams(self, nodes: DataFrame) -> DataFrame:
        """``node`` and ``grams`` of some ``nodes``."""
        wanted, texts = self._wanted(nodes)
        found = _grams(texts, self.width).groupBy("_sig").agg(F.first("grams").alias("grams"))
        held = stored(found.join(wanted.select("node", "_sig"), "_sig").select("node", "grams"), "grams")
        forget(wanted)
        return held


def _enough(shared: DataFrame, needs: DataFrame) -> DataFrame:
    """Rows of nodes that share as many keys of a scheme as they must, in keys with company."""
    # of a node's two schemes, one has odd keys
    step = F.col("key").bitwiseAND(F.lit(1))
    counts = shared.groupBy("node").agg(F.count_if(step == 0).alias("c0"), F.count_if(step == 1).alias("c1"))
    good = [F.when(F.col(f"c{i}") >= F.col(f"_need{i}"), i) for i in (0, 1)]
    left = counts.join(needs, "node").select("node", F.explode(F.array_compact(F.array(*good))).alias("step"))
    rows = shared.withColumn("step", step.cast("int")).join(left, ["node", "step"], "left_semi").drop("step")
    company = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return rows.join(company, "key", "left_semi")


def _near_each_other(open_: DataFrame, grams: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (x, y) of different roots that may link; ``open_``: hub, ``node``, ``_n`` and ``root``.

    ``apart`` holds a node's differences from the hub in one order, what the hub lacks first. Of two
    linked nodes with p and q differences and H between them at most, (p + q - H) / 2 are the same
    ones. So a common one stands among the first p and q less that, and that of the node with fewer
    differences among the first H / 2 + 1.
    """
    rows = open_.join(grams.withColumnRenamed("grams", "gx"), "node")
    hubs = grams.select(F.col("node").alias("hub"), F.col("grams").alias("gc"))
    limit = lambda total: F.floor((100 - per_cent) * total / (100 + per_cent))
    largest = F.floor(F.col("_n") * 100 / per_cent)
    rows = rows.join(hubs, "hub").withColumns(
        {
            "apart": F.concat(F.array_except("gx", "gc"), F.array_except("gc", "gx")),
            "most": limit(F.col("_n") + largest).cast("int"),
        }
    )
    first = F.slice("apart", F.lit(1), F.col("most") + 1)
    rows = rows.select("hub", "node", "_n", "root", "most", F.size("apart").alias("d"), F.posexplode(first).alias("place", "gram"))
    held = rows = stored(rows, "apart")
    common = rows.groupBy("hub", "gram").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    rows = rows.join(common.where("low <> high").select("hub", "gram"), ["hub", "gram"], "left_semi")
    side = lambda mark: [F.col(c).alias(c.strip("_") + mark) for c in ("node", "_n", "root", "d", "place")]
    few = rows.where(2 * F.col("place") <= F.col("most")).select("hub", "gram", *side("x"))
    many = rows.select("hub", "gram", *side("y"))
    between = limit(F.col("nx") + F.col("ny"))
    same = F.ceil((F.col("dx") + F.col("dy") - between) / 2)
    fits = (
        (F.col("rootx") != F.col("rooty"))
        & ((F.col("dx") < F.col("dy")) | (F.col("dx") == F.col("dy")) & (F.col("nodex") < F.col("nodey")))
        & (100 * F.least("nx", "ny") >= per_cent * F.greatest("nx", "ny"))
        & (F.col("placex") <= F.col("dx") - same)
        & (F.col("placey") <= F.col("dy") - same)
    )
    swap = F.col("nodex") > F.col("nodey")
    pairs = few.join(many, ["hub", "gram"]).where(fits)
    found = pairs.select(
        F.least("nodex", "nodey").alias("a"),
        F.greatest("nodex", "nodey").alias("b"),
        F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("na"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nb"),
    )
    found = stored(found.distinct(), "found")
    forget(held)
    return found


def _open_groups(placed: DataFrame) -> DataFrame:
    """Rows of groups (``key``) with several ``root``s."""
    roots = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(roots.where("low <> high").select("key"), "key", "left_semi")


def similar_sets(
    docs: DataFrame, width: int = 5, per_cent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    A text's set holds its distinct shingles of ``width`` words (A-Z lower-cased, words cut at
    ASCII white space); with fewer words the whole sequence is one. Two sets link when their
    intersection has at least ``per_cent`` per cent of their union. ``component_id`` is the least
    ``key`` that links reach. A text without words is linked with nothing and has its own ``key``;
    a null ``key`` never names a component: where a whole component has none, its id is null.
    Repeated rows come out repeatedly. Runs jobs; an empty table gives an empty one.
    """
    every = _with_sets(docs, [key], width, per_cent, text).withColumn("_id", F.monotonically_increasing_id())
    sets = stored(every, "sets")
    nodes = stored(
        sets.where("_n > 0").groupBy("_sig", "_n").agg(
            F.min(key).alias("_first"), F.min_by(F.struct("_text", "_need0", "_need1", "_sketch"), "_id").alias("_one"), F.min("_id").alias("node")
        ).select("node", "_sig", "_n", "_first", "_one.*"),
        "nodes",
    )
    linker = _Linker(docs, nodes, width, per_cent, text)
    needs = nodes.select("node", "_need0", "_need1")
    rows = sets.where("_n > 0").select(F.col("_id").alias("node"), "_keys")
    copies = stored(rows.select("node").join(nodes.select("node"), "node", "left_anti"), "copies")
    others = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies  # counted just now
    rows = rows.join(others, "node", "left_anti").select("node", F.explode("_keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stored(rows.join(counts.select("key"), "key", "left_semi"), "shared")
    # the keys are the larger part of the table
    before, sets = sets, stored(sets.select(key, "_sig", "_n"), "sizes")
    for table in (before, copies):
        forget(table)
    for _ in range(FILTERED):
        before, shared = shared, stored(_enough(shared, needs), "shared")
        forget(before)
    crowd = shared.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key")
    company = crowd.groupBy("node").agg(F.sum("c").alias("score"))
    scored = stored(shared.join(company, "node").join(nodes.select("node", "_n"), "node"), "scored")
    forget(shared)
    best = scored.groupBy("key").agg(F.max(F.struct("score", "node", "_n")).alias("best"))
    best = stored(best.select("key", F.col("best.node").alias("hub"), F.col("best._n").alias("na")), "hubs")
    size = 100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb")
    star = scored.join(best, "key").select(F.col("hub").alias("a"), F.col("node").alias("b"), "na", F.col("_n").alias("nb"))
    star = stored(linker.near(star.where((F.col("a") != F.col("b")) & size).distinct()), "star")
    links = linker.links(star)
    roots = components(links)
    # groups in which several components are left
    placed = scored.join(roots, "node", "left").select("key", "node", "_n", F.coalesce("root", "node").alias("root"))
    placed = stored(_open_groups(placed), "placed")
    forget(scored)
    for _ in range(FILTERED):
        before, placed = placed, stored(_open_groups(_enough(placed, needs)), "placed")
        forget(before)
    open_ = placed.join(best.select("key", "hub"), "key").where("hub <> node").select("hub", "node", "_n", "root").distinct()
    open_ = stored(open_, "open")
    grams = linker.grams(open_.select("node").union(open_.select("hub")).distinct())
    near = _near_each_other(open_, grams, per_cent)
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(linker.near(near.join(tested, ["a", "b"], "left_anti")), "rest")
    for table in (star, best, placed, open_, grams, near):
        forget(table)
    more = linker.links(rest)
    forget(rest)
    if more.limit(1).count():
        forget(roots)
        roots = components(links.union(more))
    ids = nodes.select("node", "_sig", "_first").join(roots, "node", "left")
    ids = ids.withColumn("root", F.coalesce("root", "node"))
    names = ids.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = ids.join(names, "root").select("_sig", "component_id")
    found = sets.select(key, "_sig", "_n").join(named, "_sig", "left")
    return found.select(
        key,
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") == 0, F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = 5, per_cent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least ``key``.

    Texts without words all stay. Where a component has no ``key`` at all, or its least one stands
    on several rows, one of these rows stays, that with the least text hash.
    """
    (number,) = free_names(docs.columns, 1, "row")
    held = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = similar_sets(held, width, per_cent, number, text)
    members = held.select(number, key).join(found, number).where("n_shingles > 0")
    first = members.groupBy("component_id").agg(
        F.min_by(number, F.struct(F.col(key).isNull(), F.col(key), F.col(number))).alias(number)
    )
    blank = found.where("n_shingles = 0").select(number)
    kept = first.select(number).union(blank)
    return without(held.join(kept, number, "left_semi"), [number])
