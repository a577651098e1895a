"""Prefix trie of conversations by van Emde Boas recursion.

A *block* of height 2^k is what a sequence holds at depths j * 2^k + 1 to (j + 1) * 2^k. Blocks get
names from the bottom up, each from the names of its two halves. The recursion then runs from the
top: a *strand* is a block of some sequences that stand under one and the same prefix. Each strand
is cut at half its height. Its upper half joins the upper trie, where equal halves become one
strand; its lower half stands in the forest under the prefix that ends at the cut, which is named by
the hash of the forest above and the upper half. All tries and forests of a height are cut in one
job, so there are log2(depth) of them, whatever the number of forests. Strands of height 1 are the
nodes.

Totals of subtrees are grafted in the same number of steps. Going up, each forest adds those that
hang at its cuts to its own total; going down again, each strand hands what hangs below its end to
its halves, and the forest at its cut to the upper one. No step needs a whole sequence, a whole
forest or all children of a node in one place: sums are combined before each shuffle, the other
joins are one to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlog.functions.checkpoints import forget, stored

#: Name of the root, the prefix without turns.
ROOT = hashlib.sha256(b"root").digest()
#: Ids that are joined into one piece of text before pieces meet.
IDS_A_PIECE = 1 << 16


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", fields: tuple[str, ...] = ("role", "text")
) -> DataFrame:
    """``conv``, ``pos`` (from 1), ``token`` (hash of the fields) and ``bytes`` (of the last field).

    Turns stand in the order of ``order``, nulls first; turns with the same one in that of their
    tokens, so repeated rows stay as so many turns. Null fields are empty; rows with a null ``key``
    belong to no conversation. Rows are ranged by conversation and order, and positions are the
    counts of earlier ranges plus the place in the range, so a long conversation is in many tasks.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).cast("binary") for f in fields]
    sizes = [F.lpad(F.hex(F.octet_length(t).cast("long")), 16, "0").cast("binary") for t in texts[:-1]]
    rows = stored(
        turns.where(F.col(key).isNotNull()).select(
            F.col(key).cast("long").alias("conv"),
            F.col(order).alias("at"),
            _sha(*sizes, *texts).alias("token"),
            F.octet_length(texts[-1]).cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "turns",
    )
    by = [F.col("conv"), F.col("at").asc_nulls_first(), F.col("token"), F.col("id")]
    schema = "conv long, part int, place long, token binary, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            new = np.append(conv[0] != last, conv[1:] != conv[:-1])
            index = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(new, index, -seen))
            place = index - start + 1
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), *batch.columns[1:]],
                names=["conv", "part", "place", "token", "bytes"],
            )

    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "token", "bytes")
    placed = stored(ranged.mapInArrow(run, schema), "placed")
    forget(rows)
    parts = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    # Only the first and last conversation of a range can stand in others, too.
    wide = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("conv")
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.join(wide, "conv", "left_semi").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return placed.join(F.broadcast(before.drop("n")), ["conv", "part"], "left").select(
        "conv", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("pos"), "token", "bytes"
    )


class _Levels:
    """Blocks by height, strands by height, and how many heights there are."""

    def __init__(self, rows: DataFrame):
        """``rows``: ``conv``, ``pos`` from 1 without gaps, ``token``, ``bytes``."""
        self.leaves = stored(
            rows.select("conv", (F.col("pos") - 1).alias("j"), F.col("token").alias("name"), "bytes"), "blocks"
        )
        deepest = self.leaves.agg(F.max("j")).first()[0]
        self.height = 0 if deepest is None else int(deepest).bit_length()
        self.blocks = [self.leaves.select("conv", "j", "name", F.lit(True).alias("full"))]
        for k in range(1, self.height + 1):
            self.blocks.append(stored(self._joined(self.blocks[-1]), f"blocks-{k}"))

    @staticmethod
    def _joined(below: DataFrame) -> DataFrame:
        """Blocks of twice the height, with the names of their halves."""
        half = F.struct("name", "full")
        odd = F.col("j") % 2 == 1
        pairs = below.groupBy("conv", F.floor(F.col("j") / 2).cast("long").alias("j")).agg(
            F.max(F.when(~odd, half)).alias("x"), F.max(F.when(odd, half)).alias("y")
        )
        left, right = F.col("x.name"), F.col("y.name")
        return pairs.select(
            "conv",
            "j",
            F.when(right.isNull(), _sha(left)).otherwise(_sha(left, right)).alias("name"),
            F.coalesce(F.col("y.full"), F.lit(False)).alias("full"),
            left.alias("left"),
            F.col("x.full").alias("left_full"),
            right.alias("right"),
        )

    def ends(self, convs: DataFrame) -> DataFrame:
        """``conv`` and ``end``, the name of the whole sequence, for ``convs`` (``conv``, ``n``)."""
        found = None
        for k, blocks in enumerate(self.blocks):
            # the sequence's length in binary: one block for each bit that is set
            last = F.shiftleft(F.shiftright("n", k + 1), 1)
            rows = convs.where(F.shiftright("n", k).bitwiseAND(F.lit(1)) == 1)
            rows = rows.select("conv", last.alias("j")).join(blocks.select("conv", "j", "name"), ["conv", "j"])
            rows = rows.select("conv", F.lit(-k).alias("k"), "name")
            found = rows if found is None else found.unionByName(rows)
        pieces = F.array_sort(F.collect_list(F.struct("k", "name")))  # one for each height at most
        folded = F.aggregate(pieces, F.lit(ROOT), lambda name, piece: _sha(name, piece["name"]))
        return found.groupBy("conv").agg(folded.alias("end"))


def _strands(rows: DataFrame) -> DataFrame:
    """Equal strands (``forest``, ``base``, ``name``) as one.

    ``strand`` is its own name, ``end`` that of the prefix at its end if it is full, ``hangs`` whether
    it was cut off above, so that a forest can hang at its end.
    """
    merged = rows.groupBy("forest", "base", "name").agg(
        F.sum("n").alias("n"), F.min("top").alias("top"), F.max("end").alias("end"), F.max("hangs").alias("hangs")
    )
    strand = _sha(F.col("forest"), F.col("name"))
    return merged.select(
        strand.alias("strand"), "forest", "base", "name", "n", "top", F.when(F.col("hangs"), strand).otherwise(F.col("end")).alias("end"), "hangs"
    )


def _cut(strands: DataFrame, blocks: DataFrame, half: int) -> DataFrame:
    """Strands of a height with ``up`` and ``low``, the names of the strands of their halves."""
    step = F.col("base") / (2 * half)
    rows = strands.withColumn("j", F.floor(step).cast("long")).withColumnRenamed("top", "conv")
    found = rows.join(blocks.select("conv", "j", "left", "left_full", "right"), ["conv", "j"])
    up = _sha(F.col("forest"), F.col("left"))
    low = F.when(F.col("right").isNotNull(), _sha(up, F.col("right")))
    return found.withColumnRenamed("conv", "top").withColumns({"up": up, "low": low})


def _halves(cut: DataFrame, half: int) -> DataFrame:
    upper = F.struct(
        F.col("forest"),
        F.col("base"),
        F.col("left").alias("name"),
        F.lit(None).cast("binary").alias("end"),
        F.col("left_full").alias("hangs"),
    )
    lower = F.struct(
        F.col("up").alias("forest"),
        (F.col("base") + half).alias("base"),
        F.col("right").alias("name"),
        F.col("end"),
        F.lit(False).alias("hangs"),
    )
    halves = F.filter(F.array(upper, lower), lambda x: x["name"].isNotNull())
    return _strands(cut.select("n", "top", F.explode(halves).alias("x")).select("n", "top", "x.*"))


def _sums(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _grafted(own: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """``strand`` of each node that has something below it, with ``leaves`` and ``saved`` of that.

    ``own``: ``strand``, ``forest``, ``leaves`` and ``saved`` of each node by itself; ``cuts[k]``:
    strands of height 2^k with their halves (for k = 0 there are none).
    """
    totals = ["leaves", "saved"]
    forests = [stored(_sums(own, "forest"), "forests")]
    for k in range(len(cuts) - 1):
        # a forest at a cut adds to the one above it, any other stays
        above = cuts[k].where("hangs").select(F.col("strand").alias("forest"), F.col("forest").alias("above"))
        moved = forests[k].join(above, "forest", "left").select(F.coalesce("above", "forest").alias("forest"), *totals)
        forests.append(stored(_sums(moved, "forest"), "forests"))
    held = None
    for k in reversed(range(len(cuts) - 1)):
        # forests of height 2^k hang at the ends of full upper halves of that height
        hung = cuts[k].where("hangs").select("strand").join(
            forests[k].withColumnRenamed("forest", "strand"), "strand"
        )
        if held is not None:
            both = F.filter(F.array("up", "low"), lambda x: x.isNotNull())
            handed = cuts[k + 1].select("strand", F.explode(both).alias("half")).join(held, "strand")
            hung = hung.unionByName(handed.select(F.col("half").alias("strand"), *totals))
        before, held = held, stored(_sums(hung, "strand"), "held")
        if before is not None:
            forget(before)
    for table in forests:
        forget(table)
    return held


def _digests(members: DataFrame, by: str, member: str) -> DataFrame:
    """SHA-256 of the members of each group, ascending and comma-joined.

    Ids are ranged by group and id and joined into pieces of text; only the pieces of a group meet,
    one after the other, so a task holds one piece whatever the size of its groups.
    """
    order = [by, member]
    schema = f"{by} binary, first long, piece binary"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids = None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([group], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids)).encode()])]
            return pa.RecordBatch.from_arrays(columns, names=[by, "first", "piece"])

        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (name != group or len(ids) == IDS_A_PIECE):
                    yield out()
                    ids = []
                group = name
                ids.append(number)
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            names, texts = [], []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != group:
                    if state is not None:
                        names.append(group)
                        texts.append(state.hexdigest())
                    group, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.string())], names=[by, "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([state.hexdigest()])], names=[by, "ends_sha256"])

    pieces = members.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(join, schema)
    met = pieces.repartition(by).sortWithinPartitions(by, "first").select(by, "piece")
    return met.mapInArrow(digest, f"{by} binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of the sequences in ``rows``.

    ``rows`` has ``conv`` (long), ``pos`` (1, 2, … without gaps), ``token`` (binary) and ``bytes``;
    ``convs`` has every ``conv`` once and ``n``, its length (0: it ends at the root). Each distinct
    sequence of first tokens is a node. Columns: ``conv_id`` (its least member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes
    in its subtree, itself included), ``saved_tokens`` (sum over the subtree of members less one times
    bytes), ``ends_sha256`` (of the members that end here, in ascending order, joined by commas).
    Without conversations there is no root either. Runs jobs.
    """
    levels = _Levels(rows)
    top = levels.height
    whole = levels.blocks[top].where("j = 0").select(
        F.lit(ROOT).alias("forest"),
        F.lit(0).cast("long").alias("base"),
        "name",
        F.lit(1).cast("long").alias("n"),
        F.col("conv").alias("top"),
        F.when(F.col("full"), _sha(F.lit(ROOT), F.col("name"))).alias("end"),
        F.lit(False).alias("hangs"),
    )
    cuts: list[DataFrame] = [None] * (top + 1)
    strands = _strands(whole)
    for k in range(top, 0, -1):
        cuts[k] = stored(_cut(strands, levels.blocks[k], 1 << (k - 1)), "cuts")
        strands = _halves(cuts[k], 1 << (k - 1))
    cuts[0] = strands = stored(strands, "strands")
    family = strands.groupBy(F.col("forest").alias("end")).agg(F.count(F.lit(1)).alias("n_children"))
    size = levels.leaves.select(F.col("conv").alias("top"), F.col("j").alias("base"), "bytes")
    nodes = strands.join(size, ["top", "base"]).join(family, "end", "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(
        nodes.select(
            "strand",
            "forest",
            "end",
            "top",
            (F.col("base") + 1).alias("depth"),
            "n",
            "n_children",
            (F.col("n_children") == 0).cast("long").alias("leaves"),
            ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
        ),
        "nodes",
    )
    own = nodes.select("strand", "forest", "leaves", "saved")
    below = _grafted(own, cuts) if top else own.select("strand", "leaves", "saved").limit(0)
    below = below.select("strand", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    full = nodes.join(below, "strand", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("top")).where("n > 0")
    sums = nodes.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"),
        F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
    )
    root = root.join(F.broadcast(sums)).select(  # one row and one row
        F.lit(ROOT).alias("end"), F.lit(None).cast("binary").alias("forest"), "top", F.lit(0).cast("long").alias("depth"), "n", "n_children", "leaves", "saved"
    )
    full = full.select("end", "forest", "top", "depth", "n", "n_children", plus("leaves", "more_leaves"), plus("saved", "more_saved"))
    full = stored(full.unionByName(root), "trie")
    # Children under one parent may be a third of all nodes: it is the large side that is split.
    parents = full.select(F.col("end").alias("forest"), F.col("top").alias("parent"))
    filled = convs.where("n > 0")
    ended = levels.ends(filled).unionByName(convs.where("n = 0").select("conv", F.lit(ROOT).alias("end")))
    digests = _digests(ended, "end", "conv")
    found = full.join(parents, "forest", "left").join(digests, "end", "left")
    return found.select(
        F.col("top").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def lengths(rows: DataFrame) -> DataFrame:
    """``conv`` and ``n`` turns of ``numbered`` rows."""
    return rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """``numbered`` rows with the heads of conversations exchanged, and all conversations with lengths.

    Conversation c gets the first h turns of conversation c - c % ``group`` (all if it has fewer, none
    if there is none) before its own turns after its first h; h is CRC-32(decimal c) % ``most``.
    """
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = stored(lengths(rows).select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % group).alias("from")), "convs")
    sources = convs.select(F.col("conv").alias("from"), F.col("n").alias("source_n"))
    got = F.least("h", F.coalesce("source_n", F.lit(0)))
    convs = convs.join(sources, "from", "left").select("conv", "from", "h", "n", got.alias("got"))
    convs = stored(convs, "convs")
    heads = rows.where(F.col("pos") < most).withColumnRenamed("conv", "from")
    heads = heads.join(convs.select("conv", "from", "h"), "from").where("pos <= h")
    moved = convs.where("got < h").select("conv", (F.col("h") - F.col("got")).alias("less"))
    tails = rows.where(F.col("pos") > taken).join(moved, "conv", "left")
    tails = tails.select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "token", "bytes")
    length = F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return heads.select("conv", "pos", "token", "bytes").unionByName(tails), convs.select("conv", length.alias("n"))
