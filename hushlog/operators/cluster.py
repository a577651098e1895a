"""Near-identical templates: each maps to the first-seen leader it resembles.

Within a logger and level, in order of first appearance, a template is a leader unless an earlier
leader resembles it; a follower maps to its earliest such leader.  Only distinct templates are
compared.  Candidates share enough q-grams, counted on bit signatures (a lossless filter for the edit
distance allowed), and a template is compared with leaders, never with all its near copies: each round
settles the earliest undecided templates of every block and then removes whatever resembles the new
leaders.  Rounds take more and more templates as long as few of those they take resemble each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlog.functions.checkpoints import cut, forget, stored
from hushlog.options import Options

# Fixed value: beyond this length two texts are compared by their lengths alone.
LONG_CHARS = 200

# Templates of one block settled per round.  The first rounds are smaller: the leaders of dense groups
# turn up early and clear most of their copies.  Beyond DENSE_BATCH a round grows only if no block had
# more than SPARSE_PAIRS similar pairs for each template it could hold.
BATCH = 262_144
DENSE_BATCH = 1024
SPARSE_PAIRS = 8
FIRST_BATCH = 64
BATCH_GROWTH = 4
# Texts of a block that one task compares with leaders; a block with more is cut into cells of similar
# lengths, those into slices.
CELL_ROWS = 8192
# Bits of a signature for each character; rounded up to a power of two.
_BITS_A_CHAR = 6
# Characters whose q-grams are worked on at a time; leaders and texts compared at a time; candidates sent on at a time.
_RUN_CHARS = 1 << 19
_LEFT_ROWS, _RIGHT_ROWS = 16, 4096
_PAIRS = 16_384
# Follower tables up to this size are broadcast to the rows.
BROADCAST_BYTES = 64 * 1024 * 1024

_BLOCK = "block"


def similarity(len_a: Column, len_b: Column, distance: Column) -> Column:
    """Percent of the longer text left untouched, truncated."""
    longer = F.greatest(len_a, len_b).cast("double")
    return ((longer - distance) / longer * 100).cast("int")


def allowed_distance(len_a: Column, len_b: Column, threshold: int) -> Column:
    """Largest edit distance that can still reach the threshold."""
    return F.floor(F.greatest(len_a, len_b) * (100 - threshold) / 100).cast("int")


def gram_size(threshold: int) -> int:
    """Largest q for which texts within the allowed distance always share a filtered q-gram."""

    def lossless(q: int) -> bool:
        share = 100 - threshold
        if share and 100 / share - q < 1:
            return False
        return all(
            n - q + 1 - (n * share // 100) * q >= 1 for n in range(1, 401) if n * share >= 100
        )

    return next(q for q in (3, 2, 1) if q == 1 or lossless(q))


def _by_edit_distance(length: Column, opts: Options) -> Column:
    return F.lit(True) if opts.long_text == "exact" else length <= LONG_CHARS


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, one after the other, as numbers, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.append(starts[1:], len(data))
    points = data[starts].astype(np.uint64)
    for k in range(1, 4):
        more = starts + k < ends
        points[more] |= data[starts[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return points, np.diff(np.searchsorted(starts, offsets - offsets[0]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(texts: pa.Array, q: int) -> pa.Array:
    """Bits that stand for the q-grams of each text, repeats numbered.

    q-grams may share a bit, so a bit that one text lacks is at least one q-gram that it lacks.
    """
    points, lengths = _code_points(texts)
    rows = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    grams = np.zeros(max(0, len(points) - q + 1), np.uint64)
    for k in range(q):
        grams = _mixed(grams + points[k : k + len(grams)] + np.uint64(0x9E3779B97F4A7C15))
    inside = rows[: len(grams)] == rows[q - 1 :]
    # the row in the high bits: one plain sort brings repeats together
    keys = np.sort((rows[: len(grams)][inside] << np.uint64(40)) | (grams[inside] >> np.uint64(24)))
    places = np.arange(len(keys))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    copy = places - np.maximum.accumulate(np.where(first, places, 0))
    row = (keys >> np.uint64(40)).astype(np.int64)
    gram = keys & np.uint64((1 << 40) - 1)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, lengths * _BITS_A_CHAR))).astype(np.int64))
    ends = np.cumsum(width)
    bit = _mixed(gram + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64) & (width[row] - 1)
    bits = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    bits[(ends - width)[row] + bit] = 1
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    packed = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(
        pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())]
    )


def _plain(column: pa.Array, kind: pa.DataType) -> pa.Array:
    return column if column.type == kind else column.cast(kind)


def _add_signatures(batches: Iterator[pa.RecordBatch], q: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _plain(batch.column(batch.schema.get_field_index("template")), pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _RUN_CHARS, side="right")) - 1)
            part = batch.slice(start, end - start)
            yield part.append_column("bits", _signatures(texts.slice(start, end - start), q))
            start = end


def _gram_keys(nodes: DataFrame, opts: Options) -> DataFrame:
    """``(id, template, bits, around)`` of the texts that are compared by edit distance.

    ``bits`` is the signature of a text's q-grams.  ``around`` holds the cells of shorter, similar and
    longer texts of its block, each with its number of slices; the second is its own.
    """
    texts = nodes.filter(_by_edit_distance(F.col("len"), opts) & (F.col("len") > 0))
    # texts within the distance are at most one band apart; a little wider, against rounding
    band_width = max(0.01, -math.log(opts.similarity_threshold / 100) * 1.001)
    band = F.floor(F.ln("len") / band_width).cast("int")
    in_block = Window.partitionBy(_BLOCK)
    cells = cut(
        texts.groupBy(_BLOCK, band.alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
        # a small block is one cell
        .withColumn("band", F.when(F.sum("n").over(in_block) > CELL_ROWS, F.col("band")).otherwise(0))
        .groupBy(_BLOCK, "band")
        .agg(F.ceil(F.sum("n") / CELL_ROWS).cast("int").alias("slices"))
        .withColumn("cell", F.monotonically_increasing_id())
        .groupBy(_BLOCK)
        .agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("cell", "slices")))).alias("cells"))
    )
    size = cells.agg(F.sum((F.size("cells") * 32 + 256).cast("long"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        cells = F.broadcast(cells)
    alone = F.size("cells") == 1
    around = F.when(alone, F.array(F.lit(None), F.map_values("cells")[0], F.lit(None))).otherwise(
        F.array(*(F.try_element_at("cells", band + step) for step in (-1, 0, 1)))
    )
    q = gram_size(opts.similarity_threshold)
    placed = texts.join(cells, _BLOCK).select("id", "template", around.alias("around"))
    schema = T.StructType([*placed.schema.fields, T.StructField("bits", T.BinaryType())])
    return placed.mapInArrow(lambda batches: _add_signatures(batches, q), schema)


class _Texts:
    """Texts of one side of a cell, in order of length."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        table = table.take(pa.compute.sort_indices(table, [("len", "ascending")])).combine_chunks()
        self.ids = table["id"].to_numpy()
        self.lengths = table["len"].to_numpy().astype(np.int64)
        self.templates = table["template"]
        bits = _plain(table["bits"].combine_chunks(), pa.binary())
        if isinstance(bits, pa.ChunkedArray):
            bits = pa.concat_arrays(bits.chunks)
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1]
        data = np.frombuffer(bits.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
        self.widths = np.diff(offsets) // 8
        self.words = {}
        # widths grow with the length, so texts of a width follow each other
        for width in np.unique(self.widths):
            low, high = np.searchsorted(self.widths, [width, width + 1])
            start = (offsets[low] - offsets[0]) // 8
            words = data[start : start + (high - low) * width].reshape(high - low, width)
            self.words[int(width)] = int(low), int(high), words

    def folded(self, width: int, to: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Texts of a width as signatures of half the width or the same, a row for each word, and their bits."""
        low, high, words = self.words[width]
        if to < width:
            words = words[:, :to] | words[:, to:]
        return low, high, np.ascontiguousarray(words.T), np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _candidates(left: _Texts, right: _Texts, threshold: int) -> Iterator[pa.RecordBatch]:
    """Pairs, left seen before right, that share as many q-grams as the edit distance allowed leaves.

    An edit spoils at most q q-grams, so all but ``distance * q`` bits of either text are in the other.
    """
    q, share = gram_size(threshold), 100 - threshold
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_found = 0
    for left_width in left.words:
        for right_width in right.words:
            if not left_width <= 2 * right_width <= 4 * left_width:
                continue
            to = min(left_width, right_width)
            low, high, left_words, left_bits = left.folded(left_width, to)
            right_low, right_high, right_words, right_bits = right.folded(right_width, to)
            right_lengths = right.lengths[right_low:right_high]
            count = np.uint8 if max(left_bits.max(), right_bits.max()) < 256 else np.uint32
            for i in range(0, high - low, _LEFT_ROWS):
                j = min(high - low, i + _LEFT_ROWS)
                lengths = left.lengths[low + i : low + j]
                first = np.searchsorted(right_lengths, lengths[0] * threshold // 100)
                last = np.searchsorted(right_lengths, lengths[-1] * 100 // threshold + 1, side="right")
                for k in range(first, last, _RIGHT_ROWS):
                    m = min(last, k + _RIGHT_ROWS)
                    both = np.empty((j - i, m - k), np.uint64)
                    ones = np.empty((j - i, m - k), np.uint8)
                    shared = np.zeros((j - i, m - k), count)
                    for word in range(to):
                        np.bitwise_and(left_words[word, i:j, None], right_words[word, None, k:m], out=both)
                        np.bitwise_count(both, out=ones)
                        np.add(shared, ones, out=shared)
                    # at least so much for the lengths of these left texts, then exactly
                    most = np.maximum(lengths[-1], right_lengths[k:m]) * share // 100 * q
                    least = np.maximum(left_bits[i:j].min(), right_bits[k:m]) - most
                    a, b = np.nonzero(shared >= np.maximum(least, 0).astype(count))
                    a_len, b_len = lengths[a], right_lengths[k + b]
                    bound = np.maximum(a_len, b_len) * share // 100
                    enough = shared[a, b] >= np.maximum(left_bits[i + a], right_bits[k + b]) - bound * q
                    a, b = a + (low + i), b + (right_low + k)
                    keep = enough & (np.abs(a_len - b_len) <= bound) & (left.ids[a] < right.ids[b])
                    found.append((a[keep], b[keep]))
                    n_found += len(found[-1][0])
                    if n_found >= _PAIRS:
                        yield from _named_pairs(left, right, found)
                        found, n_found = [], 0
    yield from _named_pairs(left, right, found)


_PAIR = "left_id long, right_id long, left_len int, right_len int, left_template string, right_template string"


def _named_pairs(left: _Texts, right: _Texts, found: list) -> Iterator[pa.RecordBatch]:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else a
    for i in range(0, len(a), _PAIRS):
        x, y = a[i : i + _PAIRS], b[i : i + _PAIRS]
        columns = {
            "left_id": pa.array(left.ids[x]),
            "right_id": pa.array(right.ids[y]),
            "left_len": pa.array(left.lengths[x].astype(np.int32)),
            "right_len": pa.array(right.lengths[y].astype(np.int32)),
            "left_template": left.templates.take(pa.array(x)),
            "right_template": right.templates.take(pa.array(y)),
        }
        yield from pa.table(columns).combine_chunks().to_batches()


def _candidates_of_cells(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Candidates of rows that come cell by cell, the left texts of each before the right ones."""
    cell, left, texts = None, [], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "slice", "side")]
        runs = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        for start, end in zip([0, *runs], [*runs, len(batch)]):
            if start == end:
                continue
            own, side = (columns[0][start], columns[1][start]), columns[2][start]
            if own != cell:
                cell, left, texts = own, [], None
            run = batch.slice(start, end - start)
            if side == 0:
                left.append(run)
            elif left:
                texts = texts or _Texts(left)
                yield from _candidates(texts, _Texts([run]), threshold)


def _similar_by_text(left: DataFrame, right: DataFrame, keys: DataFrame, opts: Options) -> DataFrame:
    """Pairs ``(left_id, right_id)`` of similar texts, left seen before right."""
    threshold = opts.similarity_threshold
    named = ["id", "len", "template", "bits"]

    def side(nodes: DataFrame) -> DataFrame:
        if "bits" in nodes.columns:
            return nodes.filter(F.col("bits").isNotNull())
        return nodes.select("id", "len").join(keys, "id")

    def slices_of(cell: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), cell.slices - 1), lambda i: F.struct(cell.cell, i.alias("slice")))
        return F.when(cell.isNotNull(), every).otherwise(F.array().cast("array<struct<cell:bigint,slice:int>>"))

    own = F.col("around")[1]
    to_all = side(left).select(
        *named, F.lit(0).alias("side"), F.explode(F.flatten(F.transform("around", slices_of))).alias("to")
    )
    to_one = side(right).select(
        *named,
        F.lit(1).alias("side"),
        F.struct(own.cell.alias("cell"), F.pmod("id", own.slices).cast("int").alias("slice")).alias("to"),
    )
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a_len, b_len = F.col("left_len"), F.col("right_len")
    return (
        to_all.unionByName(to_one)
        .select(*named, "side", "to.cell", "to.slice")
        # rows are few bytes but much work: adaptive execution would merge them into few tasks
        .repartition(tasks, "cell", "slice")
        .sortWithinPartitions("cell", "slice", "side")
        .mapInArrow(lambda batches: _candidates_of_cells(batches, threshold), _PAIR)
        .repartition(tasks, "left_id", "right_id")
        .withColumn("bound", allowed_distance(a_len, b_len, threshold))
        .withColumn("distance", F.expr("levenshtein(left_template, right_template, bound)"))
        .filter((F.col("distance") >= 0) & (similarity(a_len, b_len, F.col("distance")) >= threshold))
        .select("left_id", "right_id")
    )


def _similar_in_batch(batch: DataFrame, keys: DataFrame, opts: Options) -> DataFrame:
    """Similar pairs among the few templates of a batch, as ``(left_id, right_id)``."""
    pairs = _similar_by_text(batch, batch, keys, opts)
    if opts.long_text == "exact":
        return pairs
    left = batch.select("group", *(F.col(c).alias(f"left_{c}") for c in ("id", "len")))
    right = batch.select("group", *(F.col(c).alias(f"right_{c}") for c in ("id", "len")))
    a_len, b_len = F.col("left_len"), F.col("right_len")
    by_length = (
        left.filter(a_len * 100 > LONG_CHARS * opts.similarity_threshold)
        .join(right.filter(b_len * 100 > LONG_CHARS * opts.similarity_threshold), "group")
        .filter((F.col("left_id") < F.col("right_id")) & (F.greatest(a_len, b_len) > LONG_CHARS))
        .filter(similarity(a_len, b_len, F.abs(a_len - b_len)) >= opts.similarity_threshold)
    )
    return pairs.unionByName(by_length.select("left_id", "right_id"))


def _settle(pairs: pd.DataFrame) -> pd.DataFrame:
    """First-come leaders among the pairs of one block of a batch: follower and its leader."""
    leader_of: dict[int, int] = {}
    ordered = pairs.sort_values(["right_id", "left_id"])
    for earlier, later in zip(ordered["left_id"].tolist(), ordered["right_id"].tolist()):
        if later not in leader_of and earlier not in leader_of:
            leader_of[later] = earlier
    return pd.DataFrame({"id": list(leader_of), "leader_id": list(leader_of.values())}, dtype="int64")


def _settle_batch(batch: DataFrame, keys: DataFrame, opts: Options) -> tuple[DataFrame, int]:
    """Batch with ``leader_id``, and the most similar pairs of a block; a leader leads itself."""
    pairs = cut(
        _similar_in_batch(batch, keys, opts).join(
            batch.select(F.col("id").alias("left_id"), "group"), "left_id"
        )
    )
    densest = pairs.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    followers = pairs.groupBy("group").applyInPandas(_settle, "id long, leader_id long")
    settled = batch.join(followers, "id", "left")
    return cut(settled.withColumn("leader_id", F.coalesce("leader_id", "id"))), densest


def _follow(rest: DataFrame, leaders: DataFrame, keys: DataFrame, opts: Options) -> DataFrame:
    """Later templates with ``leader_id``, the earliest new leader they resemble, or null."""
    by_text = (
        _similar_by_text(leaders, rest, keys, opts)
        .groupBy(F.col("right_id").alias("id"))
        .agg(F.min("left_id").alias("by_text"))
    )
    out = rest.join(by_text, "id", "left")
    if opts.long_text == "exact":
        return out.withColumnRenamed("by_text", "leader_id")
    # length alone decides once either text is long: per block and length one leader is the first
    threshold = opts.similarity_threshold
    length, covered = F.col("len"), F.col("covered")
    lowest = F.ceil(length * threshold / 100).cast("int")
    highest = F.floor(length * 100 / threshold).cast("int")
    by_length = (
        leaders.filter(highest > LONG_CHARS)
        .select(_BLOCK, "len", "id", F.explode(F.sequence(lowest, highest)).alias("covered"))
        .filter(F.greatest(length, covered) > LONG_CHARS)
        .filter(similarity(length, covered, F.abs(length - covered)) >= threshold)
        .groupBy(_BLOCK, covered.alias("len"))
        .agg(F.min("id").alias("by_length"))
    )
    return (
        out.join(by_length, [_BLOCK, "len"], "left")
        .withColumn("leader_id", F.least("by_text", "by_length"))
        .drop("by_text", "by_length")
    )


def _with_leader_texts(nodes: DataFrame, followers: DataFrame) -> DataFrame:
    """Every template with that of its leader; what is small enough is broadcast to the templates."""
    followers = cut(followers)
    used = followers.select("leader_id").distinct()
    texts = cut(
        nodes.select(F.col("id").alias("leader_id"), F.col("template").alias("leader_text")).join(used, "leader_id")
    )
    if followers.count() * 32 <= BROADCAST_BYTES:
        followers = F.broadcast(followers)
    if (texts.agg(F.sum(F.octet_length("leader_text") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    leader = F.coalesce("leader_text", "template").alias("leader_template")
    return (
        nodes.join(followers, "id", "left")
        .join(texts, "leader_id", "left")
        .select("block.logger", "block.level", "template", leader)
    )


def cluster_templates(
    stats: DataFrame, opts: Options = Options(), batch_size: int = BATCH
) -> DataFrame:
    """``(logger, level, template, leader_template)`` for every template of ``template_stats``."""
    if not opts.fuzzy:
        return stats.select("logger", "level", "template", F.col("template").alias("leader_template"))
    return _with_leader_texts(*_clustered(stats, opts, batch_size))


def numbered_leaders(stats: DataFrame, opts: Options = Options()) -> DataFrame:
    """``(logger, level, template, leader)`` for every template: a number, in digits, that its near copies share."""
    nodes, followers = _clustered(stats, opts, BATCH)
    followers = cut(followers)
    if followers.count() * 32 <= BROADCAST_BYTES:
        followers = F.broadcast(followers)
    return nodes.join(followers, "id", "left").select(
        "block.logger", "block.level", "template", F.coalesce("leader_id", "id").cast("string").alias("leader")
    )


def _clustered(stats: DataFrame, opts: Options, batch_size: int) -> tuple[DataFrame, DataFrame]:
    """All templates with an ``id``, and of those that follow ``(id, leader_id)``."""
    templates = stats.select(
        F.struct("logger", "level").alias(_BLOCK),
        "template",
        "first_ms",
        F.char_length("template").alias("len"),
    )
    # ids grow with the place of a template in its block
    nodes = stored(
        templates.orderBy(_BLOCK, "first_ms", "template").withColumn("id", F.monotonically_increasing_id()),
        "templates",
    )
    keys = stored(_gram_keys(nodes, opts), "signatures")
    undecided, settled = nodes.select("id", _BLOCK, "len").join(keys, "id", "left"), []
    first_come = Window.partitionBy(_BLOCK).orderBy("id")
    size = min(FIRST_BATCH, batch_size)
    while True:
        batch = cut(
            # tasks keep no more than a batch per block before the shuffle
            undecided.withColumn("no", F.row_number().over(first_come))
            .filter(F.col("no") <= size)
            # the id of a block's first template stands for the block
            .withColumn("group", F.min("id").over(Window.partitionBy(_BLOCK)))
            .drop("no")
        )
        done, densest = _settle_batch(batch, keys, opts)
        settled.append(done.select("id", "leader_id"))
        rest = undecided.join(batch.select("id"), "id", "left_anti")
        if rest.isEmpty():
            break
        # what is settled is kept to the end, without the text
        matched = _follow(rest, done.filter("id = leader_id"), keys, opts)
        matched = cut(matched.withColumns({c: F.expr(f"IF(leader_id IS NULL, {c}, NULL)") for c in keys.columns[1:]}))
        settled.append(matched.filter("leader_id IS NOT NULL").select("id", "leader_id"))
        undecided = matched.filter("leader_id IS NULL").drop("leader_id")
        if undecided.isEmpty():
            break
        if size < DENSE_BATCH or densest <= SPARSE_PAIRS * size:
            size = min(size * BATCH_GROWTH, batch_size)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    forget(keys)
    return nodes, out.filter("id <> leader_id")


def with_leader(df: DataFrame, leaders: DataFrame) -> DataFrame:
    """Add ``leader_template`` to rows with a template; a template not listed leads itself.

    Only followers are joined.  Their table is broadcast when its measured size allows, else the
    rows are shuffled by template and adaptive execution splits templates that are too frequent.
    """
    moved = leaders.filter(F.col("template") != F.col("leader_template"))
    return _looked_up(df, moved, "leader_template").withColumn(
        "leader_template", F.coalesce("leader_template", "template")
    )


def with_leader_number(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows whose ``leader_template`` is the number of :func:`numbered_leaders`, a key of few bytes."""
    return _looked_up(df, numbers.withColumnRenamed("leader", "leader_template"), "leader_template")


def _looked_up(df: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``df`` with the ``value`` that ``table`` has for its template; null where it has none."""
    table = table.select(F.struct("logger", "level", "template").alias("lookup"), value)
    # lengths of the texts plus a generous overhead per row
    texts = ("lookup.logger", "lookup.level", "lookup.template", value)
    row_bytes = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(128))
    size = table.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return (
        df.withColumn("lookup", F.struct("logger", "level", "template"))
        .join(table, "lookup", "left")
        .drop("lookup")
    )
