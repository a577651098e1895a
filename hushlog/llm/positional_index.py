"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments of a few megabytes, each a row of a stored table: the segment's
terms, their counts, and the word positions of each term. A search goes through all segments side by
side. In a segment, a phrase starts from the shortest list of positions among its terms, shifted
back by the term's place in the phrase, and is cut down by the lists of the next rarer terms until
nothing or only true starts are left. Proximity works on the same lists with a reach instead of a
fixed distance. Test items are taken in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from hushlog.functions.checkpoints import forget, stored
from hushlog.llm.arrow import free_names, pieces
from hushlog.llm.token_files import pack, unpack

#: Free positions between documents of a segment; no phrase or reach is longer.
GAP = 512
WINDOW = 10
#: Text of the test items that one search pass carries to every task.
BLOCK_BYTES = 4 << 20

#: Words are runs of digits, a-z and whatever is not ASCII; A-Z are lower-cased first.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def build_index(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row for each segment of ``docs``; ``keys`` are kept for each document.

    A document's place is its segment's number and its own in the segment. A null text has no words.
    Repeated rows are documents of their own. No row, no segment. Store the result before it is
    searched: places belong to one run of the job.
    """
    kept = [docs.schema[k] for k in keys]
    schema = StructType(
        [
            *[StructField(f.name, ArrayType(f.dataType)) for f in kept],
            StructField("n_words", ArrayType(LongType())),
            StructField("segment", LongType()),
            StructField("terms", BinaryType()),
            StructField("counts", BinaryType()),
            StructField("control", BinaryType()),
            StructField("data", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = [words_of(t) for t in batch.column(len(kept)).to_pylist()]
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                words = [word for one in found for word in one]
                ids = {word: i for i, word in enumerate(dict.fromkeys(words))}
                term = np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words))
                place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
                order = np.argsort(term, kind="stable")
                counts = np.bincount(term, minlength=len(ids))
                place = place[order]
                steps = np.diff(place, prepend=0)
                first = np.cumsum(counts) - counts
                steps[first] = place[first]
                control, _, data, _ = pack(steps, np.array([len(steps)]))
                row = [
                    *[pa.ListArray.from_arrays([0, len(batch)], c) for c in batch.columns[: len(kept)]],
                    pa.ListArray.from_arrays([0, len(batch)], pa.array(sizes)),
                    pa.array([number], pa.int64()),
                    *[
                        pa.array([b], pa.binary())
                        for b in (
                            b" ".join(ids),
                            counts.astype("<u4").tobytes(),
                            control.tobytes(),
                            data.tobytes(),
                        )
                    ],
                ]
                number += 1
                yield pa.RecordBatch.from_arrays(row, names=[f.name for f in schema.fields])

    rows = docs.select(*keys, F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


@dataclass
class Block:
    """Some test items: their terms, distinct windows (terms, -1 after the end) and whose they are."""

    terms: dict[bytes, int]
    windows: np.ndarray
    owners: list[list[str]]


def compile_block(items: Sequence[tuple[str | None, str | None]], size: int = WINDOW) -> Block:
    """Windows of ``size`` words; an item with fewer, but not none, is one window."""
    terms: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], dict[str, None]] = {}
    for item, text in items:
        ids = [terms.setdefault(word, len(terms)) for word in words_of(text)]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            owner = owners.setdefault(tuple(ids[i : i + size]), {})
            if item is not None:
                owner[item] = None
    windows = np.full((len(owners), size), -1, dtype=np.int32)
    for row, window in zip(windows, owners):
        row[: len(window)] = window
    return Block(terms, windows, [list(owner) for owner in owners.values()])


class Segment:
    """The lists of positions of a stored segment."""

    def __init__(self, n_words, terms: bytes, counts: bytes, control: bytes, data: bytes):
        self.sizes = np.asarray(n_words, dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes + np.arange(len(self.sizes)) * GAP
        self.terms = terms.split(b" ") if terms else []
        self.counts = np.frombuffer(counts, dtype="<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        bits = [np.frombuffer(b, dtype=np.uint8) for b in (control, data)]
        steps = unpack(*bits, np.array([int(self.counts.sum())]))
        total = np.cumsum(steps, dtype=np.int64)
        # sums go on over terms; each list starts anew
        base = np.where(self.first > 0, total[self.first - 1], 0) if len(total) else self.first
        self.places = total - np.repeat(base, self.counts)

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.first[term] : self.first[term] + self.counts[term]]

    def present(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms all occur here, with their terms and places from rare to frequent."""
        local = np.full(len(block.terms) + 1, -1, dtype=np.int64)
        for i, term in enumerate(self.terms):
            at = block.terms.get(term)
            if at is not None:
                local[at] = i
        count = np.append(self.counts, 0)[local]  # absent terms take the last
        count[-1] = np.iinfo(np.int64).max
        frequency = count[block.windows]  # -1, after the end of a short item, comes behind all terms
        rows = np.flatnonzero(frequency.min(axis=1, initial=1) > 0)
        order = np.argsort(frequency[rows], axis=1, kind="stable")
        return rows, np.take_along_axis(local[block.windows[rows]], order, axis=1), order

    def phrases(self, block: Block) -> Iterator[tuple[int, np.ndarray]]:
        """Windows that occur, each with its starts."""
        for row, terms, offsets in zip(*self.present(block)):
            starts = None
            for term, offset in zip(terms.tolist(), offsets.tolist()):
                if term < 0:
                    break
                places = self.list_of(term)
                if starts is None:
                    starts = places - offset
                    continue
                wanted = starts + offset
                at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
                starts = starts[places[at] == wanted]
                if not len(starts):
                    break
            if len(starts):
                yield row, starts

    def close(self, block: Block, slop: int) -> Iterator[tuple[int, np.ndarray]]:
        """Windows whose words all stand, in any order, within ``slop`` words more than their own
        number; each with places of its rarest word where that is so."""
        for row, terms, _ in zip(*self.present(block)):
            wanted = [t for t in dict.fromkeys(terms.tolist()) if t >= 0]
            span = int((terms >= 0).sum()) + slop
            lists = [self.list_of(t) for t in wanted]
            near = lists[0]
            for places in lists[1:]:
                at = np.searchsorted(places, near - span + 1)
                reached = places[np.minimum(at, len(places) - 1)]
                near = near[(at < len(places)) & (reached < near + span)]
                if not len(near):
                    break
            good = [p for p in near.tolist() if _within(lists, p, span)]
            if good:
                yield row, np.array(good)


def _within(lists: list[np.ndarray], place: int, span: int) -> bool:
    """Is there a stretch of ``span`` places around ``place`` that meets every list?"""
    starts = np.arange(place - span + 1, place + 1)
    for places in lists:
        at = np.searchsorted(places, starts)
        reached = places[np.minimum(at, len(places) - 1)]
        starts = starts[(at < len(places)) & (reached < starts + span)]
        if not len(starts):
            return False
    return True


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


HIT = "array<struct<start:int,end:int>>"


def search_block(
    index: DataFrame, keys: Sequence[str], block: Block, slop: int | None
) -> tuple[DataFrame, Broadcast]:
    """``keys``, ``n_words``, ``hits``, ``items``, ``near``, ``segment`` and ``place`` of every document
    of ``index``, and the broadcast that it reads."""
    kept = [index.schema[k] for k in keys]
    hit = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType(
        [
            *[StructField(f.name, f.dataType.elementType) for f in kept],
            StructField("n_words", LongType()),
            StructField("hits", ArrayType(hit)),
            StructField("items", ArrayType(StringType())),
            StructField("near", ArrayType(StringType())),
            StructField("segment", LongType()),
            StructField("place", IntegerType()),
        ]
    )
    shared = index.sparkSession.sparkContext.broadcast(block)
    lengths = (block.windows >= 0).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(kept) + 1 : -2]]
        tests = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                n_words = batch.column(len(kept))[k].values.to_numpy()
                segment = Segment(n_words, *[batch.column(len(kept) + 2 + j)[k].as_py() for j in range(4)])
                n = len(n_words)
                items: list[dict[str, None]] = [{} for _ in range(n)]
                close: list[dict[str, None]] = [{} for _ in range(n)]
                edges = np.zeros(int(segment.sizes.sum()) + n * GAP + 1, dtype=np.int64)
                touched = set()
                for row, starts in segment.phrases(tests):
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + lengths[row], -1)
                    for doc in set((np.searchsorted(segment.begin, starts, "right") - 1).tolist()):
                        items[doc].update(dict.fromkeys(tests.owners[row]))
                        touched.add(doc)
                if slop is not None:
                    for row, places in segment.close(tests, slop):
                        for doc in set((np.searchsorted(segment.begin, places, "right") - 1).tolist()):
                            close[doc].update(dict.fromkeys(tests.owners[row]))
                marks = (np.cumsum(edges) > 0).astype(np.int8)
                hits = [
                    [
                        {"start": a, "end": b}
                        for a, b in _runs(marks[segment.begin[d] : segment.begin[d] + segment.sizes[d]])
                    ]
                    if d in touched
                    else []
                    for d in range(n)
                ]
                columns = [
                    *[batch.column(j)[k].values for j in range(len(kept))],
                    pa.array(n_words),
                    pa.array(hits, kinds[0]),
                    *[pa.array([list(i) for i in ids], t) for ids, t in zip((items, close), kinds[1:])],
                    pa.array(np.full(n, batch.column(len(kept) + 1)[k].as_py(), dtype=np.int64)),
                    pa.array(np.arange(n, dtype=np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return index.mapInArrow(run, schema), shared


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    rows, size = [], 0
    for row in items.toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def hit_words(hits: Column) -> Column:
    """Words inside any of the spans, which may overlap."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(hits),
        state,
        lambda s, h: F.struct(
            F.greatest(s["end"], h["end"]).alias("end"),
            (s["n"] + F.greatest(h["end"] - F.greatest(h["start"], s["end"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )


def search(
    index: DataFrame,
    items: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    item: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    slop: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Matches of the test ``items`` in every document of a stored ``index``.

    Returns ``keys``, ``n_words``, ``hits`` (spans of words inside a phrase, end exclusive),
    ``items`` (ids, as strings, of items with a phrase there) and ``near`` (those with a window
    whose words stand close together in any order; empty where ``slop`` is None). Items without
    words match nothing; items without an id mark words but are not named. Repeated and null ``keys``
    are documents of their own. The items go through the driver in blocks of ``block_bytes``, one at
    a time; with several of them, a document's spans are put together by its place in the index.
    """
    if window + (slop or 0) >= GAP:
        raise ValueError(f"a window with its slop must be shorter than {GAP} words")
    rows = items.select(F.col(item).cast("string"), F.col(text))
    blocks = _blocks(rows, block_bytes)
    block, more = next(blocks, []), next(blocks, None)
    found, shared = search_block(index, keys, compile_block(block, window), slop)
    result = [*keys, "n_words", "hits", "items", "near"]
    if more is None:
        return found.select(result)
    # one block at a time; of all but the first only documents with a match
    passes = []
    while True:
        passes.append(stored(found, "found"))
        shared.unpersist()
        if more is None:
            break
        found, shared = search_block(index, keys, compile_block(more, window), slop)
        found = found.where((F.size("items") > 0) | (F.size("near") > 0) | (F.size("hits") > 0))
        more = next(blocks, None)
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    joined = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
    merged = every.groupBy("segment", "place").agg(
        F.first(F.struct(*keys, "n_words")).alias("document"), joined("hits"), joined("items"), joined("near")
    )
    return merged.select("document.*", "hits", "items", "near")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of an item.

    Documents are told apart by a digest of their text alone, so null and repeated ids are no
    matter; equal texts go or stay together. Null and empty texts stay, an empty table stays empty.
    """
    (key,) = free_names(docs.columns, 1, "text")
    keyed = docs.withColumn(key, F.sha2(F.col(text), 256))
    index = stored(build_index(keyed, [key], text), "index")
    hit = search(index, items, [key], window=window).where(F.size("hits") > 0)
    bad = stored(hit.select(key).distinct(), "contaminated")
    forget(index)
    return keyed.join(bad, key, "left_anti").select(docs.columns)
