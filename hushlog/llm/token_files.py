"""Token ids in files: frequency ranks in whole bytes, lengths in control bytes of their own.

Ids are counted over the whole table and numbered by falling frequency, so most take one byte. Four
ids share a control byte that holds two bits for each: its number of bytes less one. A reader looks
the control bytes up in a table of lengths and puts all ids together with a few array operations.
The files are Parquet parts in ascending ``doc_id`` order, one row per document with its control
and data bytes, beside a table of the ids by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from hushlog.functions.checkpoints import forget, stored
from hushlog.llm.arrow import append_columns, pieces, without
from hushlog.llm.byte_bpe import byte_bpe, valid_slots

#: Bytes of each of the four ids that a control byte describes.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.uint8)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow array of the runs of bytes that lie one after the other in ``flat``."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]
    )


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the length of each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def encoded_table(docs: DataFrame, path: str, end: int | None = None, text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` of the whole text as binary, and ``counts``: ids with their number, in
    one row of each batch for all of it.

    Ids take two bytes where the vocabulary allows it, else four. ``end`` is put behind each
    document. A null text counts as empty; ``ids`` is never null.
    """
    kind = _wide(len(byte_bpe(path).width) - 1)

    def make(texts: list[str | None]):
        ids, sizes = byte_bpe(path).encode([t or "" for t in texts])
        if end is not None:
            slots = valid_slots(sizes, sizes + 1)
            both = np.full(len(slots), end, dtype=np.uint32)
            both[slots] = ids
            ids, sizes = both, sizes + 1
        seen = np.bincount(ids)
        found = np.flatnonzero(seen)
        counts = np.stack([found, seen[found]]).astype("<i8").tobytes()
        return (
            _binary(ids.astype(kind), sizes * np.dtype(kind).itemsize),
            pa.array([counts] + [None] * (len(texts) - 1), pa.binary()),
        )

    fields = [StructField("ids", BinaryType()), StructField("counts", BinaryType())]
    return without(append_columns(docs.select("doc_id", F.col(text).alias("text")), fields, make), ["text"])


def id_counts(encoded: DataFrame) -> DataFrame:
    """How often each id occurs in the table: the batches' counts, added up before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                found, seen = np.frombuffer(counts, dtype="<i8").reshape(2, -1)
                if len(found):
                    total = np.append(total, np.zeros(max(0, found[-1] + 1 - len(total)), np.int64))
                    total[found] += seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = encoded.select("counts").where("counts is not null").mapInArrow(add, "id long, n long")
    return rows.groupBy("id").agg(F.sum("n").alias("n"))


def ids_by_rank(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency, then by number; never more of them than the vocabulary has."""
    rows = id_counts(encoded).toPandas().sort_values(["n", "id"], ascending=[False, True])
    return rows["id"].to_numpy(dtype=np.uint32)


def _wide(most: int) -> str:
    return "<u2" if most <= 0xFFFF else "<u4"


def pack(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of all runs, each with their number per run."""
    kind = _wide(int(ranks.max(initial=0)))
    letters = ranks.astype(kind).view(np.uint8).reshape(len(ranks), np.dtype(kind).itemsize)
    more = np.zeros(len(ranks), dtype=np.uint8)  # bytes besides the first
    for k in range(1, letters.shape[1]):
        more += ranks >= 1 << 8 * k
    data = letters[np.arange(letters.shape[1]) <= more[:, None]]
    blocks = -(-sizes // 4)
    codes = np.zeros(int(blocks.sum()) * 4, dtype=np.uint8)
    codes[valid_slots(sizes, blocks * 4)] = more
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    ends = np.append(0, np.cumsum(more, dtype=np.int64))[np.cumsum(sizes)]
    return control, blocks, data, np.diff(np.append(0, ends)) + sizes


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of all runs, from table lookups."""
    width = LENGTHS[control].reshape(-1)[valid_slots(sizes, -(-sizes // 4) * 4)]
    kind = np.dtype("<u2" if width.max(initial=1) <= 2 else "<u4")
    letters = np.zeros((len(width), kind.itemsize), dtype=np.uint8)
    letters[np.arange(kind.itemsize) < width[:, None]] = data
    return letters.view(kind).reshape(-1)


def write_token_files(encoded: DataFrame, folder: str, kind: str = "<u4") -> None:
    """Write an ``encoded_table``, whose ids are numbers of ``kind``, to new files under ``folder``.

    Rows come in ascending ``doc_id`` order (null first), equal ones by their bytes. An empty table
    makes files without rows. ``encoded`` is read more than once: give it a stored table.
    """
    spark = encoded.sparkSession
    by_rank = ids_by_rank(encoded)
    spark.createDataFrame(
        [(i, int(token)) for i, token in enumerate(by_rank)], "rank long, id long"
    ).coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=_wide(len(by_rank)))
    rank[by_rank] = np.arange(len(by_rank))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in pieces(whole, "ids"):
                flat, sizes = _runs(batch.column(1))
                sizes = sizes // np.dtype(kind).itemsize
                control, n_control, data, n_data = pack(rank[flat.view(kind)], sizes)
                ends = before + np.cumsum(sizes)
                columns = [
                    batch.column(0),
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    _binary(control, n_control),
                    _binary(data, n_data),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                before = int(ends[-1])

    schema = StructType(
        [
            encoded.schema["doc_id"],
            StructField("part", IntegerType()),
            StructField("before", LongType()),
            StructField("n_tokens", LongType()),
            StructField("control", BinaryType()),
            StructField("data", BinaryType()),
        ]
    )
    rows = encoded.select("doc_id", "ids").repartitionByRange("doc_id")
    ordered = rows.sortWithinPartitions("doc_id", "ids").mapInArrow(code, schema)
    ordered.write.option("compression", "zstd").parquet(f"{folder}/tokens")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (binary)."""
    by_rank = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    rows = spark.read.parquet(f"{folder}/tokens")
    # one row for each file: at most as many as there are shuffle partitions
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset")
    )
    placed = rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "control", "data"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "data"):
                sizes = batch.column(2).to_numpy()
                control, _ = _runs(batch.column(3))
                data, _ = _runs(batch.column(4))
                ids = by_rank[unpack(control, data, sizes)] if len(control) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], _binary(ids.astype("<u4"), sizes * 4)],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    schema = StructType([*placed.schema.fields[:3], StructField("ids", BinaryType())])
    return placed.mapInArrow(decode, schema)


def token_file_ids(
    docs: DataFrame, path: str, folder: str, end: int | None = None, text: str = "text"
) -> DataFrame:
    """Encode ``docs``, write the files under ``folder``, and read them back.

    Needs ``doc_id`` and the text column; other columns stay out of the files. Null and empty texts
    hold only the ``end`` id, if there is one.
    """
    encoded = stored(encoded_table(docs, path, end, text), "ids")
    write_token_files(encoded, folder, _wide(len(byte_bpe(path).width) - 1))
    forget(encoded)
    return read_token_files(docs.sparkSession, folder)
