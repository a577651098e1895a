"""Rows that wait in a state, as one value of Arrow bytes.

A state with a list for each column costs an object for each value, in Python and in the JVM, and is
pickled value by value; bytes pass through as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that leave a state at a time.
PIECE_ROWS = 65_536

_TYPES = {"string": pa.large_string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def schema_of(columns: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in columns.items()])


def gathered(held: bytes | None, batches: Iterable[pd.DataFrame], schema: pa.Schema) -> pa.Table:
    """The rows held so far and those of ``batches``."""
    parts = []
    if held is not None:
        parts += pa.ipc.open_stream(pa.py_buffer(bytes(held))).read_all().to_batches()
    for pdf in batches:
        columns = [pa.array(pdf[f.name], f.type, from_pandas=True) for f in schema]
        parts.append(pa.RecordBatch.from_arrays(columns, schema=schema))
    return pa.Table.from_batches(parts, schema)


def as_bytes(rows: pa.Table) -> bytes | None:
    if not len(rows):
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows, max_chunksize=PIECE_ROWS)
    return sink.getvalue().to_pybytes()


def parted(rows: pa.Table, watermark: int, order: list[str]) -> tuple[pa.Table, pa.Table]:
    """Rows the watermark has passed, in order, and those that go on waiting."""
    passed = pc.less_equal(rows["event_ms"], watermark)
    ready, waiting = rows.filter(passed), rows.filter(pc.invert(passed))
    return ready.sort_by([(name, "ascending") for name in order]), waiting


def pieces(rows: pa.Table) -> Iterator[pd.DataFrame]:
    for start in range(0, len(rows), PIECE_ROWS):
        yield rows.slice(start, PIECE_ROWS).to_pandas()
