"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Most text bytes that one call of a batch function gets, unless one text alone is larger.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of about ``limit`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    cells = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns that new ones would clash with (names compare without case)."""
    taken = {name.lower() for name in names}
    return df.select([df[c] for c in df.columns if c.lower() not in taken])


def free_names(taken: Sequence[str], n: int, stem: str) -> list[str]:
    """``n`` column names that none of ``taken`` has (names compare without case)."""
    used = {name.lower() for name in taken}
    while any(name.startswith(f"_{stem}") for name in used):
        stem += "_"
    return [f"_{stem}{i}" for i in range(n)]


def append_columns(
    df: DataFrame,
    fields: Sequence[StructField],
    make: Callable[[list[str | None]], Sequence[object]],
    text: str = "text",
    raw: bool = False,
) -> DataFrame:
    """``df`` with new columns made from its texts, a few megabytes of them at a time.

    ``make`` gets the texts of some rows (their Arrow column if ``raw``) and returns an array or
    list for each field. A column that already has the name of a new one is replaced.
    """
    base = without(df, [f.name for f in fields])
    schema = StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for whole in batches:
            for batch in pieces(whole, text):
                column = batch.column(batch.schema.get_field_index(text))
                made = make(column if raw else column.to_pylist())
                columns = [
                    values if isinstance(values, pa.Array) else pa.array(values, kind)
                    for values, kind in zip(made, kinds)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *columns],
                    names=[*batch.schema.names, *(f.name for f in fields)],
                )

    return base.mapInArrow(run, schema)
