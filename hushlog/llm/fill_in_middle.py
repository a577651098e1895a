"""Fill-in-the-middle transformation of whole texts with Arrow's compute functions.

A batch of texts is one pipeline: texts are split into units (list arrays), the units flattened with
the index of their text, their ordinals computed, those of each role (prefix, middle, suffix)
filtered and put back into lists, the lists joined to pieces and the pieces to outputs. Rows never
meet, so nothing is shuffled, and a batch holds a few megabytes or one text.

Draws come from SHA-256 of seed and id, so a row's output depends on nothing but the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hushlog.llm.arrow import free_names, pieces, without

P, S, M = "<P>", "<S>", "<M>"
#: Blanks and the word after them, or blanks at the end.
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: No UTF-8 text holds this byte, so units can be told apart by it.
CUT = b"\xff"

FIELDS = [
    StructField("n", LongType()),
    StructField("form", StringType()),
    StructField("prefix_chars", LongType()),
    StructField("middle_chars", LongType()),
    StructField("output", StringType()),
]


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text, as lists of bytes."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT.encode(), replacement=rb"\1" + CUT)
    parts = pc.split_pattern(marked, pattern=CUT)
    # the piece behind the last mark is always empty
    kept = pc.greater(pc.binary_length(parts.flatten()), 0)
    return _lists(pc.filter(parts.flatten(), kept), pc.filter(pc.list_parent_indices(parts), kept), len(texts))


def _lists(values: pa.Array, parents: pa.Array, n: int) -> pa.ListArray:
    """``values`` as ``n`` lists; ``parents`` are the lists they belong to, in order."""
    offsets = np.searchsorted(parents.to_numpy(zero_copy_only=False), np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _joined(lists: pa.ListArray) -> pa.Array:
    return pc.binary_join(lists, b"").cast(pa.string())


def transform(texts: pa.Array, draw: list[np.ndarray], rate: int, spm: int) -> list[pa.Array]:
    """``FIELDS`` of each text (no nulls); ``draw``: four numbers for each."""
    lists = units(texts)
    n = pc.list_value_length(lists).cast(pa.int64())
    spots = [d % (n.to_numpy() + 1) for d in draw[:2]]
    low, high = np.minimum(*spots), np.maximum(*spots)
    marked = [pc.match_substring(texts, mark) for mark in (P, S, M)]
    plain = pc.or_(pc.or_(marked[0], marked[1]), pc.or_(marked[2], pc.equal(n, 0)))
    plain = pc.or_(plain, pa.array(draw[2] % 100 >= rate))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(draw[3] % 100 < spm), "spm", "psm"))
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    starts = lists.offsets.slice(0, len(lists))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parents).cast(pa.int64()))
    from_middle = pc.greater_equal(ordinal, pc.take(pa.array(low), parents))
    from_suffix = pc.greater_equal(ordinal, pc.take(pa.array(high), parents))
    roles = (pc.invert(from_middle), pc.and_not(from_middle, from_suffix), from_suffix)
    prefix, middle, suffix = (
        _joined(_lists(pc.filter(flat, role), pc.filter(parents, role), len(texts))) for role in roles
    )
    psm = pc.binary_join_element_wise(P, prefix, S, suffix, M, middle, "")
    spm_text = pc.binary_join_element_wise(S, suffix, P, prefix, M, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm_text, psm))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
    return [n, form, *chars, output]


def _split_once(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    parts = pc.split_pattern(texts, pattern=mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that ``output`` was made of. Marks stand in the order of the form, each once."""
    made: pa.Array = output
    for name, second in (("psm", S), ("spm", P)):
        chosen = pc.equal(form, name)
        rows = pc.filter(output, chosen)
        if not len(rows):
            continue
        first, rest = _split_once(pc.utf8_slice_codeunits(rows, 3), second)
        other, middle = _split_once(rest, M)
        prefix, suffix = (first, other) if name == "psm" else (other, first)
        made = pc.replace_with_mask(made, chosen, pc.binary_join_element_wise(prefix, middle, suffix, ""))
    return made


def _large(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "").cast(pa.string())


def with_fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Of ``rate`` per cent of the texts the prefix, middle and suffix change places: form ``spm`` for
    ``spm`` per cent of them, else ``psm``. Texts that are empty, null or hold one of the marks stay
    as they are (``plain``; lengths null). Rows are handled one by one: repeated ones come out alike,
    a null ``key`` counts as an empty one, an empty table gives an empty table. Very long texts are a
    batch of their own. Columns that have the names of the results are replaced.
    """
    base = without(docs, [f.name for f in FIELDS])
    names = free_names(base.columns, 4, "draw")
    drawn = base.select("*", *[d.alias(n) for d, n in zip(draws(F.col(key), seed), names)])
    schema = StructType([*base.schema.fields, *FIELDS])
    width = len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                column = _large(batch.column(batch.schema.get_field_index(text)))
                numbers = [batch.column(width + i).to_numpy() for i in range(4)]
                made = transform(column, numbers, rate, spm)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)

    return drawn.mapInArrow(run, schema)


def with_restored(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with ``restored``, the text before the transformation; null where ``output`` is null."""
    base = without(rows, ["restored"])
    schema = StructType([*base.schema.fields, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, output):
                texts, forms = (batch.column(batch.schema.get_field_index(c)) for c in (output, form))
                made = restore(texts, pc.fill_null(forms, "plain"))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return base.mapInArrow(run, schema)
