"""BPE encoding that reuses content-defined chunks, and its decoding.

A hash of the last eight bytes, worked out at every place of the text, marks where chunks end, so
copies and shared passages fall into the same chunks wherever they stand. A chunk that the worker
has met before is not encoded again. Tokens near its ends may be wrong, since words can go on in
the next chunk; each join is repaired by encoding again the text around it. That window grows over
chunks until both its ends are at places where a new pre-token begins in any context: there its
tokens and the chunk's agree with those of the whole text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField

from hushlog.llm.arrow import append_columns
from hushlog.llm.byte_bpe import SAFE_CUT, ByteBpe, Ragged, byte_bpe
from hushlog.llm.token_files import _binary, _runs

#: Bytes the hash sees, bits of it that must be zero (chunks of about 2**BITS bytes), least distance
#: between two ends.
SEEN, BITS, LEAST = 8, 8, 64
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Chunks and ids of chunks that a worker remembers; beyond that it forgets all and goes on.
REMEMBERED_CHUNKS, REMEMBERED_IDS = 1 << 15, 1 << 22


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends of the chunks of one text, in bytes; its own end is the last."""
    n = len(data)
    if n <= SEEN:
        return np.array([n] if n else [], dtype=np.int64)
    windows = np.ndarray((n - SEEN + 1,), dtype="<u8", buffer=data, strides=(1,))
    marked = np.flatnonzero((windows * FACTOR) >> np.uint64(64 - BITS) == 0) + SEEN
    marked = marked[marked < n]
    if len(marked):
        # A mark soon after another one is none; nothing ends inside a character.
        marked = marked[np.append(True, np.diff(marked) >= LEAST)]
        letters = np.frombuffer(data, dtype=np.uint8)
        marked = marked[letters[marked] & 0xC0 != 0x80]
    return np.append(marked, n)


class ChunkEncoder:
    """Ids of whole texts from chunks met before and repaired joins."""

    def __init__(self, model: ByteBpe):
        self.model = model
        self.store = Ragged()
        self.chunks: dict[bytes, tuple[str, int, str]] = {}
        self.met = self.encoded = 0

    def _core(self, chunk: bytes) -> tuple[str, str, str] | None:
        """The chunk before its first safe place, between that and the last, and after the last."""
        text = chunk.decode()
        first = SAFE_CUT.search(text)
        if first is None:
            return None
        last = len(text)
        while True:
            last = text.rindex(" ", 0, last)
            if 0 < last < len(text) - 1 and not text[last - 1].isspace() and not text[last + 1].isspace():
                break
        return text[: first.start()], text[first.start() : last], text[last:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of each text."""
        if len(self.chunks) > REMEMBERED_CHUNKS or self.store.used > REMEMBERED_IDS:
            self.chunks.clear()
            self.store.clear()
        cut: list[list[bytes]] = []
        for text in texts:
            data = text.encode()
            ends = chunk_ends(data).tolist()
            cut.append([data[a:b] for a, b in zip([0, *ends], ends)])
        new = list({c for chunks in cut for c in chunks} - self.chunks.keys())
        parts = [self._core(chunk) for chunk in new]
        ids, sizes = self.model.encode_pieces([part[1] for part in parts if part])
        run = self.store.add(ids, sizes)
        for chunk, part in zip(new, parts):
            if part:
                self.chunks[chunk] = (part[0], run, part[2])
                run += 1
            else:
                self.chunks[chunk] = (chunk.decode(), -1, "")
        self.met += sum(map(len, cut))
        self.encoded += len(new)
        joins: list[str] = []
        runs: list[int] = []  # of chunks; joins count down from -1
        per_text = np.zeros(len(texts), dtype=np.int64)
        for i, chunks in enumerate(cut):
            before, window = len(runs), ""
            for chunk in chunks:
                head, run, tail = self.chunks[chunk]
                window += head
                if run >= 0:
                    joins.append(window)
                    runs += (-len(joins), run)
                    window = tail
            if window:
                joins.append(window)
                runs.append(-len(joins))
            per_text[i] = len(runs) - before
        again = Ragged()
        again.add(*self.model.encode_pieces(joins))
        order = np.array(runs, dtype=np.int64)
        both = Ragged()
        for store in (self.store, again):
            both.add(store.flat[: store.used], store.sizes[: store.runs])
        ids, sizes = both.take(np.where(order >= 0, order, self.store.runs - order - 1))
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(per_text)]
        return ids, np.diff(np.append(0, ends))


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(byte_bpe(path))
    return _ENCODERS[path]


def with_token_ids(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``: little-endian unsigned 32-bit ids of the whole text, as binary.

    ``path`` is a byte-level BPE file of the tokenizers library that every executor can open. A
    null text counts as empty and has no ids; ``token_ids`` is never null. All rows and other
    columns stay; a column named ``token_ids`` is replaced.
    """

    def make(texts: list[str | None]):
        ids, sizes = chunk_encoder(path).encode([t or "" for t in texts])
        return [_binary(ids.astype("<u4"), sizes * 4)]

    return append_columns(docs, [StructField("token_ids", BinaryType())], make, text)


def with_decoded(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``: the text of the ids, special tokens included; null ids give ""."""

    def make(column):
        flat, sizes = _runs(column.fill_null(b""))
        return [byte_bpe(path).decode(flat.view("<u4"), sizes // 4)]

    return append_columns(df, [StructField("decoded", StringType())], make, ids, raw=True)
