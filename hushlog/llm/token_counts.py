"""Token counts by rank-synchronous merging of ragged symbol arrays.

The words of a batch that the worker has not met yet are held as one array of symbols. In each
round every word merges its best pair (all places of it at once), until no word has a pair left;
what survives are the tokens. Spaces only stand at the front of pieces, so words never merge with
each other.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from hushlog.llm.arrow import append_columns

SPACE = "▁"
NEVER = np.int64(1) << 40
#: Words a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 1 << 20
_SPACED = re.compile(" +[^ ]*")


class PieceMerger:
    """Merge rules of a sentencepiece BPE model with byte fallback, as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normal, spec = proto.normalizer_spec, proto.trainer_spec
        supported = (
            spec.model_type == spec.BPE
            and spec.byte_fallback
            and not spec.treat_whitespace_as_suffix
            and not normal.precompiled_charsmap
            and normal.add_dummy_prefix
            and normal.escape_whitespaces
            and not normal.remove_extra_whitespaces
        )
        pieces = {p.piece: p.score for p in proto.pieces if p.type == p.NORMAL}
        if not supported or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{path}: only plain BPE with byte fallback and leading spaces")
        # Characters that only occur inside longer pieces are symbols too, with no id of their own.
        inner = {c for p in pieces for c in p} - pieces.keys()
        self.names = [*pieces, *sorted(inner)]
        self.is_piece = np.array([name in pieces for name in self.names])
        ids = {name: i for i, name in enumerate(self.names)}
        # Equal scores are equal ranks: the leftmost place goes first among them.
        scores = np.array([-pieces[name] for name in pieces])
        rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.width = np.int64(len(self.names))
        pairs = {
            (ids[p[:k]], ids[p[k:]]): ids[p]
            for p in pieces
            for k in range(1, len(p))
            if p[:k] in ids and p[k:] in ids
        }
        keys = np.array([a * len(self.names) + b for a, b in pairs], dtype=np.int64)
        merged = np.array(list(pairs.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(merged[order], 0)
        self.rank = np.append(rank[merged[order]], NEVER)
        singles = [(ord(n), i) for n, i in ids.items() if len(n) == 1]
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for code, i in singles:
            self.symbol[code] = i
        self.space = ids[SPACE]
        #: pairs of neighbours inside pieces: between any other two characters nothing merges
        near = {(ids[p[i]], ids[p[i + 1]]) for p in pieces for i in range(len(p) - 1)}
        self.near = np.sort(
            np.array([a * len(self.names) + b for a, b in near], dtype=np.int64)
        )
        self.runs = {SPACE * k for k in range(2, 65) if SPACE * k in pieces}
        self.known: dict[str, int] = {}
        self.space_counts: dict[int, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in ``keys``; the last place for pairs that don't merge."""
        wanted = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), at, len(self.keys) - 1)

    def _merge(self, sym: np.ndarray, seq: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols and the sequence of each; ``seq`` ascends."""
        out_sym, out_seq, again = [], [], []
        start_sym, start_seq = sym, seq
        pair = np.full(len(sym), len(self.keys) - 1)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        pair[inside] = self._pairs(sym[inside], sym[inside + 1])
        while len(sym):
            rank = self.rank[pair]
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            per = np.repeat(best, sizes)
            live = per < NEVER
            if not live.all():
                out_sym.append(sym[~live])
                out_seq.append(seq[~live])
                sym, seq, pair, rank, per = sym[live], seq[live], pair[live], rank[live], per[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == per)
            new_run = np.append(True, (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]]))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            if single:
                at = at[np.append(True, seq[at[1:]] != seq[at[:-1]])]
            limit = per[at]
            sym = sym.copy()
            sym[at] = self.merged[pair[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, pair = sym[keep], seq[keep], pair[keep]
            at = place[at]
            touched = np.zeros(len(sym) + 1, dtype=bool)
            touched[at] = True
            touched[at - 1] = True  # the last place stands for "before the first"
            changed = np.flatnonzero(touched[:-1])
            end = np.append(seq[1:] != seq[:-1], True)[changed]
            following = np.minimum(changed + 1, len(sym) - 1)
            pair[changed] = np.where(
                end, len(self.keys) - 1, self._pairs(sym[changed], sym[following])
            )
            if not single:
                # One place after the other is the rule; all at once may differ only where a merge
                # makes a pair that is as good as itself and the word had several places.
                several = np.append(False, seq[at[1:]] == seq[at[:-1]])
                several |= np.append(several[1:], False)
                near = np.concatenate([at[several], np.maximum(at[several] - 1, 0)])
                early = self.rank[pair[near]] <= np.concatenate([limit[several]] * 2)
                wrong = np.unique(seq[near[early]])
                if len(wrong):
                    again.append(wrong)
                    left = ~np.isin(seq, wrong)
                    sym, seq, pair = sym[left], seq[left], pair[left]
        if again:
            redo = np.isin(start_seq, np.concatenate(again))
            slow_sym, slow_seq = self._merge(start_sym[redo], start_seq[redo], single=True)
            out_sym.append(slow_sym)
            out_seq.append(slow_seq)
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([*out_sym, empty]), np.concatenate([*out_seq, empty])

    def word_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word with one space before it, and whether that space stays a token."""
        n = len(words)
        codes = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
        word = np.repeat(np.arange(n), lengths)
        sym = self.symbol[codes].astype(np.int64)
        wanted = sym[:-1] * self.width + sym[1:]
        at = np.minimum(np.searchsorted(self.near, wanted), len(self.near) - 1)
        joined = (self.near[at] == wanted) & (sym[:-1] >= 0) & (sym[1:] >= 0)
        joined &= word[1:] == word[:-1]
        seq = np.cumsum(np.append(0, ~joined))
        first_code = np.append(0, np.flatnonzero(~joined) + 1)
        word_of_seq = word[first_code]
        head = np.zeros(len(first_code), dtype=bool)
        head[seq[np.cumsum(lengths) - lengths]] = True
        alone = np.flatnonzero(np.append(True, ~joined) & np.append(~joined, True))
        many = np.ones(len(sym), dtype=bool)
        many[alone] = False
        end_sym, end_seq = self._merge(sym[many], seq[many])
        end_sym, end_seq = np.append(end_sym, sym[alone]), np.append(end_seq, seq[alone])
        cost = np.ones(len(end_sym), dtype=np.int64)
        bytes_of = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        # No piece: one token for each byte. Such symbols are single characters that never merged.
        lone = end_sym < 0
        cost[lone] = bytes_of[first_code[end_seq[lone]]]
        inner = np.flatnonzero(~lone)
        odd = inner[~self.is_piece[end_sym[inner]]]
        for i in odd:
            cost[i] = len(self.names[end_sym[i]].encode())
        counts = np.bincount(word_of_seq[end_seq], weights=cost, minlength=n).astype(np.int64)
        bare = np.zeros(n, dtype=bool)
        heads = (end_sym == self.space) & head[end_seq]
        bare[word_of_seq[end_seq[heads]]] = True
        return counts, bare

    def spaces(self, n: int) -> int:
        """Tokens of ``n`` spaces in a row, where the leftmost pair always merges first."""
        if n not in self.space_counts:
            stack: list[int] = []
            for _ in range(n):
                stack.append(1)
                while len(stack) > 1 and SPACE * (stack[-2] + stack[-1]) in self.runs:
                    last = stack.pop()
                    stack[-1] += last
            self.space_counts[n] = len(stack)
        return self.space_counts[n]

    def count(self, texts: list[str | None]) -> np.ndarray:
        plain: list[list[str]] = []
        extra: list[list[int] | None] = []
        for text in texts:
            text = (text or "").replace(SPACE, " ")
            if not text:
                plain.append([])
                extra.append(None)
            elif text[0] != " " and text[-1] != " " and "  " not in text:
                plain.append(text.split(" "))
                extra.append(None)
            else:
                units = _SPACED.findall(" " + text)
                plain.append([unit.lstrip(" ") for unit in units])
                extra.append([len(unit) - len(word) - 1 for unit, word in zip(units, plain[-1])])
        known = self.known
        new = {word for words in plain for word in words if word not in known}
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = {word for words in plain for word in words}
            fresh = list(new)
            counts, bare = self.word_tokens(fresh)
            known.update(zip(fresh, (counts * 2 + bare).tolist()))
        totals = np.zeros(len(texts), dtype=np.int64)
        for i, (words, more) in enumerate(zip(plain, extra)):
            found = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            totals[i] = (found >> 1).sum()
            if more is not None:
                for value, n in zip(found.tolist(), more):
                    if n:
                        totals[i] += self.spaces(n + 1) - 1 if value & 1 else self.spaces(n)
        return totals


_MERGERS: dict[str, PieceMerger] = {}


def merger(path: str) -> PieceMerger:
    if path not in _MERGERS:
        _MERGERS[path] = PieceMerger(path)
    return _MERGERS[path]


def with_token_counts(
    docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model_path`` is a sentencepiece BPE model that every executor can open. A null or empty text
    has 0 bytes and 0 tokens. Columns of these names are replaced; every other column and every
    row, repeated ones too, stays. An empty table gives an empty table.
    """

    def make(texts: list[str | None]):
        n_bytes = np.array([len((t or "").encode()) for t in texts], dtype=np.int64)
        n_tokens = merger(model_path).count(texts)
        return n_bytes, n_tokens, n_tokens > limit

    fields = [
        StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()),
        StructField("over_limit", BooleanType()),
    ]
    return append_columns(docs, fields, make, text)
