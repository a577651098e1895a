"""Byte-level BPE with the results of the tokenizers library.

A space between two characters that are no white space always begins a new pre-token, whatever
stands around it. A text may be cut at such places, its pieces encoded apart and their ids put
together: the result is that of the whole text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# Fixed value: the pattern by which byte-level vocabularies of this kind split text.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Looking ahead only matters where white space follows white space.
PLAIN_WORDS, WHITE_RUN = WORDS.replace(r"\s+(?!\S)|", ""), re.compile(r"\s\s")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def valid_slots(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For runs that each fill the first ``sizes`` of ``room`` slots: which slots are filled."""
    lengths = np.stack([sizes, room - sizes], axis=1).reshape(-1)
    return np.repeat(np.tile([True, False], len(sizes)), lengths)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs that begin at ``starts``, run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Ragged:
    """Runs of ids, added in groups and taken out in any order."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.sizes = np.zeros(1 << 12, dtype=np.int64)
        self.runs = self.used = 0

    @staticmethod
    def _room(array: np.ndarray, need: int) -> np.ndarray:
        if need <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype)])

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first new run."""
        first, n, m = self.runs, len(sizes), len(ids)
        self.flat = self._room(self.flat, self.used + m)
        self.starts = self._room(self.starts, first + n)
        self.sizes = self._room(self.sizes, first + n)
        self.flat[self.used : self.used + m] = ids
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.runs, self.used = first + n, self.used + m
        return first

    def take(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[runs]
        return self.flat[spread(self.starts[runs], sizes)], sizes


def byte_letters() -> dict[str, int]:
    """Byte of each letter in which a byte-level vocabulary is written."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file, special strings included.

    Merges are run by tiktoken on the ranks that the file states, which takes a third of the time;
    texts that hold a special string, or that it can't take, go through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        if (
            spec["normalizer"]
            or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space")
            or not split.get("use_regex", True)
        ):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(" " in s for s in self.special):
            raise ValueError(f"{path}: added tokens with spaces")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        spelled = [b""] * self.library.get_vocab_size()
        for token, i in vocab.items():
            spelled[i] = bytes(letters[c] for c in token)
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        ranks = {word: i for i, word in enumerate(spelled) if word and i not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.engine, self.plain = (
            tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for pattern in (WORDS, PLAIN_WORDS)
        )
        for i, content in added.items():
            spelled[i] = content
        self.width = np.array([len(s) for s in spelled], dtype=np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.letters = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def ids_of(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                engine = self.engine if WHITE_RUN.search(text) else self.plain
                return engine.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError):  # a run too long for its regex
                pass
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of each text."""
        found = [self.ids_of(text) for text in texts]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), sizes

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for many short pieces: those between safe cuts share a call."""
        ready = [
            t[:1] == " " and not (t[1:2].isspace() or t[-1].isspace()) and not any(s in t for s in self.special)
            for t in texts
        ]
        order = np.array(ready, dtype=bool)
        alone, alone_sizes = self.encode([t for t, r in zip(texts, ready) if not r])
        joined = [t for t, r in zip(texts, ready) if r]
        runs, widths = Ragged(), np.zeros(len(texts), dtype=np.int64)
        ids = self.ids_of("".join(joined))
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in joined), np.int64, len(joined)))
        last = np.searchsorted(np.cumsum(self.width[ids]), ends)
        sizes = np.diff(np.append(-1, last))
        runs.add(alone, alone_sizes)
        runs.add(ids, sizes)
        widths[~order] = np.arange(len(alone_sizes))
        widths[order] = len(alone_sizes) + np.arange(len(sizes))
        return runs.take(widths)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        width = self.width[ids]
        spelled = self.letters[spread(self.begin[ids], width)].tobytes()
        ends = np.append(0, np.cumsum(width))[np.cumsum(sizes)].tolist()
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


_MODELS: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]
