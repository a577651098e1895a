"""Language identification with a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over a fixed-length window, each keeps its
largest value in the window, and a softmax layer gives the languages. The network is trained in
numpy on a bounded sample of labelled windows; whole texts are then read window by window, and a
text's languages are the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from hushlog.llm.arrow import append_columns

WINDOW = 256
#: Number of filters by width.
FILTERS = {2: 8, 3: 12, 4: 12}
WIDEST = max(FILTERS)
EMBEDDED = 8
#: The training sample: at most so many different texts of each language (the least by hash), at most
#: so many windows of each text, evenly spread over the whole of it.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 500, 4
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: Windows that go through the filters at once.
STEP = 64


def windows_of(data: bytes) -> np.ndarray:
    """Windows of a text, one row each, with the bytes that filters at its end look ahead to."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + WIDEST - 1, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + WIDEST - 1)
    return view[::WINDOW]


def some_windows(data: bytes) -> np.ndarray:
    """Up to ``SAMPLE_WINDOWS`` windows, evenly spread over the whole text."""
    every = windows_of(data)
    return every[np.unique(np.linspace(0, len(every) - 1, SAMPLE_WINDOWS).astype(int))]


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED; byte 0, the padding, stays 0
    filters: np.ndarray  # WIDEST * EMBEDDED x filters; narrow ones are 0 behind their width
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in each window, and where it is."""
        n = len(windows)
        embedded = self.embedding[windows].reshape(n, -1)
        seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDEST * EMBEDDED, axis=1)
        seen = np.ascontiguousarray(seen[:, ::EMBEDDED]).reshape(n * WINDOW, -1)
        values = (seen @ self.filters).reshape(n, WINDOW, -1)
        place = values.argmax(axis=1)
        return np.take_along_axis(values, place[:, None], axis=1)[:, 0] + self.bias, place

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.labels)), dtype=np.float32)
        for i in range(0, len(windows), STEP):
            some = windows[i : i + STEP]
            n = len(some)
            embedded = self.embedding[some].reshape(n, -1)
            seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDEST * EMBEDDED, axis=1)
            seen = np.ascontiguousarray(seen[:, ::EMBEDDED]).reshape(n * WINDOW, -1)
            largest = (seen @ self.filters).reshape(n, WINDOW, -1).max(axis=1) + self.bias
            out[i : i + STEP] = softmax(np.maximum(largest, 0) @ self.dense + self.offset)
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 7) -> Network:
    """Fit by Adam; each language weighs the same however many windows it has."""
    draw = np.random.default_rng(seed)
    n_filters = sum(FILTERS.values())
    wide = WIDEST * EMBEDDED
    mask = np.concatenate(
        [np.repeat((np.arange(wide) < w * EMBEDDED)[:, None], k, axis=1) for w, k in FILTERS.items()], axis=1
    ).astype(np.float32)
    small = lambda *shape, by: draw.normal(0, 1 / np.sqrt(by), shape).astype(np.float32)
    p = [
        small(256, EMBEDDED, by=4),
        small(wide, n_filters, by=wide) * mask,
        np.zeros(n_filters, np.float32),
        small(n_filters, len(names), by=n_filters),
        np.zeros(len(names), np.float32),
    ]
    p[0][0] = 0
    weight = 1 / np.bincount(labels, minlength=len(names)).clip(1)
    weight = (weight * len(labels) / len(names)).astype(np.float32)
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t, steps = 0, EPOCHS * -(-len(labels) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            some, want = windows[rows], labels[rows]
            net = Network(names, *p)
            largest, place = net.pooled(some)
            active = np.maximum(largest, 0)
            error = softmax(active @ p[3] + p[4])
            error[np.arange(len(rows)), want] -= 1
            error *= weight[want][:, None] / len(rows)
            back = (error @ p[3].T) * (largest > 0)
            # only the place of each maximum takes part
            near = np.take_along_axis(
                some[:, None, :], place[:, :, None] + np.arange(WIDEST)[None, None], axis=2
            )
            inputs = p[0][near].reshape(len(rows), n_filters, wide)
            to_inputs = back[:, :, None] * p[1].T[None]
            grad_embedding = np.zeros_like(p[0])
            np.add.at(grad_embedding, near.reshape(-1), to_inputs.reshape(-1, EMBEDDED))
            grad_embedding[0] = 0
            grads = [
                grad_embedding,
                np.einsum("bf,bfk->kf", back, inputs) * mask,
                back.sum(axis=0),
                active.T @ error,
                error.sum(axis=0),
            ]
            t += 1
            rate = RATE * (1 - 0.9 * t / steps)
            for a, g, m, v in zip(p, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(names, *p)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> Network:
    """A network for the labels of ``labelled``; rows without text or label are left out.

    Of each label the ``SAMPLE_TEXTS`` different texts with the least hashes are taken, and at most
    ``SAMPLE_WINDOWS`` windows of each. No row gives a network without labels.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label"))
    rows = rows.where("text IS NOT NULL AND label IS NOT NULL AND length(text) > 0")
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit("sample")))
    least = Window.partitionBy("label").orderBy("hash")
    chosen = (
        rows.select("label", "hash")
        .distinct()
        .withColumn("place", F.row_number().over(least))
        .where(F.col("place") <= SAMPLE_TEXTS)
        .drop("place")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of a task: no more than are chosen
        for batch in batches:
            out = []
            for one, name, spot in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, spot) not in seen:
                    seen.add((name, spot))
                    out.append((name, spot, some_windows(one.encode()).tobytes()))
            names, spots, windows = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(spots, pa.int64()), pa.array(windows, pa.binary())],
                ["label", "hash", "windows"],
            )

    sample = (
        rows.join(F.broadcast(chosen), ["label", "hash"])
        .select("text", "label", "hash")
        .mapInArrow(cut, "label string, hash long, windows binary")
        .groupBy("label", "hash")
        .agg(F.min("windows").alias("windows"))
        .collect()
    )
    # a label's name and number: as many rows as there are languages
    names = sorted({r.label for r in sample})
    if not names:
        empty = np.zeros((0, 0), np.float32)
        return Network([], empty, empty, empty, empty, empty)
    pairs = sorted(
        (r.label, window.tobytes())
        for r in sample
        for window in np.frombuffer(r.windows, dtype=np.uint8).reshape(-1, WINDOW + WIDEST - 1)
    )
    number = {name: k for k, name in enumerate(names)}
    windows = np.stack([np.frombuffer(window, dtype=np.uint8) for _, window in pairs])
    return train(windows, np.array([number[name] for name, _ in pairs]), names)


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 for a text that is null or has no letter."""
    known = [i for i, t in enumerate(texts) if net.labels and t and any(map(str.isalpha, t))]
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not known:
        return names, scores
    data = [texts[i].encode() for i in known]
    cut = [windows_of(d) for d in data]
    found = net.probabilities(np.concatenate(cut)).astype(np.float64)
    sizes = np.array([len(c) for c in cut])
    weight = np.full(int(sizes.sum()), float(WINDOW))
    lengths = np.array([len(d) for d in data])
    weight[np.cumsum(sizes) - 1] = lengths - (sizes - 1) * WINDOW
    sums = np.add.reduceat(found * weight[:, None], np.cumsum(sizes) - sizes, axis=0)
    shares = sums / lengths[:, None]
    for i, best, score in zip(known, shares.argmax(axis=1), shares.max(axis=1)):
        names[i], scores[i] = net.labels[best], min(1.0, float(score))
    return names, scores


def with_language(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    Rows and other columns stay; columns of these names are replaced. Equal texts get equal
    results.
    """
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return append_columns(docs, fields, lambda texts: predict(net, texts), text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Is the row kept out of training? Rows without an id are neither tested nor trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
