"""Quality scores: ridge regression on random Fourier features, with isotonic calibration.

Every text is reduced to a few statistics of its characters, words and lines. Cosines of random
projections of them approximate a Gaussian kernel, so a linear model on these features is a kernel
model whose size doesn't grow with the data. Its normal equations are sums over rows: each task adds
up its own, and what the driver gets is one matrix for each fold, whatever the number of rows.

Features are whole numbers, so all sums are exact and a retried task or another partitioning gives
the same model. Equal texts are in the same fold. Each labelled row is scored by the model of the
other folds, and isotonic regression on these scores, counted in bins, turns them into shares of
label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from hushlog.functions.checkpoints import forget, stored
from hushlog.llm.arrow import append_columns, without

FOLDS = 5
#: Random features; the model has one weight for each and one more.
FEATURES = 256
#: Width of the kernel, for each square root of a statistic.
WIDTH = 0.8
#: Candidates for the ridge; the one with the least error on left-out folds is taken.
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
#: Statistics, features and labels are whole numbers of such parts.
STAT_PARTS, FEATURE_PARTS, LABEL_PARTS = 1 << 12, 1 << 10, 1 << 10
#: Statistics count up to so many standard deviations.
FAR = 4.0
#: Bins of raw scores, from -0.5 to 1.5, for the calibration.
BINS = 2048

#: Classes of bytes.
OTHER, UPPER, LOWER, DIGIT, BLANK, LINE, SYMBOL, BAR, SHOUT, STOP, HIGH = range(11)
CLASSES = 11


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for first, last, kind in (("A", "Z", UPPER), ("a", "z", LOWER), ("0", "9", DIGIT)):
        table[ord(first) : ord(last) + 1] = kind
    table[[9, 11, 12, 13, 32]] = BLANK
    table[10] = LINE
    table[list(b"#$%&*<>@^~=+_{}[]\\/")] = SYMBOL
    table[ord("|")] = BAR
    table[ord("!")] = SHOUT
    table[list(b".,;:?")] = STOP
    table[128:] = HIGH
    return table


CLASS = _class_table()
_rng = np.random.default_rng(20)
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

NAMES = (
    "length", "words", "word_length", "word_spread", "upper", "lower", "digits", "symbols", "bars",
    "shouts", "stops", "blanks", "high", "lines", "distinct", "adjacent", "no_letters", "marked",
    "capitals", "same_lines", "odd_lines", "short_words", "long_words", "stopped",
)


def _total(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _distinct(key: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys of each owner."""
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    new = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))[: len(k)]
    return np.bincount(o[new], minlength=n)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.sqrt(part / np.maximum(whole, 1))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text, in ``STAT_PARTS``; null is as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + n + 1]
    d = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    kind = CLASS[d]
    count = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    blank = (kind == BLANK) | (kind == LINE)
    edge = np.zeros(len(d) + 1, bool)
    edge[at[:-1][size > 0] - at[0]] = True
    before = np.append(True, blank[:-1])[: len(d)] | edge[:-1]
    start = np.flatnonzero(~blank & before)
    word_owner = owner[start]
    words = np.bincount(word_owner, minlength=n).astype(float)
    if len(start):
        solid = (~blank).astype(np.int64)
        add = lambda mask: np.add.reduceat(mask.astype(np.int64), start)
        length = add(solid)
        # a word's blanks count towards it, but hold nothing that is summed below
        upper, lower, high = add(kind == UPPER), add(kind == LOWER), add(kind == HIGH)
        odd = add((kind == SYMBOL) | (kind == BAR))
        spot = np.arange(len(d)) - np.repeat(np.append(0, start[1:]), np.diff(np.append(np.append(0, start[1:]), len(d))))
        hashed = np.add.reduceat(np.where(blank, np.uint64(0), VALUE[d] * POWER[spot & 1023]), start)
        line_no = np.cumsum(kind == LINE)[start]
        same = np.append(False, (hashed[1:] == hashed[:-1]) & (word_owner[1:] == word_owner[:-1]))
        capitals = (upper >= 2) & (lower == 0)
        no_letters = upper + lower + high == 0
        ends = start + length - 1
        stopped = kind[ends] == STOP
        new = np.append(True, (line_no[1:] != line_no[:-1]) | (word_owner[1:] != word_owner[:-1]))
        first = np.flatnonzero(new)
        in_line = np.diff(np.append(first, len(start)))
        place = np.arange(len(start)) - np.repeat(first, in_line)
        line_hash = np.add.reduceat(hashed * POWER[place & 1023], first)
        line_owner = word_owner[first]
        strange = np.add.reduceat((capitals | no_letters | (odd > 0) | same).astype(np.int64), first)
        lines = np.bincount(line_owner, minlength=n).astype(float)
        of_words = {
            "word_length": _total(length, word_owner, n),
            "squares": _total(length.astype(float) ** 2, word_owner, n),
            "distinct": _distinct(hashed, word_owner, n),
            "adjacent": _total(same, word_owner, n),
            "no_letters": _total(no_letters, word_owner, n),
            "marked": _total(odd > 0, word_owner, n),
            "capitals": _total(capitals, word_owner, n),
            "short_words": _total(length <= 2, word_owner, n),
            "long_words": _total(length > 14, word_owner, n),
            "stopped": _total(stopped, word_owner, n),
            "distinct_lines": _distinct(line_hash, line_owner, n),
            "odd_lines": _total(np.where(2 * strange > in_line, in_line, 0), line_owner, n),
        }
    else:
        lines = np.zeros(n)
        of_words = dict.fromkeys(
            ("word_length", "squares", "distinct", "adjacent", "no_letters", "marked", "capitals", "short_words", "long_words", "stopped", "distinct_lines", "odd_lines"),
            np.zeros(n),
        )
    mean = of_words["word_length"] / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(of_words["squares"] / np.maximum(words, 1) - mean**2, 0))
    of_bytes = lambda *kinds: _share(sum(count[:, k] for k in kinds), size)
    columns = {
        "length": np.log1p(size) / 4,
        "words": np.log1p(words) / 4,
        "word_length": np.log1p(mean),
        "word_spread": np.log1p(spread),
        "upper": of_bytes(UPPER),
        "lower": of_bytes(LOWER),
        "digits": of_bytes(DIGIT),
        "symbols": of_bytes(SYMBOL),
        "bars": of_bytes(BAR),
        "shouts": of_bytes(SHOUT),
        "stops": of_bytes(STOP),
        "blanks": of_bytes(BLANK, LINE),
        "high": of_bytes(HIGH),
        "lines": _share(lines, words),
        "distinct": _share(of_words["distinct"], words),
        "same_lines": _share(lines - of_words["distinct_lines"], lines),
    } | {
        name: _share(of_words[name], words)
        for name in ("adjacent", "no_letters", "marked", "capitals", "odd_lines", "short_words", "long_words", "stopped")
    }
    table = np.stack([columns[name] for name in NAMES], axis=1)
    return np.rint(table * STAT_PARTS).astype(np.int32)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``stats`` (whole text; in ``STAT_PARTS``), each text on its own."""
    field = StructField("stats", ArrayType(IntegerType()))

    def make(texts: pa.Array) -> list[pa.Array]:
        table = statistics(texts)
        offsets = np.arange(0, table.size + 1, len(NAMES), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.reshape(-1)))]

    return append_columns(docs, [field], make, text, raw=True)


def _table(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(NAMES))


@dataclass
class Kernel:
    """Random features of statistics: centre and scale, frequencies and phases."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Whole numbers (as floats); the last is one."""
        x = np.clip((stats / STAT_PARTS - self.mean) / self.scale, -FAR, FAR)
        wave = np.rint(np.cos(x @ self.frequency + self.phase) * FEATURE_PARTS)
        return np.hstack([wave, np.full((len(wave), 1), float(FEATURE_PARTS))])


@dataclass
class QualityModel:
    """Weights, and the calibrated score at raw scores in rising order."""

    kernel: Kernel
    weights: np.ndarray
    raw: np.ndarray
    score: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(stats), 0.5)
        return np.interp(raw_scores(self.kernel, stats, self.weights), self.raw, self.score)


def raw_scores(kernel: Kernel, stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return kernel.features(stats) @ weights / FEATURE_PARTS


def _kernel(rows: DataFrame, features: int, width: float, seed: int) -> Kernel:
    """Frequencies from a normal distribution; centre and scale from sums over ``rows``."""
    schema = "name int, n long, total long, squares long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(len(NAMES), np.int64), np.zeros(len(NAMES), np.int64)
        for batch in batches:
            x = _table(batch.column(0)).astype(np.int64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            columns = [np.arange(len(NAMES), dtype=np.int32), np.full(len(NAMES), n), total, squares]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "n", "total", "squares"])

    added = rows.select("stats").mapInArrow(sums, schema).groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "squares")]
    )
    found = {r.name: r for r in added.collect()}  # one row for each statistic
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for i, r in found.items():
        mean[i] = r.total / r.n / STAT_PARTS
        scale[i] = max(r.squares / r.n / STAT_PARTS**2 - mean[i] ** 2, 0.0) ** 0.5 or 1.0
    rng = np.random.default_rng(seed)
    frequency = rng.standard_normal((len(NAMES), features)) / (width * len(NAMES) ** 0.5)
    return Kernel(mean, scale, frequency, rng.uniform(0, 2 * np.pi, features))


def _normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """For each fold the products of the features with each other and the label (last), and rows.

    A task emits the rows of its own matrices; those with the same place are added one by one.
    """
    m = len(kernel.phase) + 2
    schema = "place int, row array<long>"
    names = ["place", "row"]

    def out(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for place, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([row], pa.list_(pa.int64()))], names=names)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, m, m), np.int64)
        for batch in batches:
            z = kernel.features(_table(batch.column(0)))
            z = np.hstack([z, batch.column(1).to_numpy()[:, None].astype(float)])
            fold = batch.column(2).to_numpy()
            for k in range(FOLDS):
                part = z[fold == k]
                total[k] += (part.T @ part).astype(np.int64)
        used = np.flatnonzero(total[:, m - 2, m - 2])
        yield from out({int(k * m + i): total[k, i] for k in used for i in range(m)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = row.values.to_numpy()
                sums[place] = sums[place] + values if place in sums else values.copy()
        yield from out(sums)

    partial = rows.select("stats", "label", "fold").mapInArrow(products, schema)
    whole = np.zeros((FOLDS * m, m))
    for r in partial.repartition("place").mapInArrow(added, schema).toLocalIterator():
        whole[r.place] = r.row
    whole = whole.reshape(FOLDS, m, m)
    parts = np.append(np.full(m - 1, float(FEATURE_PARTS)), float(LABEL_PARTS))
    return whole / (parts[:, None] * parts[None, :])


def _solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    a, b = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(b), ridge * a[-1, -1])
    penalty[-1] = 1e-9 * max(a[-1, -1], 1.0)  # the constant is free
    return np.linalg.solve(a + np.diag(penalty), b)


def _left_out(sums: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights without each fold, and the ridge with the least error on the folds left out."""
    whole, best = sums.sum(axis=0), None
    for ridge in RIDGES:
        weights = []
        error = 0.0
        for k in range(len(sums)):
            others = whole - sums[k]
            w = _solved(others if others[-2, -2] else whole, ridge)
            full = np.append(w, -1.0)
            error += full @ sums[k] @ full
            weights.append(w)
        if best is None or error < best[0]:
            best = (error, np.stack(weights, axis=1), ridge)
    return best[1], best[2]


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(x: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the rising function with the least squared error."""
    blocks: list[list[float]] = []
    for at, w, m in zip(x, weight, mean):
        blocks.append([w, m * w, at * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, seed: int = 20) -> QualityModel:
    """The model for ``rows`` with ``stats`` (as ``with_statistics`` gives them) and ``label`` (0 to 1).

    All rows count; null labels are left out. Without any row every score is 0.5. Runs jobs.
    """
    fold = F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")
    label = F.rint(F.col("label") * LABEL_PARTS).cast("long").alias("label")
    rows = stored(rows.where(F.col("label").isNotNull()).select("stats", label, fold), "labelled")
    kernel = _kernel(rows, features, width, seed)
    sums = _normal_equations(rows, kernel)
    whole = sums.sum(axis=0)
    if not whole[-2, -2]:
        return QualityModel(kernel, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    apart, ridge = _left_out(sums)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            raw = raw_scores(kernel, _table(batch.column(0)), apart)
            place = _bins(raw[np.arange(len(raw)), batch.column(2).to_numpy()])
            np.add.at(n, place, 1)
            np.add.at(total, place, batch.column(1).to_numpy())
        used = np.flatnonzero(n)
        columns = [pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used])]
        yield pa.RecordBatch.from_arrays(columns, names=["bin", "n", "total"])

    counts = rows.mapInArrow(binned, "bin int, n long, total long").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    found = sorted((r.bin, r.n, r.total) for r in counts.collect())  # at most BINS rows
    forget(rows)
    bins, n, total = (np.array(c, dtype=float) for c in zip(*found))
    raw, score = isotonic((bins + 0.5) / BINS * 2 - 0.5, n, total / n / LABEL_PARTS)
    return QualityModel(kernel, _solved(whole, ridge), raw, np.clip(score, 0, 1))


def with_quality(rows: DataFrame, model: QualityModel, keep_stats: bool = False) -> DataFrame:
    """``rows`` (with ``stats``) with ``score`` from 0 to 1, the likelihood of label 1.

    Rows are scored one by one: repeated rows and equal texts get equal scores, an empty text is
    scored as one, an empty table gives an empty table. A column ``score`` is replaced.
    """
    base = without(rows, ["score"])
    out = base if keep_stats else without(base, ["stats"])
    schema = StructType([*out.schema.fields, StructField("score", DoubleType())])
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(batch.schema.get_field_index("stats"))
                made = pa.array(model.scores(_table(column)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], names=schema.names)

    return base.mapInArrow(run, schema)
