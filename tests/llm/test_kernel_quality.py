import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SF_DIR, clashing, frame, odd_rows
from pyspark.sql import functions as F

from hushlog.llm import kernel_quality as kq
from hushlog.llm.queries import op13_kernel_quality


def brute(text):
    """Some of the statistics of one text, by loops."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [tuple(x.split()) for x in raw.split(b"\n") if x.split()]
    n = max(len(words), 1)
    letters = lambda w: [c for c in w if chr(c).isalpha() and c < 128 or c >= 128]
    share = lambda a, b: (a / max(b, 1)) ** 0.5
    return {
        "length": np.log1p(len(raw)) / 4,
        "words": np.log1p(len(words)) / 4,
        "word_length": np.log1p(sum(map(len, words)) / n),
        "upper": share(sum(65 <= c <= 90 for c in raw), len(raw)),
        "bars": share(raw.count(b"|"), len(raw)),
        "blanks": share(sum(c == 32 or 9 <= c <= 13 for c in raw), len(raw)),
        "high": share(sum(c >= 128 for c in raw), len(raw)),
        "lines": share(len(lines), len(words)),
        "distinct": share(len(set(words)), len(words)),
        "adjacent": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "no_letters": share(sum(not letters(w) for w in words), len(words)),
        "capitals": share(sum(sum(65 <= c <= 90 for c in w) >= 2 and not any(97 <= c <= 122 for c in w) for w in words), len(words)),
        "same_lines": share(len(lines) - len(set(lines)), len(lines)),
        "stopped": share(sum(w[-1:] in b".,;:?" for w in words), len(words)),
    }


def test_statistics(spark):
    rng = random.Random(3)
    alphabet = ["Ab", "AB", "x", "é", "|", "12", " ", " ", "\n", "\t", ".", "x x", "!"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [r[1] for r in odd_rows()] + ["", "\n \n", "a", " a"]
    got = kq.statistics(pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        for name, want in brute(text).items():
            assert row[kq.NAMES.index(name)] == pytest.approx(want * kq.STAT_PARTS, abs=0.51), (name, text[:50])
    part = pa.array(["zz", *texts], pa.string()).slice(1)
    assert (kq.statistics(part) == got).all()


def test_isotonic_is_the_closest_rising_function():
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=40) + np.arange(40) / 15, rng.integers(1, 9, 40).astype(float)
    x, v = kq.isotonic(np.arange(40.0), w, y)
    assert (np.diff(v) > 0).all() and len(x) == len(v)
    # min-max formula
    low = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
    fit = np.array([max(min(low(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)])
    assert np.allclose(np.unique(fit.round(9)), v.round(9))


def labelled(spark, n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(["the", "cat", "sat", "over", "there", "blue"]) for _ in range(rng.randrange(8, 60))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return frame(spark, rows, "doc_id long, text string, quality int")


def test_normal_equations_and_partitioning(spark):
    rows = kq.with_statistics(labelled(spark))
    data = rows.select("stats", F.col("quality").alias("label"))
    one, many = kq.fit(data.coalesce(1), features=32), kq.fit(data.repartition(7), features=32)
    assert (one.weights == many.weights).all() and (one.score == many.score).all()
    table = np.array([r.stats for r in data.collect()])
    labels = np.array([r.label for r in data.collect()], float)
    z = one.kernel.features(table) / kq.FEATURE_PARTS
    errors = []
    for ridge in kq.RIDGES:
        penalty = np.diag([ridge * len(z)] * 32 + [1e-9 * len(z)])
        errors.append(np.abs(np.linalg.solve(z.T @ z + penalty, z.T @ labels) - one.weights).max())
    assert min(errors) < 1e-6
    scored = kq.with_quality(rows, one).collect()
    assert all((r.score >= 0.7) == (r.quality == 1) for r in scored)


def test_kernel_is_approximated():
    rng = np.random.default_rng(2)
    d, width = len(kq.NAMES), 1.0
    kernel = kq.Kernel(np.zeros(d), np.ones(d), rng.standard_normal((d, 20_000)) / (width * d**0.5), rng.uniform(0, 2 * np.pi, 20_000))
    x = (rng.normal(size=(6, d)) * kq.STAT_PARTS).astype(int)
    z = kernel.features(x)[:, :-1] / kq.FEATURE_PARTS
    apart = ((x[:, None] - x[None]) / kq.STAT_PARTS) ** 2
    assert np.allclose(2 * z @ z.T / 20_000, np.exp(-apart.sum(axis=2) / (2 * d * width**2)), atol=0.03)


def test_odd_rows_and_clashes(spark):
    model = kq.fit(kq.with_statistics(labelled(spark)).selectExpr("stats", "quality AS label"), features=16)
    docs = clashing(frame(spark, odd_rows()), "score", "stats")
    done = kq.with_quality(kq.with_statistics(docs), model)
    rows = done.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text == "the cat sat on the mat"}) == 1
    assert kq.with_quality(kq.with_statistics(docs.limit(0)), model).count() == 0


def test_without_labels_or_with_one(spark):
    rows = kq.with_statistics(labelled(spark, 30))
    none = kq.fit(rows.selectExpr("stats", "CAST(NULL AS INT) AS label"), features=8)
    assert {r.score for r in kq.with_quality(rows, none).collect()} == {0.5}
    one = kq.fit(rows.selectExpr("stats", "1 AS label"), features=8)
    assert all(r.score == pytest.approx(1.0, abs=1e-3) for r in kq.with_quality(rows, one).collect())


def test_held_out_accuracy(spark):
    sf_dir = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = op13_kernel_quality(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 60
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
