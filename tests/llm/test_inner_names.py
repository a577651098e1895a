"""Columns of a table may have any name, those that an operator uses inside included."""

from collections import Counter

from fixtures import clashing, frame, odd_rows
from pyspark.sql import functions as F

from hushlog.llm.hilbert_shards import hashed, scaled, with_curve, with_shards
from hushlog.llm.license_scan import with_licenses

INNER = ["_d0", "_D1", "_part", "_i", "_before", "_rank", "_n", "n", "_x0", "_turn", "_scan", "_scan0", "_d_0"]


def test_shards_keep_columns_of_inner_names(spark):
    docs = clashing(frame(spark, odd_rows()), *INNER)
    got = with_shards(docs, [hashed(F.col("lang")), scaled(F.col("n_chars"))], ["doc_id"], 3)
    assert got.columns == [*docs.columns, "curve", "shard", "slot"]
    rows = got.collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [3, 3, 4]
    assert all(r[name] == "own" for r in rows for name in INNER)


def test_curve_keeps_columns_of_inner_names(spark):
    cells = spark.createDataFrame([(0, 1, 7), (3, 2, 8)], "_x0 int, _x1 int, _turn int")
    plain = cells.toDF("a", "b", "c")
    got, want = with_curve(cells, ["_x0", "_x1"], 2), with_curve(plain, ["a", "b"], 2)
    assert got.columns == ["_x0", "_x1", "_turn", "curve"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_licences_keep_columns_of_inner_names(spark):
    docs = clashing(frame(spark, [*odd_rows(), (9, "The MIT License", "en", "a", 15)]), *INNER, "Base")
    got = with_licenses(docs)
    assert got.columns == [*docs.columns[:-1], "n_words", "base", "licenses"]
    rows = got.collect()
    assert len(rows) == 11 and all(r[name] == "own" for r in rows for name in INNER)
    assert [len(r.base) for r in rows if r.doc_id == 9] == [1]
    assert with_licenses(docs.limit(0)).collect() == []
