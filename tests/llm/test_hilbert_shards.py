import zlib
from collections import Counter

import pytest
from fixtures import SF_DIR, clashing, frame, odd_rows
from pyspark.sql import functions as F

from hushlog.llm.hilbert_shards import hashed, scaled, with_curve, with_shards, write_shards
from hushlog.llm.queries import op5_hilbert_shards


@pytest.mark.parametrize(("n_dims", "bits"), [(2, 4), (3, 3)])
def test_curve_takes_every_cell_once_in_single_steps(spark, n_dims, bits):
    cells = spark.range(1 << n_dims * bits).select(
        *[(F.shiftright("id", bits * d) % (1 << bits)).cast("int").alias(f"d{d}") for d in range(n_dims)]
    )
    names = cells.columns
    rows = with_curve(cells, names, bits).orderBy("curve").collect()
    assert [r.curve for r in rows] == list(range(1 << n_dims * bits))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_query_as_sorted_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = op5_hilbert_shards(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    own = {d.doc_id: (len(d.text.encode()) + 8, zlib.crc32(d.text.encode())) for d in docs}
    assert all((r["size"], r.text_crc32) == own[r.doc_id] for r in rows)
    ordered = sorted(rows, key=lambda r: (r.curve, r.text_crc32, r["size"], r.doc_id))
    n = len(rows)
    cuts = [s * n // 24 for s in range(25)]
    want = [(s, i - cuts[s]) for s in range(24) for i in range(cuts[s], cuts[s + 1])]
    assert [(r.shard, r.slot) for r in ordered] == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    counts = Counter(r.shard for r in rows).values()
    assert max(counts) - min(counts) <= 1


def test_one_crowded_cell_is_cut_as_well(spark):
    rows = spark.range(5000).select("id", F.lit("a").alias("source"), F.lit(100).alias("size"))
    got = with_shards(rows, [hashed(F.col("source")), scaled(F.col("size"))], ["id"], 7).collect()
    ordered = sorted(got, key=lambda r: r.id)
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in got)
    assert sorted(Counter(r.shard for r in got).values()) == [714] * 5 + [715] * 2
    with pytest.raises(ValueError):
        with_shards(rows, [F.lit(1)] * 4, ["id"], 7)


def test_odd_rows_and_files(spark, tmp_path):
    docs = clashing(frame(spark, odd_rows()), "shard", "Slot", "curve")
    dims = [hashed(F.col("source")), hashed(F.col("lang")), scaled(F.col("n_chars"))]
    got = with_shards(docs, dims, ["doc_id"], 3)
    rows = got.collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [3, 3, 4]
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(3 + (s == 2))) for s in range(3))
    write_shards(got, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(r.shard for r in back.collect()) == Counter(r.shard for r in rows)
    assert with_shards(docs.limit(0), dims, ["doc_id"], 3).collect() == []
    few = with_shards(docs.limit(2), dims, ["doc_id"], 24).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}
