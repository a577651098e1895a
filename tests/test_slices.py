"""Logs written in slices of time, and rows that wait in a state."""

import os

import pandas as pd
from pyspark.sql import functions as F

from hushlog.plans import views
from hushlog.streaming.run import new_folder
from hushlog.streaming.waiting import as_bytes, gathered, parted, pieces, schema_of


def test_many_rows_make_more_slices_in_order_of_time(spark, monkeypatch):
    monkeypatch.setattr(views, "SLICE_ROWS", 50)
    # 40 rows without a time belong to no slice
    times = F.when(F.col("id") < 400, F.col("id") * 7919 % 400)
    events = spark.range(440).select(F.col("id").alias("seq"), times.alias("event_ms")).repartition(5)
    folder = new_folder(spark, "slices") + "/rows"
    views.written_in_slices(events, folder, 3)
    views.written_in_slices(events.filter("event_ms < 9"), folder, 1)
    files = [f"{folder}/{name}" for name in os.listdir(folder) if name.endswith(".parquet")]
    files.sort(key=os.path.getmtime)
    assert len({os.path.getmtime(name) for name in files}) == len(files) == 10
    got = [sorted(r.event_ms for r in spark.read.parquet(name).collect()) for name in files]
    assert sum(got[:-1], []) == list(range(400)) and got[-1] == list(range(9))


def test_rows_wait_as_bytes():
    schema = schema_of({"source": "string", "seq": "long", "event_ms": "long", "opens": "boolean"})
    rows = pd.DataFrame(
        {"source": ["b", None, "a", "a"], "seq": [1.0, None, 2, 1], "event_ms": [5, 9, 5, 5], "opens": [True, None, False, True]}
    )
    held = as_bytes(gathered(None, [rows[:2], rows[2:]], schema))
    ready, waiting = parted(gathered(held, [rows[:0]], schema), 8, ["event_ms", "source", "seq"])
    (piece,) = pieces(ready)
    assert [tuple(r) for r in piece.itertuples(index=False)] == [("a", 1, 5, True), ("a", 2, 5, False), ("b", 1, 5, True)]
    assert waiting.to_pylist() == [{"source": None, "seq": None, "event_ms": 9, "opens": None}]
    assert as_bytes(waiting.slice(0, 0)) is None and len(gathered(None, [], schema)) == 0
