from pyspark.sql import functions as F

import __spark_entry__ as registry


def test_unrelated_long_messages_keep_their_own_bursts(spark, monkeypatch):
    texts = ["abcdefghij klmnop " * 14, "QRSTUVWXYZ qrstuv " * 14]
    rows = [
        ("structured", "a", 100 * k + i, 1000 + 100 * k + i, "l", "INFO", text)
        for k, text in enumerate(texts)
        for i in range(15)
    ]
    schema = "kind string, source string, seq long, event_ms long, logger string, level string, message string"
    events = spark.createDataFrame(rows, schema).withColumn("event_ts", F.timestamp_millis("event_ms"))
    monkeypatch.setattr(registry, "_all_sources", lambda *_: events)
    kept = registry.surviving_all_sources(spark, "").collect()
    assert sorted(r.message for r in kept) == sorted(r[-1] for r in rows)
