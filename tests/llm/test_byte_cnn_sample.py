import numpy as np
from pyspark.sql import functions as F

from hushlog.llm import byte_cnn


def test_each_label_gives_its_least_texts_once(spark, monkeypatch):
    """Many copies of few texts neither lose a label nor fill the sample."""
    monkeypatch.setattr(byte_cnn, "SAMPLE_TEXTS", 4)
    few = spark.range(3000).select(F.lit("one text and its copies").alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(90).select(F.concat(F.lit("t"), F.col("id") % 30).alias("text"), F.lit("bb").alias("lang"))
    taken = []
    monkeypatch.setattr(byte_cnn, "train", lambda windows, labels, names: taken.append((windows, labels, names)))
    byte_cnn.fit(few.unionByName(many))
    ((windows, labels, names),) = taken
    assert names == ["aa", "bb"] and np.bincount(labels).tolist() == [1, 4]
    texts = [w.tobytes().rstrip(b"\0").decode() for w in windows]
    hashed = many.select("text", F.xxhash64("text", F.lit("sample")).alias("h")).distinct().orderBy("h").limit(4)
    assert sorted(texts[1:]) == sorted(r.text for r in hashed.collect())
