"""Small tables that every training-data operator has to cope with."""

from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    wide = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (wide - len(r)) for r in rows], schema)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} and" for i in range(60_000))
    return [
        (1, "the cat sat on the mat", "en", "a", 22),
        (1, "the cat sat on the mat", "en", "a", 22),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "a text without a number", None, "b", None),
        (None, None, None, None, None),
        (4, long_text, "en", "a", len(long_text)),
        (5, "the cat sat on the mat", "fr", "b", 22),
        (6, "日本語 テキスト 😀 x\x00y  \n\t z", "de", None, 5),
        (7, "   ", "de", "a", 3),
    ]


def clashing(df, *names):
    """``df`` with columns that have the names of an operator's results."""
    return df.select("*", *[F.lit("own").alias(n) for n in names])


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}
