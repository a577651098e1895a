"""Text helpers with the trimming, splitting and formatting rules the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's trim() drops blanks only; every character up to U+0020 counts as white space here.
_EDGE_SPACE = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def fill_placeholders(template: Column, params: Column) -> Column:
    """Replace each ``{}`` by the next parameter; surplus on either side is left alone.

    A null parameter prints ``null``, substituted text is not scanned again.
    """
    parts = F.split(template, "\\{\\}", -1)
    given = F.coalesce(F.size(params), F.lit(0))

    def with_filler(part: Column, i: Column) -> Column:
        filler = (
            F.when(i == F.size(parts) - 1, F.lit(""))
            .when(i < given, F.coalesce(F.get(params, i), F.lit("null")))
            .otherwise(F.lit("{}"))
        )
        return F.concat(part, filler)

    filled = F.array_join(F.transform(parts, with_filler), "")
    return F.when(template.isNull(), F.lit("")).otherwise(filled)


def suppressed_suffix(n: Column, duration_ms: Column) -> Column:
    """`` [suppressed <n-1> times over <seconds>s]``, one decimal rounded half up."""
    tenths = F.floor((duration_ms + 50) / 100).cast("long")
    whole = F.floor(tenths / 10).cast("long")
    return F.concat(
        F.lit(" [suppressed "),
        (n - 1).cast("string"),
        F.lit(" times over "),
        whole.cast("string"),
        F.lit("."),
        (tenths - whole * 10).cast("string"),
        F.lit("s]"),
    )


def shorten(text: Column, limit: int) -> Column:
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(F.coalesce(text, F.lit("")))
