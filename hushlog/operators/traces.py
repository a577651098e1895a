"""Stack traces as a table of frames, cleaned traces and frame roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlog.functions.text import strip_space
from hushlog.options import Options

# Package prefixes whose frames are plumbing.
FRAMEWORK_PACKAGES = (
    "java.lang.reflect",
    "jdk.internal.reflect",
    "sun.reflect",
    "net.neoforged.fml.event",
    "net.neoforged.bus",
    "net.minecraftforge.eventbus",
    "cpw.mods.modlauncher",
    "org.apache.logging.log4j",
)


#: From after "at " to the last opening parenthesis; then up to the last dot, twice.
CALL, OWNER, PACKAGE = "(?s)^at (.*)\\([^(]*\\)$", "(?s)^(.*)\\.[^.]*$", "(?s)^(.+)\\.[^.]*$"
#: A line break before the cause of what stands before it.
SEGMENT = "\n(?=[\\x00-\\x09\\x0B-\\x20]*(?:Caused by:|Suppressed:))"
CAUSE_FIRST = "^[\\x00-\\x09\\x0B-\\x20]*(?:Caused by:|Suppressed:)"


def frames(traces: DataFrame, opts: Options = Options()) -> DataFrame:
    """Explode ``(trace_id, text)`` into one row per line, with what becomes of it.

    A trace is one text value: what a line depends on is found in its row before it is taken apart,
    without a shuffle.
    """
    # newlines at the end are no lines of the trace
    body = F.regexp_replace(F.col("text"), "\n+\\z", "")
    segments = F.transform(F.split(body, SEGMENT, -1), lambda s: _parsed(F.split(s, "\n", -1), opts))
    sizes = F.transform(F.col("segments"), lambda s: F.size(s["rows"]))
    # the first frame past the depth limit ends the whole trace
    stop = F.lit(None).cast("int")
    if opts.max_depth > 0:
        stops = F.transform(
            F.col("segments"), lambda s, k: _lines_before(F.col("sizes"), k) + F.get(s["counted"], F.lit(opts.max_depth))
        )
        stop = F.array_min(stops)
    return (
        traces.filter(F.col("text") != "")
        .select(
            "trace_id",
            segments.alias("segments"),
            # a trace that begins with a cause has no lines before it
            body.rlike(CAUSE_FIRST).cast("long").alias("lead"),
        )
        .withColumn("sizes", sizes)
        .withColumn("stop", stop)
        .select("trace_id", "lead", "sizes", "stop", F.posexplode("segments").alias("k", "part"))
        .select(
            "trace_id",
            (F.col("lead") + F.col("k")).alias("segment"),
            _lines_before(F.col("sizes"), F.col("k")).alias("start"),
            "stop",
            F.posexplode("part.rows").alias("i", "row"),
        )
        .withColumn("pos", F.col("start") + F.col("i"))
        .select(
            "trace_id",
            "pos",
            "segment",
            "row.kind",
            "row.method",
            "row.package",
            "row.is_dup",
            "row.is_framework",
            "row.depth",
            (
                ~F.col("row.is_dup")
                & ~((F.col("row.kind") == "frame") & F.col("row.is_framework"))
                & F.coalesce(F.col("pos") < F.col("stop"), F.lit(True))
            ).alias("kept"),
            "row.line",
        )
    )


def _lines_before(sizes: Column, k: Column) -> Column:
    """Lines of the first ``k`` segments."""
    return F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda total, size: total + size)


def _is_unwanted(package: Column) -> Column:
    return reduce(lambda a, b: a | b, [package.startswith(p) for p in FRAMEWORK_PACKAGES])


def _parsed(lines: Column, opts: Options) -> Column:
    """Lines of one segment with all that is known of them, and the places of the frames that count."""

    def kind(x: Column) -> Column:
        trimmed = x["trimmed"]
        return (
            F.when(trimmed.startswith("Caused by:") | trimmed.startswith("Suppressed:"), "cause")
            .when(trimmed.startswith("... ") & trimmed.endswith(" more"), "more")
            .when(x["called"].contains("."), "frame")
            .otherwise("other")
        )

    def package(method: Column) -> Column:
        return F.regexp_extract(F.regexp_extract(method, OWNER, 1), PACKAGE, 1)

    def framework(x: Column) -> Column:
        return F.coalesce(_is_unwanted(x["package"]), F.lit(False)) if opts.drop_framework_frames else F.lit(False)

    # each step once: the next one reads it as an element of a list
    rows = F.transform(lines, lambda x: F.struct(x.alias("line"), strip_space(x).alias("trimmed")))
    rows = F.transform(rows, lambda x: _with(x, ["line", "trimmed"], called=_called(x["trimmed"])))
    rows = F.transform(rows, lambda x: _with(x, ["line", "called"], kind=kind(x)))
    rows = F.transform(rows, lambda x: _with(x, ["line", "kind"], method=F.when(x["kind"] == "frame", x["called"])))
    known = ["line", "kind", "method"]
    rows = F.transform(rows, lambda x: _with(x, known, package=package(x["method"])))
    known = [*known, "package"]
    rows = F.transform(rows, lambda x: _with(x, known, is_framework=framework(x)))
    known = [*known, "is_framework"]
    # what a frame counts as: nothing if it is unwanted
    named = F.transform(
        F.array(rows),
        lambda r: F.struct(r.alias("rows"), F.transform(r, lambda x: F.when(~x["is_framework"], x["method"])).alias("names")),
    )

    def repeated(s: Column) -> Column:
        # the first frame of each method, found in the list of all names
        return F.transform(
            s["rows"],
            lambda x, i: _with(
                x,
                known,
                counts=F.coalesce(F.array_position(s["names"], F.get(s["names"], i)) == i + 1, F.lit(False)),
                is_dup=F.coalesce(F.array_position(s["names"], F.get(s["names"], i)) != i + 1, F.lit(False)),
            ),
        )

    marked = F.transform(F.transform(named, repeated), _with_counted)
    known = [*known, "is_dup"]
    ranked = F.transform(
        marked,
        lambda s: F.struct(
            F.transform(
                s["rows"],
                lambda x, i: _with(
                    x, known, depth=F.when(x["counts"], F.array_position(s["counted"], i) - 1)
                ),
            ).alias("rows"),
            s["counted"].alias("counted"),
        ),
    )
    return F.get(ranked, F.lit(0))


def _with_counted(rows: Column) -> Column:
    places = F.transform(rows, lambda x, i: F.when(x["counts"], i))
    return F.struct(rows.alias("rows"), F.filter(places, lambda i: i.isNotNull()).alias("counted"))


def _with(row: Column, keep: list[str], **more: Column) -> Column:
    return F.struct(*(row[name].alias(name) for name in keep), *(value.alias(name) for name, value in more.items()))


def _called(trimmed: Column) -> Column:
    return F.when(trimmed.startswith("at ") & trimmed.endswith(")"), F.regexp_extract(trimmed, CALL, 1))


def _segment(lines: Column, opts: Options) -> Column:
    """Of the lines of one segment the kept ones, and the line that ends the trace, if there is one."""
    line = lambda x: F.struct(x.alias("line"), strip_space(x).alias("trimmed"))
    called = lambda x: F.struct(
        x["line"].alias("line"),
        F.when(
            x["trimmed"].startswith("at ") & x["trimmed"].endswith(")"),
            F.regexp_extract(x["trimmed"], CALL, 1),
        ).alias("method"),
    )

    def unwanted(method: Column) -> Column:
        package = F.regexp_extract(F.regexp_extract(method, OWNER, 1), PACKAGE, 1)
        return reduce(lambda a, b: a | b, [package.startswith(p) for p in FRAMEWORK_PACKAGES])

    frame = lambda x: F.coalesce(x["method"].contains("."), F.lit(False))
    named = lambda x: F.when(frame(x) & ~unwanted(x["method"]), x["method"])
    if not opts.drop_framework_frames:
        named = lambda x: F.when(frame(x), x["method"])
    parsed = F.transform(F.transform(lines, line), called)
    # what a frame counts as: nothing if it is unwanted
    rows = F.transform(parsed, lambda x: F.struct(x["line"].alias("line"), frame(x).alias("frame"), named(x).alias("name")))
    # the first frame of each method, found in the list of all names
    first = lambda r: F.transform(
        r,
        lambda x, i: F.struct(
            x["line"].alias("line"),
            F.coalesce(F.array_position(r["name"], x["name"]) == i + 1, F.lit(False)).alias("counts"),
            x["frame"].alias("frame"),
            i.alias("pos"),
        ),
    )
    kept = lambda r: F.filter(r, lambda x: x["counts"] | ~x["frame"])
    if opts.max_depth > 0:
        end = lambda r: F.get(F.filter(r, lambda x: x["counts"]), F.lit(opts.max_depth))
        until = lambda r: F.filter(kept(r), lambda x: F.coalesce(x["pos"] < end(r)["pos"], F.lit(True)))
    else:
        end = lambda r: F.lit(None).cast("struct<line:string>")
        until = kept
    # each step once: the next one reads it as the only element of a list
    done = F.transform(F.transform(F.array(rows), first), lambda r: F.struct(until(r)["line"].alias("kept"), end(r)["line"].alias("end")))
    return F.get(done, F.lit(0))


def cleaned(text: Column, opts: Options = Options()) -> Column:
    """``text`` of a trace with repeated and unwanted frames dropped, as one expression of its row.

    It needs no shuffle, so it works on streams as well. Null stays null.
    """
    if not opts.clean_traces:
        return text
    body = F.regexp_replace(text, "\n+\\z", "")
    parts = F.transform(F.split(body, SEGMENT, -1), lambda s: _segment(F.split(s, "\n", -1), opts))
    if opts.max_depth <= 0:
        return F.array_join(F.flatten(parts["kept"]), "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("end"))

    def joined(state: Column, part: Column) -> Column:
        whole = F.struct(F.concat(state["kept"], part["kept"]).alias("kept"), part["end"].alias("end"))
        return F.when(state["end"].isNull(), whole).otherwise(state)

    n_lines = F.size(F.split(body, "\n", -1))

    def finish(state: Column) -> Column:
        tail = F.concat(
            F.regexp_extract(state["end"], "(?s)^(.*?)at", 1),
            F.lit("... "),
            (n_lines - F.size(state["kept"])).cast("string"),
            F.lit(" more"),
        )
        lines = F.when(state["end"].isNull(), state["kept"]).otherwise(F.concat(state["kept"], F.array(tail)))
        return F.array_join(lines, "\n")

    return F.aggregate(parts, start, joined, finish)


def clean_traces(traces: DataFrame, opts: Options = Options()) -> DataFrame:
    """``(trace_id, text)`` with repeated and unwanted frames dropped; row by row."""
    return traces.select("trace_id", cleaned(F.col("text"), opts).alias("text"))


def hot_frames(traces: DataFrame, by: str = "method", opts: Options = Options()) -> DataFrame:
    """How often each method (or package) shows up, and in how many traces' kept lines."""
    return (
        frames(traces, opts)
        .filter(F.col("kind") == "frame")
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_frames"),
            F.count_if(F.col("kept")).alias("n_kept"),
        )
    )
