"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlog.operators.bursts import burst_table, decide, with_bursts
from hushlog.operators.cluster import cluster_templates
from hushlog.operators.output import (
    deduplicated,
    route_stats,
    suppression_stats,
    suppression_totals,
)
from hushlog.operators.reports import mark_reports, notices
from hushlog.operators.route import checked, route
from hushlog.operators.templates import (
    keyed,
    template_stats,
    with_label,
    with_template,
    with_threshold,
    with_window_class,
)
from hushlog.operators.traces import clean_traces, frames, hot_frames
from hushlog.options import Options
from hushlog.plans import views
from hushlog.plans.oracle import SQL
from hushlog.plans.suppression import decisions, quiet_log
from hushlog.sources.lines import assemble_messages, console_events, lines_of_text
from hushlog.sources.records import from_numeric_level, from_structured, union_sources
from hushlog.streaming.assemble import assemble_stream
from hushlog.streaming.run import late_rows, new_folder, run_to_end
from hushlog.streaming.survivors import surviving_stream
from hushlog.streaming.summary import burst_summary, stream_stats
from hushlog.streaming.suppress import suppress_stream

PLAIN = Options(fuzzy=False)
BY_COUNT = PLAIN.with_(report_by_time=False)
TEXT_ONLY = Options(
    normalize_coordinates=False,
    normalize_uuids=False,
    normalize_addresses=False,
    normalize_timings=False,
)
# long texts by their lengths alone, which SQL can follow on whole tables
BY_LENGTH = TEXT_ONLY.with_(long_text="length_only")
LINES = PLAIN.with_(block_rows=views.LINE_BLOCK)
KEYS = ["source", "seq", "logger", "level"]


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(views.log_events(spark, sf_dir), PLAIN)


def suppression_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: how much each template is logged and how much of it is noise."""
    totals = suppression_totals(
        _keyed_events(spark, sf_dir), "level", "leader_template", opts=PLAIN
    )
    return totals.withColumnRenamed("leader_template", "template").drop("rate_pct")


def structured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.table(spark, sf_dir, "events").selectExpr(
        "'events' AS source",
        "event_id AS seq",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS event_ms",
        "concat('svc.', CAST(user_id % 2 AS STRING)) AS logger",
        "'INFO' AS level",
        """CASE WHEN event_type = 'view' THEN 'user {} saw {} at 100%'
                WHEN event_type = 'error' THEN 'user {} failed'
                WHEN event_type = 'click' THEN 'user {} clicked {} {}' END AS pattern""",
        """array(CAST(user_id AS STRING),
                 CASE WHEN event_id % 3 > 0 THEN concat('{}', props) END) AS params""",
    )
    return from_structured(raw, "pattern", "params").select(*KEYS, "event_ms", "message")


def numeric_level_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.log_events(spark, sf_dir).withColumn("level_value", F.expr("seq * 37 % 1300"))
    return from_numeric_level(raw.drop("level")).select(*KEYS, "event_ms", "message")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return lines_of_text(documents, "text", "doc_id").withColumn("pos", F.col("pos").cast("long"))


def assembled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_messages(views.raw_lines(spark, sf_dir, in_blocks=True), LINES, block="block")


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console_events(assembled_messages(spark, sf_dir), "stderr")


def _all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.log_events(spark, sf_dir)
    numeric = events.withColumn("level_value", F.expr("seq * 37 % 1300")).drop("level")
    return union_sources(
        from_structured(events),
        from_numeric_level(numeric.withColumn("source", F.lit("numeric"))),
        _console(spark, sf_dir),
    )


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _all_sources(spark, sf_dir)
        .groupBy("kind", "logger", "level")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_ms").alias("first_ms"))
    )


ROUTING = PLAIN.with_(deny_loggers=("svc.1",), allow_loggers=("svc.0", "svc.1"))


def _mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with missing loggers, levels and texts, and the job's own notices among them."""
    return views.log_events(spark, sf_dir).selectExpr(
        "CASE WHEN seq % 13 = 0 THEN 'numeric' ELSE kind END AS kind",
        "source",
        "seq",
        "event_ms",
        """CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 17 = 0 THEN 'hushlog.notices'
                ELSE logger END AS logger""",
        "CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 19 = 0 THEN 'ALL' ELSE level END AS level",
        "CASE WHEN seq % 26 = 0 THEN '' ELSE message END AS message",
    )


def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route(_mixed_events(spark, sf_dir), ROUTING).select(*KEYS, "kind", "route")


def routed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_stats(route(_mixed_events(spark, sf_dir), ROUTING), "logger")


def list_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by lists that are tables: customers of one segment denied, those with credit allowed."""
    customers = views.table(spark, sf_dir, "customer").withColumn(
        "logger", F.concat(F.lit("user."), F.col("c_custkey").cast("string"))
    )
    routed = route(
        views.user_events(spark, sf_dir),
        PLAIN,
        deny=customers.filter("c_mktsegment = 'BUILDING'"),
        allow=customers.filter("c_acctbal > 0"),
    )
    return routed.select(*KEYS, "kind", "route")


def event_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label(with_template(views.log_events(spark, sf_dir))).select(
        "seq", "template", "label"
    )


def event_template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_stats(with_template(views.log_events(spark, sf_dir)))


def text_template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_stats(with_template(views.text_messages(spark, sf_dir), TEXT_ONLY))


def chat_top_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_stats(with_template(views.chat_messages(spark, sf_dir), TEXT_ONLY), top=25)


def template_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.text_messages(spark, sf_dir, ascii_only=True)
    return cluster_templates(template_stats(with_template(messages, TEXT_ONLY)), BY_LENGTH)


def window_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.text_messages(spark, sf_dir).select("source", "seq", "message")
    both = messages.unionByName(
        views.log_events(spark, sf_dir).select("source", "seq", "message")
    )
    return with_window_class(both).select("source", "seq", F.col("window_ms").cast("long"))


def level_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_threshold(_mixed_events(spark, sf_dir)).select(
        "seq", "level", F.col("threshold").cast("long")
    )


def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bursts(_keyed_events(spark, sf_dir), PLAIN).select(
        *KEYS, F.col("leader_template").alias("template"), "life_no", "burst_no", "n", "first_ms", "duration_ms"
    )


def idle_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of keys that are forgotten between two of them."""
    rows = keyed(views.shift_events(spark, sf_dir), PLAIN)
    return with_bursts(rows, PLAIN).select(
        *KEYS, F.col("leader_template").alias("template"), "life_no", "burst_no", "n", "first_ms", "duration_ms"
    )


def event_burst_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_table(_keyed_events(spark, sf_dir), PLAIN).withColumnRenamed(
        "leader_template", "template"
    )


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(with_bursts(_keyed_events(spark, sf_dir), PLAIN), PLAIN)


def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select(
        "seq", "n", F.col("threshold").cast("long"), "allowed"
    )


def count_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_reports(_decided(spark, sf_dir), BY_COUNT)
    return marked.filter("report").select(*KEYS, "n", "duration_ms")


def full_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_reports(_decided(spark, sf_dir), PLAIN)
    return marked.filter("report").select(*KEYS, "n", "duration_ms")


NOTICE = ["kind", "source", "seq", "event_ms", "logger", "level", "suppressed", "text"]


def event_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(mark_reports(_decided(spark, sf_dir), BY_COUNT), BY_COUNT).select(NOTICE)


def console_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(decisions(_console(spark, sf_dir), BY_COUNT), BY_COUNT).select(NOTICE)


def surviving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = BY_COUNT.with_(deny_loggers=("svc.1",))
    return quiet_log(views.log_events(spark, sf_dir), opts)


def surviving_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _console(spark, sf_dir)
    return deduplicated(decisions(events, BY_COUNT), route(events, BY_COUNT), BY_COUNT)


def surviving_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, near copies merged, full report rule."""
    return quiet_log(_all_sources(spark, sf_dir), Options())


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = assembled_messages(spark, sf_dir).filter(F.col("n_lines") > 1)
    trace_id = F.concat("source", F.lit("/"), F.col("seq").cast("string"))
    return messages.select(trace_id.alias("trace_id"), F.col("message").alias("text"))


def trace_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(_traces(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))
    return rows.drop("is_framework")


def cleaned_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_traces(_traces(spark, sf_dir))


def shortened_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_traces(_traces(spark, sf_dir), Options(max_depth=1))


def hot_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_frames(_traces(spark, sf_dir), "method")


def suppression_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppression_stats(_decided(spark, sf_dir), "level")


def suppression_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppression_totals(
        keyed(checked(route(_mixed_events(spark, sf_dir), ROUTING)), PLAIN), opts=PLAIN
    )


# the log spans a quarter of an hour: several steps decide, and the watermark moves between them
SLICES, DELAY = 4, "1 minute"
# the console lines span seconds to minutes
LINE_DELAY = "1 second"
# a slice for each minute of it
SHIFTS = 12


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream that takes one slice of time in each step."""
    folder = new_folder(spark, "events") + "/slices"
    events = views.log_events(spark, sf_dir)
    views.written_in_slices(events, folder, SLICES)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(_event_stream(spark, sf_dir), PLAIN)
    decided = run_to_end(spark, rows, lambda s: suppress_stream(s, PLAIN, DELAY), "decisions")
    return decided.select("seq", "n", "allowed", "report")


def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on keys whose state is dropped in one step and born again in a later one."""
    folder = new_folder(spark, "shifts") + "/slices"
    events = views.shift_events(spark, sf_dir)
    views.written_in_slices(events, folder, SHIFTS)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = keyed(stream, PLAIN)
    decided = run_to_end(spark, rows, lambda s: suppress_stream(s, PLAIN, "10 seconds"), "shifts")
    return decided.select("seq", "logger", "first_ms", "n", "allowed", "report")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions while a ninth of the first quarter's rows comes after all others, and how many those are."""
    folder = new_folder(spark, "late") + "/slices"
    events = views.log_events(spark, sf_dir)
    first, last = events.agg(F.min("event_ms"), F.max("event_ms")).first()
    early = F.col("event_ms") < (first or 0) + ((last or 0) - (first or 0)) // 4
    late = early & (F.col("seq") % 9 == 0)
    views.written_in_slices(events.filter(~late), folder, SLICES)
    views.written_in_slices(events.filter(late), folder, 1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    steps: list[dict] = []
    decided = run_to_end(
        spark, keyed(stream, PLAIN), lambda s: suppress_stream(s, PLAIN, DELAY), "late", steps=steps
    )
    return decided.select("seq", "n", "allowed", F.lit(late_rows(steps)).cast("long").alias("n_late"))


def stream_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving log, full report rule, appended step by step."""
    rows = _event_stream(spark, sf_dir)
    return run_to_end(spark, rows, lambda s: surviving_stream(s, PLAIN, DELAY), "survivors")


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bursts = run_to_end(
        spark,
        keyed(_event_stream(spark, sf_dir), PLAIN),
        lambda s: burst_summary(s, PLAIN, DELAY),
        "bursts",
    )
    return bursts.withColumnRenamed("leader_template", "template")


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages assembled over several steps: groups stay open from one slice of time to the next."""
    folder = new_folder(spark, "lines") + "/slices"
    lines = views.raw_lines(spark, sf_dir).withColumn("event_ts", F.timestamp_millis("event_ms"))
    views.written_in_slices(lines, folder, SLICES)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return run_to_end(
        spark, stream, lambda s: assemble_stream(s, PLAIN, LINE_DELAY), "messages"
    )


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "decided")
    decided = _decided(spark, sf_dir).select("event_ts", "event_ms", "level", "allowed")
    decided.write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return run_to_end(
        spark, stream, lambda s: stream_stats(s, "level", delay=DELAY), "totals"
    )


_QUERIES = [
    suppression_by_template,
    structured_events,
    numeric_level_events,
    text_lines,
    assembled_messages,
    all_sources,
    routed_events,
    routed_totals,
    list_routes,
    event_templates,
    event_template_stats,
    text_template_stats,
    chat_top_templates,
    template_leaders,
    window_classes,
    level_thresholds,
    event_bursts,
    idle_bursts,
    event_burst_table,
    event_decisions,
    count_reports,
    full_reports,
    event_notices,
    console_notices,
    surviving_events,
    surviving_console,
    surviving_all_sources,
    trace_frames,
    cleaned_traces,
    shortened_traces,
    hot_methods,
    suppression_by_level,
    suppression_overall,
    stream_decisions,
    stream_expiry,
    stream_late,
    stream_survivors,
    stream_bursts,
    stream_messages,
    stream_totals,
]


def _corpus_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators; none where that subpackage is not installed."""
    try:
        from hushlog.llm import queries as corpus
    except ModuleNotFoundError as missing:
        if missing.name not in ("hushlog.llm", "hushlog.llm.queries", "corpus_pipeline"):
            raise
        return {}, {}
    return corpus.QUERIES, corpus.SQL


def entry(spark: SparkSession) -> DataFrame:
    return suppression_by_template(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query by name."""
    return {query.__name__: query for query in _QUERIES} | _corpus_queries()[0]


def oracle_sql() -> dict[str, str]:
    """SQL with the same result, for the queries that SQL can express on whole tables."""
    return SQL | _corpus_queries()[1]
