"""Log views over ordinary tables: the inputs of the registered queries."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlog.schemas import STRUCTURED
from hushlog.sources.lines import lines_of_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(events: DataFrame) -> DataFrame:
    """Log records made from the events table, a month squeezed into twelve minutes.

    Works on a static or a streaming table.
    """
    ms = "unix_millis(CAST(ts AS TIMESTAMP)) div 3600"
    return events.selectExpr(
        f"'{STRUCTURED}' AS kind",
        "'events' AS source",
        "event_id AS seq",
        f"{ms} AS event_ms",
        "concat('svc.', CAST(user_id % 2 AS STRING)) AS logger",
        """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
             WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level""",
        """CASE event_type
             WHEN 'click' THEN concat('Chunk [', CAST(event_id % 32 AS STRING), ', -',
               CAST(user_id % 16 AS STRING), '] loaded in ', CAST(event_id % 500 AS STRING), 'ms')
             WHEN 'view' THEN concat('Object@', substr(md5(CAST(event_id AS STRING)), 1, 10),
               ' drawn at (', CAST(event_id % 100 AS STRING), '.5, 64.0, -',
               CAST(user_id % 50 AS STRING), '.25)')
             WHEN 'signup' THEN concat('Player ', substr(md5(CAST(user_id AS STRING)), 1, 8),
               '-0000-4000-8000-', substr(md5(CAST(event_id AS STRING)), 1, 12), ' joined')
             WHEN 'purchase' THEN
               concat('World save behind by ', CAST(event_id % 90 AS STRING), ' ticks')
             ELSE concat('Handler failed after ', CAST(event_id % 7000 AS STRING), 'ms')
           END AS message""",
    ).withColumn("event_ts", F.timestamp_millis("event_ms"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_messages(table(spark, sf_dir, "events"))


def shift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of services on duty every third minute, for two seconds: in between all keys are idle."""
    ms = "event_ms - event_ms % 60000 + (event_ms % 60000) div 30"
    shift = "concat('shift.', CAST((event_ms div 60000) % 3 AS STRING))"
    return (
        log_events(spark, sf_dir)
        .withColumns({"logger": F.expr(shift), "event_ms": F.expr(ms)})
        .withColumn("event_ts", F.timestamp_millis("event_ms"))
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a logger for each user; some rows have no logger or level."""
    return table(spark, sf_dir, "events").selectExpr(
        f"'{STRUCTURED}' AS kind",
        "'events' AS source",
        "event_id AS seq",
        "CASE WHEN event_id % 11 > 0 THEN concat('user.', CAST(user_id AS STRING)) END AS logger",
        "CASE WHEN event_id % 7 > 0 THEN 'INFO' END AS level",
        "event_type AS message",
    )


# Rows of a slice; a log with more is cut into more slices.
SLICE_ROWS = 4_000_000
# Slices are read by several tasks, one for each row group of about this size.
ROW_GROUP_BYTES = 4 << 20


def written_in_slices(events: DataFrame, folder: str, n: int) -> None:
    """Events in ``n`` files, one after the other as time goes on; in a multiple of ``n`` if they are many.

    The events are worked out once and written in parallel, a task for each slice. A file stream takes
    files by their times of change, so the files then get times in the order of their slices.
    """
    first, last, rows = events.agg(F.min("event_ms"), F.max("event_ms"), F.count("event_ms")).first()
    if first is None:
        events.write.mode("append").parquet(folder)
        return
    n *= -(-rows // (n * SLICE_ROWS))
    width = (last - first) // n + 1
    staged = f"{folder}-{uuid.uuid4().hex}"
    (
        events.filter(F.col("event_ms").isNotNull())
        .withColumn("slice", F.expr(f"CAST((event_ms - {first}L) div {width}L AS INT)"))
        .repartitionById(n, F.col("slice"))
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy("slice")
        .parquet(staged)
    )
    _moved_in_order(events.sparkSession, staged, folder)


def _moved_in_order(spark: SparkSession, staged: str, folder: str) -> None:
    """Move the files of ``staged/slice=…`` to ``folder``, each a second newer than the one before it."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target = path_of(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    newest = max([file.getModificationTime() for file in files.listStatus(target)], default=0)
    ms = max(int(time.time() * 1000), newest + 1000)
    slices = {
        int(status.getPath().getName().split("=")[1]): status.getPath()
        for status in files.listStatus(path_of(staged))
        if status.isDirectory()
    }
    for number in sorted(slices):
        for status in files.listStatus(slices[number]):
            moved = path_of(target, f"slice-{ms}-{status.getPath().getName()}")
            if not files.rename(status.getPath(), moved):
                raise OSError(f"cannot move {status.getPath()} to {folder}")
            files.setTimes(moved, ms, -1)
            ms += 1000
    files.delete(path_of(staged), True)


# Position of a console line: orders and their items share a source; SEQ_STEP leaves room for items
# with the same number, and a run of LINE_BLOCK positions holds some ten thousand orders.
SEQ_STEP = 4096
LINE_BLOCK = SEQ_STEP * 16 * 8192


def raw_lines(spark: SparkSession, sf_dir: str, in_blocks: bool = False) -> DataFrame:
    """Console lines made from orders (headers and plain lines) and their items (trace lines).

    With ``in_blocks`` they have a column ``block``, their run of ``LINE_BLOCK`` positions, and come
    partitioned by source and block.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "0 AS ord",
        """CASE o_orderstatus
             WHEN 'F' THEN concat('shop.OrderException: o', CAST(o_orderkey % 50 AS STRING))
             ELSE concat('order accepted in ', CAST(o_orderkey % 900 AS STRING), 'ms')
           END AS line""",
    )
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k",
        "l_linenumber AS ord",
        """CASE WHEN l_returnflag = 'R' AND l_linenumber = 4
                  THEN 'Caused by: shop.StepException: retry'
                WHEN l_linenumber = 7 THEN ''
                ELSE concat(chr(9), 'at shop.p', CAST(l_partkey % 3 AS STRING),
                  '.Step.run(Step.java:', CAST(l_linenumber AS STRING), ')') END AS line""",
    )
    lines = orders.unionByName(items).withColumn("source", F.expr("concat('host', CAST(k % 8 AS STRING))"))
    order = ["k", "ord"]
    if in_blocks:
        lines = lines.withColumn("block", F.expr(f"k div {LINE_BLOCK // SEQ_STEP // 16}"))
        lines = lines.repartition("source", "block")
        order = ["block", "source", *order]
    # items with the same order and number are few; equal lines may swap places unseen
    same = Window.partitionBy(*order).orderBy("line")
    return lines.withColumn("copy", F.row_number().over(same) - 1).selectExpr(
        "source",
        *(["block"] if in_blocks else []),
        f"(k * 16 + ord) * {SEQ_STEP} + copy AS seq",
        "1000 + k * 10 + ord AS event_ms",
        "line",
    )


def text_messages(spark: SparkSession, sf_dir: str, ascii_only: bool = False) -> DataFrame:
    """The lines of the documents as log messages.

    With ``ascii_only`` other characters become ``?``: SQL edit distances count bytes.
    """
    message = F.col("text_line")
    if ascii_only:
        message = F.regexp_replace(message, "[^\\x00-\\x7F]", "?")
    lines = lines_of_text(
        table(spark, sf_dir, "documents"), "text", "doc_id", "source", "lang", name="text_line"
    )
    return lines.select(
        F.col("source").alias("logger"),
        F.col("lang").alias("level"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"),
        F.col("pos").cast("long").alias("seq"),
        F.col("doc_id").alias("event_ms"),
        message.alias("message"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as log messages of their role."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "'chat' AS source",
        "conv_id * 1000 + turn AS seq",
        "conv_id * 1000 + turn AS event_ms",
        "role AS logger",
        "'INFO' AS level",
        "text AS message",
    )
