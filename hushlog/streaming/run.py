"""Run a stream over everything that is there, then drain it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushlog.functions.checkpoints import shared_folder

# Longest wait between two looks at a running query; it remembers its last hundred steps.
LOOK_SECONDS = 1


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def wait_for(query: StreamingQuery, steps: list[dict] | None = None) -> None:
    """Wait until ``query`` ends; its steps' progress, each step once, is added to ``steps``."""
    seen, ended = set(), False
    while not ended:
        ended = query.awaitTermination(LOOK_SECONDS)
        if steps is None:
            continue
        for progress in query.recentProgress:
            place = progress["batchId"], progress["timestamp"]
            if place not in seen:
                seen.add(place)
                steps.append(progress)


def late_rows(steps: list[dict]) -> int:
    """Rows that came behind the watermark of a stateful step and were dropped there.

    An aggregate combines rows before its state sees them and counts what it combined.
    """
    return sum(op["numRowsDroppedByWatermark"] for step in steps for op in step["stateOperators"])


def state_rows(steps: list[dict]) -> list[int]:
    """Rows of state after each step, of all its stateful operators."""
    return [sum(op["numRowsTotal"] for op in step["stateOperators"]) for step in steps]


def run_to_end(
    spark: SparkSession,
    rows: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    name: str,
    far_ms: int = 7_258_118_400_000,
    steps: list[dict] | None = None,
) -> DataFrame:
    """Result of ``build`` over a finite stream of rows with ``event_ts`` and ``event_ms``.

    What is there is processed first; then one row far in the future, in a second input of its
    own, moves the watermark so that everything before it comes out.  That row itself never does.
    The result is a table in the shared folder.  ``steps`` takes the progress of every step, for
    :func:`late_rows` and :func:`state_rows`.
    """
    folder = new_folder(spark, name)
    end_rows, result = f"{folder}/end", f"{folder}/result"
    spark.createDataFrame([], rows.schema).write.parquet(end_rows)
    ends = spark.readStream.schema(rows.schema).parquet(end_rows)

    def run() -> None:
        query = (
            build(rows.unionByName(ends))
            .writeStream.format("parquet")
            .option("path", result)
            .option("checkpointLocation", f"{folder}/progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        wait_for(query, steps)

    run()
    spark.range(1).select(
        [
            {
                "event_ms": F.lit(far_ms),
                "event_ts": F.timestamp_millis(F.lit(far_ms)),
            }
            .get(field.name, F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in rows.schema.fields
        ]
    ).write.mode("append").parquet(end_rows)
    run()
    return spark.read.parquet(result)
