"""Row-wise detectors on arriving files, unchanged, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lintlake.operators.rules_line import line_rules
from lintlake.schema import FILES


def detect_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    detector: Callable[[DataFrame], DataFrame] = line_rules,
) -> StreamingQuery:
    """Append the findings of every new Parquet file of ``(repo, path, ext, content)`` rows.

    Line and file rules look at one row at a time, so they need no state. Processes
    what has arrived and stops; a schedule or a longer trigger keeps it going.
    """
    files = spark.readStream.schema(FILES).parquet(source)
    return (
        detector(files)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
