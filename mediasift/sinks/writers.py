"""Sinks (K1-K4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.logs import format_log


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """K4: parquet; only the partitions that have new rows are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_log(entries: DataFrame, path: str, minimum: str = "INFO") -> None:
    """K3: redacted log lines in a folder per day. A run replaces the days it has, so it may be run again."""
    lines = format_log(entries, minimum).select("log_date", "line")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").text(path)


def log_batches(path: str, minimum: str = "INFO") -> Callable[[DataFrame, int], None]:
    """K3 for streams: a ``foreachBatch`` function. A batch run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        lines = format_log(batch, minimum).select("log_date", "line")
        lines.write.mode("overwrite").partitionBy("log_date").text(f"{path}/batch={number}")

    return write


def write_report(lines: DataFrame, path: str) -> None:
    """K1, K2: the lines of a report in order.

    The sort is by range, so the part files in name order are the document,
    however long it is.
    """
    order = [c for c in ("section", "part", "item", "line_no") if c in lines.columns]
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
