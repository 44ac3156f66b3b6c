"""Application logs (S6, A16, A17, W11 and the rows behind K3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as X
from .ordered import Carry, by_count, running

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
RETENTION_DAYS = 7
_LINE = r"^([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3})\s+(DEBUG|INFO|WARN|ERROR)\s+(\S+)\s*(.*)$"


def level_rank(level):
    return F.array_position(F.array(*[F.lit(name) for name in LEVELS]), level)


def log_columns(lines: DataFrame) -> DataFrame:
    """The parts of each line; a continuation line has only its text."""
    def part(group):
        return F.nullif(F.regexp_extract("line", _LINE, group), F.lit(""))

    day = F.regexp_extract("file", r"([0-9]{4}-[0-9]{2}-[0-9]{2})[^/\\]*$", 1).try_cast("date")
    return lines.withColumns(
        {
            "log_date": day,
            "at": part(1),
            "own_level": part(2),
            "source": part(3),
            "message": F.coalesce(part(4), F.when(part(2).isNull(), F.trim("line")), F.lit("")),
        }
    )


def parse_app_log(lines: DataFrame, position: str = "line_no", chunk: Column | None = None) -> DataFrame:
    """``file, line_no, line`` to parsed lines; a continuation takes the level above it.

    One file can be most of a fleet's log, so the level is carried in chunks of
    line numbers, or in the given chunks of another position.
    """
    parsed = running(
        log_columns(lines), ["file"], [position], by_count(position) if chunk is None else chunk,
        {"level": Carry("last", F.col("own_level")), "_source": Carry("last", F.col("source"))},
    )
    return parsed.withColumns(
        {
            "is_continuation": F.col("own_level").isNull(),
            "level": F.coalesce("level", F.lit("INFO")),
            "source": F.coalesce("source", "_source"),
        }
    ).drop("_source", "own_level")


def format_log(df: DataFrame, minimum: str = "INFO") -> DataFrame:
    """K3: redacted lines at or above a level, in the padded file format.

    ``df`` has ``ts, level, source, message``.
    """
    kept = df.filter(level_rank(F.col("level")) >= LEVELS.index(minimum) + 1)
    line = F.concat_ws(
        "  ",
        F.date_format("ts", "HH:mm:ss.SSS"),
        F.rpad("level", 5, " "),
        F.when(F.length("source") >= 18, F.col("source")).otherwise(F.rpad("source", 18, " ")),
        X.redact_text(F.col("message")),
    )
    return kept.select("*", F.to_date("ts").alias("log_date"), line.alias("line"))


def log_profile(parsed: DataFrame) -> DataFrame:
    """Lines per date, level and source. Continuation lines are not entries."""
    entries = parsed.filter(~F.col("is_continuation"))
    return entries.groupBy("log_date", "level", "source").agg(F.count("*").alias("lines"))


def job_warnings(parsed: DataFrame) -> DataFrame:
    """Warnings and errors per job, by the ``[job]`` mark that opens a message."""
    job = F.regexp_extract("message", r"^\[([^\]]+)\]", 1)
    rows = parsed.filter(F.col("level").isin("WARN", "ERROR") & ~F.col("is_continuation"))
    rows = rows.withColumn("job_id", job).filter(F.col("job_id") != "")
    return rows.groupBy("job_id").agg(
        F.count(F.when(F.col("level") == "WARN", 1)).alias("warnings"),
        F.count(F.when(F.col("level") == "ERROR", 1)).alias("errors"),
    )


def expired_logs(listing: DataFrame, now: dt.datetime, prefix: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Log files last written before the retention period. Other files are left alone."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    cutoff = F.lit(now - dt.timedelta(days=days))
    return listing.filter(name.startswith(prefix) & name.endswith(".log") & (F.col("modified") < cutoff))
