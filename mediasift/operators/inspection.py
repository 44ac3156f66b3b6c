"""Inspection output and mux progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import Carry, running
from .pinning import pin
from .variants import audit_lines

DURATION_TOLERANCE = 0.95
# What follows a label of the tool's report, up to the next blank or comma.
_DURATION = r"\bDuration:\s+([^\s,]+)"
_TIME = r"\btime=([^\s,]+)"
STREAM_KINDS = ("Video", "Audio", "Subtitle")


def _field_with(fields: Column, pattern: str) -> Column:
    """The first of a stream's fields that the pattern fits."""
    return F.get(F.filter(fields, lambda field: field.rlike(pattern)), F.lit(0))


def _leading_number(field: Column) -> Column:
    return F.regexp_extract(field, r"^(\d+)", 1).cast("int")


def parse_inspections(inspections: DataFrame) -> DataFrame:
    """``job_id, body`` to one row per stream. Embedded cover art is not a stream.

    A stream's line reads ``Stream #<place>: <kind>: <field>, <field>, ...``. It is taken apart at its separators: the
    first word of the first field is the codec; a size, a sample rate with the channels after it and a bit rate are known
    by their form.
    """
    lines = F.transform(F.split("body", "\n"), lambda line: F.split(F.trim(F.regexp_replace(line, r"\r$", "")), r":\s+", 3))
    lines = F.filter(
        lines,
        lambda p: (F.size(p) == 3) & F.get(p, F.lit(0)).startswith("Stream #") & F.get(p, F.lit(1)).isin(*STREAM_KINDS)
        & ~F.get(p, F.lit(2)).contains("(attached pic)"),
    )
    rows = inspections.select("job_id", F.posexplode(lines).alias("stream_no", "_line"))
    rows = pin(rows, {"type": F.lower(F.col("_line")[1]), "_fields": F.split(F.col("_line")[2], r",\s*")})
    fields = F.col("_fields")
    rows = pin(
        rows,
        {
            "codec": F.regexp_extract(F.get(fields, F.lit(0)), r"^\w+", 0),
            "_size": F.split(_field_with(fields, r"^\d{2,5}x\d{2,5}\b"), r"x|\s"),
            "_rate": F.array_position(F.transform(fields, lambda field: field.rlike(r"^\d+ Hz$")), F.lit(True)).cast("int"),
            "_speed": _field_with(fields, r"^\d+ kb/s"),
        },
    ).filter(F.col("codec") != "")
    is_video, is_audio = F.col("type") == "video", F.col("type") == "audio"
    channels = F.get(fields, F.col("_rate"))
    has_rate = is_audio & (F.col("_rate") > 0) & channels.isNotNull()
    return rows.select(
        "job_id", "stream_no", "type", "codec",
        F.when(is_video, F.get("_size", F.lit(0)).cast("int")).alias("width"),
        F.when(is_video, F.get("_size", F.lit(1)).cast("int")).alias("height"),
        F.when(has_rate, _leading_number(F.get(fields, F.col("_rate") - 1))).alias("sample_rate"),
        F.when(has_rate, channels).alias("channels"),
        F.when(is_video | is_audio, _leading_number(F.col("_speed"))).alias("kbps"),
    )


def inspection_reports(inspections: DataFrame, streams: DataFrame) -> DataFrame:
    """One row per file: first duration, first video and audio stream."""
    heads = inspections.select("job_id", X.clock_seconds(F.regexp_extract("body", _DURATION, 1)).alias("duration_seconds"))
    video, audio = F.col("type") == "video", F.col("type") == "audio"
    firsts = streams.groupBy("job_id").agg(
        F.count("*").alias("streams"),
        F.min_by(F.struct("codec", "width", "height"), F.when(video, F.col("stream_no"))).alias("video"),
        F.min_by(F.struct("codec", "sample_rate", "channels"), F.when(audio, F.col("stream_no"))).alias("audio"),
    )
    return heads.join(firsts, "job_id", "left").fillna({"streams": 0})


def parse_mux_progress(lines: DataFrame) -> DataFrame:
    """``job_id, seq, line, expected_seconds`` to positions and fractions.

    The first announced duration counts until the end, unless one was expected from the start.
    """
    announced = X.clock_seconds(F.regexp_extract("line", _DURATION, 1))
    rows = pin(lines, {"_announced": announced, "position_seconds": X.clock_seconds(F.regexp_extract("line", _TIME, 1))})
    # The earliest announcement is the largest of the negated sequence numbers seen so far.
    first = F.when(F.col("_announced").isNotNull(), F.struct(-F.col("seq"), F.col("_announced").alias("seconds")))
    rows = running(rows, ["job_id"], ["seq"], None, {"_first": Carry("max", first)})
    total = F.coalesce("expected_seconds", F.col("_first.seconds"))
    fraction = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("position_seconds") / total)))
    return rows.filter(F.col("position_seconds").isNotNull()).select("job_id", "seq", "position_seconds", fraction.alias("fraction"))


CHECKPOINT_SCHEMA = (
    "schema INT, written_parts INT, bytes BIGINT, total_parts INT, identity STRING,"
    " partesEscritas INT, totalDePartes INT, identidade STRING"
)


def read_checkpoints(sidecars: DataFrame) -> DataFrame:
    """``job_id, body`` to checkpoints. Unreadable is the same as absent; both key spellings count."""
    rows = pin(sidecars, {"c": F.from_json("body", CHECKPOINT_SCHEMA)})
    rows = rows.select(
        "job_id",
        F.coalesce("c.schema", F.lit(1)).alias("schema"),
        F.coalesce("c.written_parts", "c.partesEscritas").alias("written_parts"),
        F.col("c.bytes").alias("bytes"),
        F.coalesce("c.total_parts", "c.totalDePartes").alias("total_parts"),
        F.coalesce("c.identity", "c.identidade").alias("identity"),
    )
    return rows.filter(F.col("written_parts").isNotNull())


def verify_outputs(plans: DataFrame, reports: DataFrame) -> DataFrame:
    """What the file holds against what was asked for, as lines per job.

    ``plans`` has ``job_id, audio_only, height, expected_seconds, file_bytes``.
    Nothing read is "not checked", never "no sound".
    """
    joined = plans.withColumnRenamed("height", "wanted_height").join(reports, "job_id", "left")
    readable = F.coalesce("streams", F.lit(0)) > 0
    pictures = readable & ~F.col("audio_only")
    video = F.col("video").isNotNull()
    real, expected = F.col("duration_seconds"), F.col("expected_seconds")
    described = F.concat_ws(
        " | ",
        F.when(video, F.concat_ws(" ", F.lit("video"), "video.codec", F.concat(F.col("video.width").cast("string"), F.lit("x"), F.col("video.height").cast("string")))),
        F.when(F.col("audio").isNotNull(), F.concat(F.lit("audio "), F.col("audio.codec"))),
        F.when(real.isNotNull(), F.concat(F.lit("duration "), X.fmt_clock(real))),
        F.when(F.col("file_bytes") > 0, X.fmt_bytes(F.col("file_bytes"))),
    )
    smaller = F.concat(
        F.lit("file "), F.col("video.height").cast("string"), F.lit("p, chosen "), F.col("wanted_height").cast("string"), F.lit("p")
    )
    shorter = F.concat(F.lit("file "), X.fmt_clock(real), F.lit(", expected "), X.fmt_clock(expected))
    return audit_lines(
        joined, ["job_id"],
        [
            (~readable, "WARN/unreadable", F.lit("no stream could be read")),
            (readable, "INFO/output", described),
            (readable & F.col("audio").isNull(), "WARN/no_audio", F.lit("the file has no audio")),
            (pictures & ~video, "WARN/no_video", F.lit("the file has no video")),
            (pictures & video & (F.col("video.height") < F.col("wanted_height")), "WARN/smaller", smaller),
            (
                pictures & video & (expected > 0) & (real < expected * F.lit(DURATION_TOLERANCE)), "WARN/truncated", shorter,
            ),
        ],
    )


def tail_lines(df: DataFrame, col: str, n: int = 12) -> DataFrame:
    """The last ``n`` lines of a failure output that are not empty."""
    lines = F.filter(F.split(col, "\n"), lambda line: line != "")
    last = F.reverse(F.slice(F.reverse(lines), 1, n))
    trimmed = F.transform(last, lambda line: F.regexp_replace(line, r"\s+$", ""))
    return df.withColumn("tail", F.array_join(trimmed, "\n"))
