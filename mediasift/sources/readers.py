"""Sources (S1, S4, S6, S11, S13): files and streams to the tables the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decoding import decode_text
from ..operators import events as E
from ..operators.logs import parse_app_log
from ..operators.ordered import by_count
from .lines import PIECE, read_lines

CARRY_BYTES = 32 << 20  # bytes of a log file whose lines are put in order together

TARGET_SCHEMA = "name STRING, url STRING, expectation STRING"


def read_net_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One JSON event per line: ``visit_id, seq, ts, method, params``. Malformed lines drop out.

    A stream follows files that are still being written, from byte to byte.
    """
    if stream:
        events = read_lines(spark, path, stream=True).select(F.from_json("line", E.EVENT_SCHEMA).alias("e")).select("e.*")
    else:
        events = spark.read.schema(E.EVENT_SCHEMA).json(path, mode="PERMISSIVE")
    return E.parse_net_events(events.filter(F.col("method").isNotNull()))


def decode_manifest(df: DataFrame, content: str = "content", charset: str = "charset") -> DataFrame:
    """Bytes to text by the declared charset, else UTF-8, without a byte order mark; see ``decode_text``."""
    return decode_text(df, content, charset, "body")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A folder of manifest files, the path being both id and base address."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(
        F.col("path").alias("manifest_id"), F.col("path").alias("url"), F.lit(None).cast("string").alias("charset"), "content"
    )
    return decode_manifest(rows).drop("content")


def read_app_log(spark: SparkSession, path: str, piece_bytes: int = PIECE) -> DataFrame:
    """Log files to parsed lines, in the order of ``offset``, the byte at which a line starts.

    A file is read in pieces by as many tasks, whatever its size; a line's level is carried on by stretches of bytes.
    """
    lines = read_lines(spark, path, piece_bytes=piece_bytes).filter(F.col("line") != "")
    return parse_app_log(lines, "offset", by_count("offset", CARRY_BYTES))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """The target list. A file that cannot be read fails the job instead of shrinking it."""
    return spark.read.schema(TARGET_SCHEMA).json(path, mode="FAILFAST", multiLine=True)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files with size and last write; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
