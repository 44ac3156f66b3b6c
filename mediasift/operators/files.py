"""Files, checksums and space."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import manifests as M
from ..functions import text as X
from .ordered import first_per

ORPHAN_HOURS = 6
PARALLEL_FROM_BYTES = 24 * 1024 * 1024
BLOCK_BYTES = 8 * 1024 * 1024


def parse_checksums(lists: DataFrame) -> DataFrame:
    """``list_id, body`` to one row per listed file; the first line of a name wins.

    A line counts when its first word is 64 hexadecimal digits. The last word,
    less a star, is the name; a lone digest has none.
    """
    lines = lists.select("list_id", F.posexplode(M.lines_of(F.col("body"))).alias("line_no", "line"))
    lines = lines.filter(F.col("line").rlike(r"^[0-9A-Fa-f]{64}(?:\s|$)"))
    named = lines.select(
        "list_id",
        "line_no",
        F.lower(F.substring("line", 1, 64)).alias("sha256"),
        F.nullif(F.regexp_extract("line", r"\s\**(\S+)$", 1), F.lit("")).alias("name"),
    ).withColumn("name_key", F.lower("name"))
    return first_per(named, ["list_id", "name_key"], ["line_no"])


def verify_checksums(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """``name, content`` against the published digests: match, mismatch or unlisted.

    Files that carry a ``list_id`` are held against that list. Others match when any list gives their digest under
    their name; else the smallest digest listed for the name is what was expected. One row per file either way.
    """
    keys = ["list_id", "name_key"] if "list_id" in files.columns else ["name_key"]
    actual = files.withColumns({"actual_sha256": F.sha2("content", 256), "name_key": F.lower("name")}).drop("content")
    listed = checksums.groupBy(*keys).agg(F.min("sha256").alias("_any"))
    exact = checksums.select(*keys, F.col("sha256").alias("actual_sha256"), F.col("sha256").alias("_same")).distinct()
    joined = actual.join(listed, keys, "left").join(exact, [*keys, "actual_sha256"], "left")
    joined = joined.withColumn("expected_sha256", F.coalesce("_same", "_any"))
    joined = joined.select(*[c for c in actual.columns if c != "name_key"], "expected_sha256")
    verdict = (
        F.when(F.col("expected_sha256").isNull(), "unlisted")
        .when(F.col("expected_sha256") == F.col("actual_sha256"), "match")
        .otherwise("mismatch")
    )
    return joined.withColumn("verdict", verdict)


def orphan_sweep(listing: DataFrame, now: dt.datetime, depth: int = 1, hours: int = ORPHAN_HOURS) -> DataFrame:
    """Working folders nothing was written to for six hours, with their size.

    ``path`` is ``root/folder/...``; a folder is as young as its youngest file.
    """
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, depth + 1), "/")
    root = F.array_join(F.slice(parts, 1, depth), "/")
    folders = listing.groupBy(root.alias("root"), folder.alias("folder")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files"), F.max("modified").alias("last_write")
    )
    return folders.filter(F.col("last_write") <= F.lit(now - dt.timedelta(hours=hours)))


def orphan_totals(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("root").agg(
        F.count("*").alias("folders"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files")
    )


def capacity_check(plans: DataFrame, volumes: DataFrame) -> DataFrame:
    """Does the volume hold the plan? Unknown free space passes.

    ``plans`` has ``root`` and ``estimated_bytes``.
    """
    space = volumes.select("root", "free_bytes")
    joined = plans.join(space, "root", "left")
    required = X.required_bytes(F.col("estimated_bytes"))
    return joined.withColumn("required_bytes", required).withColumn(
        "fits", F.coalesce(F.col("free_bytes") >= F.col("required_bytes"), F.lit(True))
    )


def range_plan(files: DataFrame, workers: int = 4, threshold: int = PARALLEL_FROM_BYTES) -> DataFrame:
    """``file_id, total_bytes, accepts_ranges`` to the ranges a parallel fetch would ask for.

    Large ranged files are cut into equal chunks, one per worker; any other
    file is a single open range.
    """
    total = F.col("total_bytes")
    split = F.coalesce(F.col("accepts_ranges") & (total > 0) & (total >= threshold), F.lit(False)) & F.lit(workers > 1)
    chunk = F.ceil(total / F.lit(float(workers)))
    starts = F.when(split, F.sequence(F.lit(0).cast("bigint"), total - 1, chunk)).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    rows = files.select("*", split.alias("_split"), chunk.alias("_chunk"), F.posexplode(starts).alias("part_no", "start"))
    end = F.when(F.col("_split"), F.least(F.col("start") + F.col("_chunk"), total) - 1)
    header = F.concat(F.lit("bytes="), F.col("start").cast("string"), F.lit("-"), F.coalesce(F.col("end").cast("string"), F.lit("")))
    return rows.withColumn("end", end).withColumn("range", header).drop("_split", "_chunk")


def block_plan(files: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Closed ranges of a fixed block size over each file with a known size."""
    known = files.filter(F.col("total_bytes") > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("total_bytes") - 1, F.lit(block).cast("bigint"))
    rows = known.select("*", F.posexplode(starts).alias("block_no", "start"))
    return rows.withColumn("end", F.least(F.col("start") + block, F.col("total_bytes")) - 1)
