"""Log lines, listings and other records rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import from_sql, table
from .traffic import RESPONSES_SQL

LOG_FILES_SQL = f"""
SELECT *, CASE seq % 10 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'WARN' WHEN 3 THEN 'DEBUG' ELSE 'INFO' END AS level,
 CASE seq % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'http' ELSE 'resolver' END AS source
FROM ({RESPONSES_SQL})
"""


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts, level, source, message``; every message holds a signed URL."""
    rows = from_sql(spark, sf_dir, LOG_FILES_SQL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    message = F.concat(
        F.lit("[job"), F.col("page_id").cast("string"), F.lit("] GET "), F.col("url"),
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit(" Cookie: sid="), F.col("seq").cast("string"))).otherwise(F.lit(" done")),
    )
    return rows.select("seq", "page_id", "event_type", "ts", "level", "source", message.alias("message"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, line``: one file per day, a continuation line after every thirteenth event."""
    rows = log_entries(spark, sf_dir)
    head = F.concat(
        F.date_format("ts", "HH:mm:ss.SSS"), F.lit("  "), F.rpad("level", 5, " "), F.lit("  "),
        F.rpad("source", 18, " "), F.lit("  "), F.col("message"),
    )
    follow = F.concat(F.lit(" " * 40 + "IOException: part "), F.col("seq").cast("string"))
    lines = F.when(F.col("seq") % 13 == 0, F.array(head, follow)).otherwise(F.array(head))
    split = rows.select(
        F.concat(F.lit("logs/app-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")).alias("file"),
        "seq", F.posexplode(lines).alias("k", "line"),
    )
    return split.select("file", (F.col("seq") * 2 + F.col("k")).alias("line_no"), "line")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, size, modified`` from ``orders``."""
    return table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("work/"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("app-")).otherwise(F.lit("job-")),
            F.col("o_custkey").cast("string"), F.lit("/"),
            F.when(F.col("o_orderkey") % 5 == 0, F.lit("other-")).otherwise(F.lit("app-")), F.col("o_orderkey").cast("string"),
            F.when(F.col("o_orderkey") % 2 == 0, F.lit(".log")).otherwise(F.lit(".part")),
        ).alias("path"),
        F.round("o_totalprice").cast("bigint").alias("size"),
        F.col("o_orderdate").cast("timestamp").alias("modified"),
        "o_orderkey", "o_custkey",
    )


def checksum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.col("text").cast("binary").alias("content"),
    )


def checksum_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per hundred documents; one digest in 17 is altered, one file in 11 is not listed."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 != 0)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    digest = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("0" * 8), F.substring(digest, 9, 56))).otherwise(digest)
    star = F.when(F.col("doc_id") % 2 == 0, F.lit(" *")).otherwise(F.lit("  "))
    line = F.concat(F.upper(digest), star, F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    listed = docs.select(F.floor(F.col("doc_id") / 100).alias("list_id"), "doc_id", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda r: r["line"])
    body = F.concat(F.lit("# sums\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return listed.groupBy("list_id").agg(body.alias("body")).withColumn("list_id", F.col("list_id").cast("string"))
