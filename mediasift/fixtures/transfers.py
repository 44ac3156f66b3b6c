"""Dumps, jobs, progress, fetch logs and inspections rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hls import items
from .tables import from_sql, table
from .traffic import RESPONSES_SQL


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dump per order, a format per line item.

    Flag A is muxed, N video only, R audio only; parts divisible by 11 are
    storyboards; parts divisible by 13 write the height as text. Orders
    divisible by 9 have no formats but one URL; orders divisible by 97 are
    broken.
    """
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    board = part % 11 == 0
    height = (F.col("l_linenumber") % 4 * 360).cast("int")
    fields = F.struct(
        F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("format_id"),
        F.concat(F.lit("https://x.example.com/"), part.cast("string")).alias("url"),
        F.when(board, "mhtml").otherwise("https").alias("protocol"),
        F.when(board | (flag == "R"), "none").when(flag == "A", "avc1.64").otherwise("vp9").alias("vcodec"),
        F.when(board | (flag == "N"), "none").when(flag == "A", "mp4a.40").otherwise("opus").alias("acodec"),
        F.when(part % 13 == 0, F.concat(F.lit('"'), height.cast("string"), F.lit('"'))).otherwise(height.cast("string")).alias("height"),
        F.round(F.col("l_extendedprice") / 100).cast("bigint").alias("tbr"),
        (F.col("l_linenumber") % 2 * 30 + 30).alias("fps"),
        F.when(flag == "N", "webm").otherwise("mp4").alias("ext"),
    )
    text = F.concat(
        F.lit('{"format_id":"'), fields["format_id"], F.lit('","url":"'), fields["url"], F.lit('","protocol":"'), fields["protocol"],
        F.lit('","vcodec":"'), fields["vcodec"], F.lit('","acodec":"'), fields["acodec"], F.lit('","height":'), fields["height"],
        F.lit(',"tbr":'), fields["tbr"].cast("string"), F.lit(',"fps":'), fields["fps"].cast("string"), F.lit(',"ext":"'), fields["ext"], F.lit('"}'),
    )
    grouped = items(spark, sf_dir).select("l_orderkey", "ordinal", text.alias("text")).groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda r: r["text"]), ",").alias("formats")
    )
    key = F.col("l_orderkey").cast("string")
    head = F.concat(
        F.lit('{"id":"src-'), key, F.lit('","title":"Title: '), (F.col("l_orderkey") % 50).cast("string"),
        F.lit('","duration":'), (F.col("l_orderkey") % 50 + 100).cast("string"), F.lit(',"is_live":false,'),
    )
    body = (
        F.when(F.col("l_orderkey") % 97 == 0, F.lit('{"id": '))
        .when(F.col("l_orderkey") % 9 == 0, F.concat(head, F.lit('"url":"https://one.example.com/'), key, F.lit('","ext":"mkv"}')))
        .otherwise(F.concat(head, F.lit('"formats":['), F.col("formats"), F.lit("]}")))
    )
    return grouped.select(
        F.concat(F.lit("https://site.example.com/watch/"), key).alias("page_url"), body.alias("body"), "l_orderkey"
    )


JOBS_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS done_now,
 count(*) OVER (PARTITION BY page_id) AS total_now
FROM ({RESPONSES_SQL})
"""


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per user; the stage follows the running count, so stages are long runs."""
    rows = from_sql(spark, sf_dir, JOBS_SQL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stage = (
        F.when(F.col("done_now") * 2 < F.col("total_now"), "video").when(F.col("done_now") * 4 < F.col("total_now") * 3, "audio").otherwise("finalizing")
    )
    return rows.select(
        F.concat(F.lit("job"), F.col("page_id").cast("string")).alias("job_id"), "seq", "ts", stage.alias("stage"),
        F.col("done_now").cast("int").alias("segments_done"), F.col("total_now").cast("int").alias("segments_total"),
        (F.col("done_now") * 1000).alias("bytes"), F.lit(None).cast("bigint").alias("total_bytes"),
        F.col("content_length").cast("double").alias("rate"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per (user, event_id / 200): queued, then a state per event; a late report after each end."""
    rows = from_sql(spark, sf_dir, RESPONSES_SQL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    state = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "signup", "queued")
    )
    stage = F.when(F.col("event_type") == "view", "finalizing").when(F.col("event_type") == "click", "video")
    return rows.select(
        F.concat(F.lit("job"), F.col("page_id").cast("string"), F.lit("-"), F.floor(F.col("seq") / 2000).cast("string")).alias("job_id"),
        (F.floor(F.col("seq") / 500) % 4 + 1).cast("int").alias("attempt"), "seq", "ts", state.alias("state"),
        stage.alias("stage"), F.when(F.col("event_type") == "error", F.col("url")).alias("error"),
        (F.col("seq") % 6 == 0).alias("permanent"), (F.col("seq") % 2).alias("warnings"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events in a row are the attempts of one request; the host is the user."""
    rows = from_sql(spark, sf_dir, RESPONSES_SQL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 403, 429, 503, 200)]), (F.col("seq") % 5 + 1).cast("int"))
    return rows.select(
        F.floor(F.col("seq") / 5).alias("request_id"), "ts", F.concat(F.lit("h"), (F.col("page_id") % 40).cast("string")).alias("host"),
        F.when(F.col("seq") % 3 == 0, "browser").otherwise("direct").alias("route"),
        (F.col("seq") % 5).cast("int").alias("attempt"), status.alias("status"),
        F.when(F.col("seq") % 7 == 0, (F.col("seq") % 60).cast("int")).alias("retry_after_s"),
        F.create_map(F.lit("User-Agent"), F.lit("x"), F.when(F.col("seq") % 4 == 0, F.lit("Cookie")).otherwise(F.lit("Referer")), F.lit("y")).alias("headers"),
    )


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inspection per order: a video stream, cover art, an audio stream unless the key divides by 5."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    height = F.element_at(F.array(*[F.lit(h) for h in (360, 720, 1080)]), (key % 3 + 1).cast("int"))
    body = F.concat(
        F.lit("Input #0, mov, from 'out.mp4':\r\n  Duration: 00:0"), (key % 10).cast("string"), F.lit(":30.50, start: 0.0\r\n"),
        F.when(key % 11 != 0, F.concat(
            F.lit("  Stream #0:0[0x1](und): Video: h264 (High) (avc1 / 0x31637661), yuv420p, "), (height * 16 / 9).cast("int").cast("string"),
            F.lit("x"), height.cast("string"), F.lit(", "), (key % 5000).cast("string"), F.lit(" kb/s, 30 fps\r\n"))).otherwise(F.lit("")),
        F.lit("  Stream #0:1: Video: mjpeg, yuvj420p, 600x600 (attached pic)\r\n"),
        F.when(key % 5 != 0, F.lit("  Stream #0:2(eng): Audio: aac (LC), 44100 Hz, stereo, fltp, 128 kb/s\r\n")).otherwise(F.lit("")),
    )
    body = F.when(key % 23 == 0, F.lit("out.mp4: Invalid data found")).otherwise(body)
    return orders.select(key.cast("string").alias("job_id"), body.alias("body"), "o_orderkey")
