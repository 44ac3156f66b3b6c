"""Browser captures and detection runs rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .traffic import responses


def net_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request, extra-info and response per event; extra-info is missing for every eleventh and late for every seventh.

    Every thirteenth event has no request, and one broken payload follows every seventeenth.
    """
    rows = responses(spark, sf_dir)
    rid = F.concat(F.lit("r"), F.col("request_id").cast("string"))
    request = F.to_json(F.struct(rid.alias("requestId"), F.struct(
        F.col("url"), F.create_map(F.lit("User-Agent"), F.lit("agent"), F.lit("X-Token"), F.lit("plain"), F.lit("Range"), F.lit("bytes=0-")).alias("headers")).alias("request")))
    extra = F.to_json(F.struct(rid.alias("requestId"), F.create_map(
        F.lit("Cookie"), F.concat(F.lit("c="), F.col("request_id").cast("string")), F.lit("x-token"), F.lit("extra")).alias("headers")))
    length = F.col("content_length").cast("string")
    answer = F.when(
        F.col("request_id") % 2 == 0, F.create_map(F.lit("Content-Range"), F.concat(F.lit("bytes 0-9/"), length), F.lit("Content-Length"), F.lit("10"))
    ).otherwise(F.create_map(F.lit("content-length"), length))
    response = F.to_json(F.struct(rid.alias("requestId"), F.col("resource_type").alias("type"), F.struct(
        F.col("url"), F.col("mime_type").alias("mimeType"), answer.alias("headers")).alias("response")))
    late = F.when(F.col("request_id") % 7 == 0, 3).otherwise(1)
    event = lambda offset, method, params: F.struct(offset.alias("k"), F.lit(method).alias("method"), params.alias("params"))
    parts = F.array(
        F.when(F.col("request_id") % 13 != 0, event(F.lit(0), "Network.requestWillBeSent", request)),
        F.when(F.col("request_id") % 11 != 0, event(late, "Network.requestWillBeSentExtraInfo", extra)),
        event(F.lit(2), "Network.responseReceived", response),
        F.when(F.col("request_id") % 17 == 0, event(F.lit(4), "Network.responseReceived", F.lit('{"requestId": '))),
    )
    split = rows.select("page_id", "seq", "ts", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"))
    return split.select(
        F.col("page_id").alias("visit_id"), (F.col("seq") * 5 + F.col("p.k")).alias("seq"), "ts", "p.method", "p.params"
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy(F.col("page_id").alias("visit_id")).agg(
        F.min("page_url").alias("page_url"), F.max("page_title").alias("page_title")
    )


def dom_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per event: purchases play files, views play blobs, errors are other messages, the rest is relative."""
    rows = responses(spark, sf_dir)
    src = (
        F.when(F.col("event_type") == "purchase", F.col("url")).when(F.col("event_type") == "view", F.concat(F.lit("blob:https://x/"), F.col("seq").cast("string")))
        .when(F.col("event_type") == "click", F.lit(" ")).otherwise(F.lit("/relative.mp4"))
    )
    kind = F.when(F.col("event_type") == "error", "other").otherwise("media-element")
    payload = F.to_json(F.struct(kind.alias("kind"), src.alias("src"), F.lit("video").alias("tag"), F.col("page_title").alias("title"), F.col("page_url").alias("page")))
    return rows.select("page_id", "seq", F.when(F.col("seq") % 29 == 0, F.lit("{")).otherwise(payload).alias("payload"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with a player put at the end of every article: one video with two sources, one of them twice."""
    key = F.col("page_id").cast("string")
    player = F.concat(
        F.lit('<video class="a>b" src="/v/'), key, F.lit('.mp4?a=1&amp;b=2"><source src="alt.webm" type="video/webm"><source src=alt.webm></video>'),
        F.lit("<!-- <video src='no.mp4'> --><audio src='https://cdn.example.com/"), key, F.lit(".mp3'></audio><source src=\"orphan.mp4\"></article>"),
    )
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", player))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as targets; the expectation turns with the key."""
    expectations = F.array(*[F.lit(e) for e in ("any_media", "stream", "file", "video", "drm_refusal")])
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("target_no"),
        F.concat(F.lit("https://site.example.com/"), F.col("n_nationkey").cast("string"), F.lit("?token=abc")).alias("url"),
        F.element_at(expectations, F.col("n_nationkey") % 5 + 1).alias("expectation"), "n_nationkey",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as what was seen there; nations divisible by 6 saw nothing."""
    kinds = F.array(*[F.lit(k) for k in ("progressive_audio", "hls_playlist", "page_embed", "subtitle", "progressive_video")])
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").filter(F.col("s_nationkey") % 6 != 0).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    return rows.select(
        F.col("n_name").alias("target"), key.alias("ordinal"), F.element_at(kinds, ((key * 7 + F.col("s_nationkey")) % 5 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("https://cdn.example.com/"), key.cast("string"), F.lit("?sig=zzz&n=1")).alias("url"),
        F.when(key % 3 != 0, key * 2048).alias("content_length"), (key % 13 == 0).alias("is_protected"),
        F.when(key % 26 == 0, F.lit("Widevine")).alias("system"), (key % 4).cast("int").alias("variant_count"),
        F.when(key % 8 == 0, F.lit("failed at https://h/x?token=1")).alias("error"),
    )


def detection_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("target"), F.when(key == 7, F.lit("budget spent")).alias("error"),
        F.when(key.isin(0, 8), F.lit("navigation failed")).alias("navigation_error"), (key % 4 != 0).alias("playback_started"),
        (key * 1.5).alias("elapsed_s"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as download attempts."""
    key = F.col("s_suppkey")
    seen = observations(spark, sf_dir)
    outcome = F.when(F.col("ordinal") % 5 == 0, "downloaded").when(F.col("ordinal") % 7 == 0, "downloading").otherwise("failed")
    return seen.select(
        "target", "ordinal", "kind", "url", F.when(F.col("ordinal") % 2 == 0, F.lit("native")).alias("resolved_by"),
        F.lit("720p").alias("quality"), outcome.alias("outcome"), (F.col("ordinal") * 4096).alias("bytes"),
        (F.col("ordinal") % 50).cast("double").alias("elapsed_s"), F.when(outcome == "failed", F.lit("a|b\nc")).alias("error"),
    )
