"""HLS texts rendered from ``lineitem`` and ``orders``: one master and one media playlist per order.

The lines of a text come from the line items of one order, numbered by
``ordinal`` in a total order, so the expected rows can be read off the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import from_sql, table

IN_ORDER = """(PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)"""
ORDINAL = f"row_number() OVER {IN_ORDER}"

ITEMS_SQL = f"SELECT *, {ORDINAL} AS ordinal FROM {{lineitem}}"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, ITEMS_SQL, "lineitem")


def _texts(rows: DataFrame, body, *extra) -> DataFrame:
    """Put the lines of each order together in order."""
    # Compiled: array_sort and transform with a lambda are interpreted.
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("ordinal", "text")))["text"], "\n")
    return rows.groupBy("l_orderkey").agg(joined.alias("_lines"), *extra).withColumn("body", body)


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header lines, two audio and one subtitle rendition, then two lines per item.

    Every seventh item is a trick-play row (one line of its own kind and one
    comment), and items flagged R declare no codecs.
    """
    height = F.element_at(F.array(*[F.lit(h) for h in (360, 720, 1080, 2160)]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    width = (height * 16 / 9).cast("int")
    codecs = (
        F.when(F.col("l_returnflag") == "A", F.lit(',CODECS="avc1.640028,mp4a.40.2"'))
        .when(F.col("l_returnflag") == "N", F.lit(',CODECS="hvc1.1.6"'))
        .otherwise(F.lit(""))
    )
    group = F.when(F.col("l_returnflag") == "N", F.lit(',AUDIO="aud"')).otherwise(F.lit(""))
    bandwidth = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    size = F.when(
        F.col("l_returnflag") == "R", F.lit("")
    ).otherwise(F.concat(F.lit(",RESOLUTION="), width.cast("string"), F.lit("x"), height.cast("string")))
    average = F.when(
        F.col("l_partkey") % 2 == 0, F.concat(F.lit(",AVERAGE-BANDWIDTH="), (bandwidth - 7).cast("string"))
    ).otherwise(F.lit(""))
    stream = F.concat(
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), bandwidth.cast("string"), average, size, codecs, group,
        F.lit("\n  v/"), F.col("l_partkey").cast("string"), F.lit(".m3u8?s="), F.col("ordinal").cast("string"),
    )
    trick = F.concat(
        F.lit("#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH="), bandwidth.cast("string"), F.lit(',URI="trick/'),
        F.col("l_partkey").cast("string"), F.lit('.m3u8"\n# trick play'),
    )
    rows = items(spark, sf_dir).select(
        "l_orderkey", "ordinal", F.when(F.col("l_partkey") % 7 == 0, trick).otherwise(stream).alias("text")
    )
    head = (
        "#EXTM3U\n#EXT-X-VERSION:6\n"
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="English, main",LANGUAGE="en",DEFAULT=YES,URI="../audio/en.m3u8",CHANNELS="6"\n'
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="Deutsch",LANGUAGE="de",URI="/abs/de.m3u8",CHANNELS="2"\n'
        '#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="Legenda",LANGUAGE="pt",URI="subs/pt.m3u8"\n'
    )
    texts = _texts(rows, F.concat(F.lit(head), F.col("_lines"), F.lit("\n")))
    return texts.select(
        F.concat(F.lit("master-"), F.col("l_orderkey").cast("string")).alias("manifest_id"),
        F.concat(F.lit("https://cdn.example.com/o/"), F.col("l_orderkey").cast("string"), F.lit("/master.m3u8?t=1")).alias("url"),
        F.lit("hls_playlist").alias("kind"),
        "body",
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One media playlist per order.

    Duration is the quantity; every segment is a byte range of one of three
    files with its offset written on even ordinals only; a key tag stands where
    the return flag changes (R clears it); a map tag stands where the line
    status changes; the sequence starts at the order key modulo 1000; the end
    tag depends on the order status.
    """
    rows = from_sql(
        spark, sf_dir,
        f"""
        SELECT *, row_number() OVER w AS ordinal, lag(l_returnflag) OVER w AS prev_flag, lag(l_linestatus) OVER w AS prev_status
        FROM {{lineitem}} WINDOW w AS {IN_ORDER}
        """,
        "lineitem",
    )
    partkey = F.col("l_partkey").cast("string")
    key = F.when(
        F.col("prev_flag").isNull() | (F.col("prev_flag") != F.col("l_returnflag")),
        F.when(
            F.col("l_returnflag") == "A",
            F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="keys/'), partkey, F.lit('.key"\n')),
        )
        .when(
            F.col("l_returnflag") == "N",
            F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="k2,v2.key",IV=0x'), F.lpad(F.hex("l_partkey"), 32, "0"), F.lit("\n")),
        )
        .otherwise(F.lit("#EXT-X-KEY:METHOD=NONE\n")),
    ).otherwise(F.lit(""))
    section = F.when(
        F.col("prev_status").isNull() | (F.col("prev_status") != F.col("l_linestatus")),
        F.concat(F.lit('#EXT-X-MAP:URI="init-'), F.col("l_linestatus"), F.lit('.mp4",BYTERANGE="720@0"\n')),
    ).otherwise(F.lit(""))
    span = F.concat(
        F.lit("#EXT-X-BYTERANGE:"), (F.col("l_partkey") + 1000).cast("string"),
        F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("@"), (F.col("ordinal") * 5000).cast("string"))).otherwise(F.lit("")),
    )
    gap = F.when(F.col("l_linenumber") == 4, F.lit("#EXT-X-DISCONTINUITY\n")).otherwise(F.lit(""))
    seconds = F.format_string("%.3f", F.col("l_quantity"))
    text = F.concat(
        key, section, gap, F.lit("#EXTINF:"), seconds, F.lit(",part "), F.col("ordinal").cast("string"), F.lit("\n"),
        span, F.lit("\nfile"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".ts"),
    )
    texts = _texts(rows.select("l_orderkey", "ordinal", text.alias("text")), F.col("_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    joined = texts.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    head = F.concat(
        F.lit("﻿#EXTM3U\r\n#EXT-X-VERSION:4\r\n#EXT-X-TARGETDURATION:50\r\n#EXT-X-MEDIA-SEQUENCE:"),
        (F.col("l_orderkey") % 1000).cast("string"), F.lit("\r\n"),
    )
    tail = F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.lit("\n#EXT-X-ENDLIST\n"))
    return joined.select(
        F.concat(F.lit("media-"), F.col("l_orderkey").cast("string")).alias("manifest_id"),
        F.concat(F.lit("https://cdn.example.com/o/"), F.col("l_orderkey").cast("string"), F.lit("/media.m3u8")).alias("url"),
        F.lit("hls_playlist").alias("kind"),
        F.concat(head, F.col("_lines"), tail).alias("body"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters, media playlists, and one text in ten orders that is no playlist at all."""
    pages = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 == 0).select(
        F.concat(F.lit("page-"), F.col("o_orderkey").cast("string")).alias("manifest_id"),
        F.concat(F.lit("https://cdn.example.com/o/"), F.col("o_orderkey").cast("string"), F.lit("/index.html")).alias("url"),
        F.lit("unknown").alias("kind"),
        F.concat(F.lit("<html>#EXTM3U "), F.col("o_orderstatus"), F.lit("</html>")).alias("body"),
    )
    return masters(spark, sf_dir).unionByName(media(spark, sf_dir)).unionByName(pages)
