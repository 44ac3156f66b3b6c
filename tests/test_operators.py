"""Operators on small tables: traps, brute force for the chunked windows, order of input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediasift.operators import dash, detection, hls, ordered, registry, variants
from mediasift.sinks import writers
from mediasift.sources import readers

T0 = dt.datetime(2024, 1, 1)


def observations(spark, rows):
    schema = "seq BIGINT, url STRING, mime_type STRING, content_length BIGINT, cookie STRING, page_url STRING, page_title STRING"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_micros(F.col("seq") * 1_000_000))


def found(spark, rows):
    accepted = registry.filter_candidates(registry.classify_observations(observations(spark, rows)))
    return {r.candidate_key: r for r in registry.candidates(accepted).collect()}


def test_candidates_follow_the_first_observation_in_any_input_order(spark):
    rows = [
        (1, "https://h.com/a.m3u8?token=1", None, None, "s=1", None, " "),
        (2, "https://h.com/a.m3u8?token=2", "text/plain", 500, None, "https://p.com/", "Title"),
        (3, "https://h.com/b.mp4", "video/mp4", 70_000, None, None, None),
        (4, "https://h.com/b.mp4", "video/mp4", 90_000, None, None, None),
        (5, "https://h.com/small.mp4", "video/mp4", 10, None, None, None),
        (6, "https://x.com/u", "application/vnd.yt-ump", 10, None, "https://p.com/watch", "Watch"),
        (7, "https://x.com/u", "application/vnd.yt-ump", 10, None, None, "Nowhere"),
    ]
    expected = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = found(spark, rows)
        assert set(got) == {"https://h.com/a.m3u8", "https://h.com/b.mp4", "https://p.com/watch"}
        a = got["https://h.com/a.m3u8"]
        # Size unknown at first stays unknown; the request with a cookie stays; blank titles are replaced.
        assert (a.hit_count, a.content_length, a.cookie, a.page_title, a.mime_type) == (2, None, "s=1", "Title", "text/plain")
        assert got["https://h.com/b.mp4"].content_length == 90_000
        assert got["https://p.com/watch"].kind == "page_embed"
        assert expected in (None, got)
        expected = got


def test_running_values_equal_brute_force_across_chunks(spark):
    rng = random.Random(7)
    rows = [(rng.choice("xxxy"), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, v BIGINT")
    got = ordered.running(
        df, ["k"], ["i"], ordered.by_count("i", 17),
        {
            "total": ordered.Carry("sum", F.col("v")), "n": ordered.Carry("count", F.lit(1)),
            "top": ordered.Carry("max", F.col("v"), inclusive=False), "last": ordered.Carry("last", F.col("v"), inclusive=False),
        },
    ).collect()
    for r in got:
        upto = [v for k, i, v in rows if k == r.k and i <= r.i]
        before = [v for k, i, v in rows if k == r.k and i < r.i and v is not None]
        seen = [v for v in upto if v is not None]
        assert r.total == (sum(seen) if seen else None)
        assert r.n == len(upto)
        assert r.top == (max(before) if before else None)
        assert r.last == (before[-1] if before else None)


MEDIA = """#EXTM3U
#EXT-X-KEY:METHOD=AES-128,URI="k1"
#EXTINF:4,
a.ts
#EXT-X-MEDIA-SEQUENCE:100
#EXT-X-KEY:METHOD=NONE
#EXTINF:bad,title, with comma
b.ts
#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k2",KEYFORMAT="com.widevine"
#EXT-X-BYTERANGE:10
c.ts
#EXT-X-BYTERANGE:5
c.ts
#EXT-X-BYTERANGE:5@100
d.ts
#EXT-X-BYTERANGE:7
c.ts
"""


def test_media_playlist_traps(spark):
    df = spark.createDataFrame([("m", "https://h.com/p/x.m3u8", MEDIA)], "manifest_id STRING, url STRING, body STRING")
    rows = hls.hls_segments(df).orderBy("ordinal").collect()
    assert [r.media_sequence for r in rows] == [0, 101 - 1, 101, 102, 103, 104]
    assert [r.key_method for r in rows] == ["AES-128", None] + ["SAMPLE-AES"] * 4
    assert [r.range_offset for r in rows] == [None, None, 0, 10, 100, 15]
    assert rows[0].iv == bytes(16) and rows[1].title == "title, with comma" and rows[1].duration == 0.0
    keys = hls.playlist_keys(hls.hls_segments(df))
    assert hls.playlist_protection(keys).first()[1:] == (True, "Widevine")
    # A playlist under DRM gives no parts to fetch.
    assert hls.hls_parts(df).count() == 0


def test_quality_dedupe_treats_nulls_as_equal(spark):
    rows = [("s", 0, 0, 0, "video_only", None, 1), ("s", 1, 0, 0, "video_only", None, 1), ("s", 1, 1, 0, "video_only", 720, 1)]
    df = spark.createDataFrame(rows, "source_id STRING, period_no INT, set_no INT, rep_no INT, track STRING, height INT, bandwidth BIGINT")
    df = df.withColumns({"codecs": F.lit(None).cast("string"), "language": F.lit(None).cast("string")})
    kept = dash.dedupe_qualities(df).orderBy("period_no").collect()
    assert [(r.period_no, r.height) for r in kept] == [(0, None), (1, 720)]


def test_broken_manifest_drops_out(spark):
    df = spark.createDataFrame([("a", "https://h/x.mpd", "<MPD><Period"), ("b", "https://h/x", "text")], "manifest_id STRING, url STRING, body STRING")
    assert dash.parse_manifests(df).count() == 0


def test_saturated_scores_tie_in_document_order(spark):
    rows = [("s", 0, 1080, 1_500_000), ("s", 1, 1080, 9_000_000), ("s", 2, 2160, None)]
    df = spark.createDataFrame(rows, "source_id STRING, ordinal BIGINT, height INT, bandwidth BIGINT").withColumn("track", F.lit("muxed"))
    ranked = variants.rank_videos(df).orderBy("video_rank").collect()
    assert [r.ordinal for r in ranked] == [2, 0, 1]


def test_unique_names_against_existing(spark):
    df = spark.createDataFrame([("A.mp4", 1), ("a.mp4", 2), ("b.mp4", 3)], "path STRING, seq BIGINT")
    taken = spark.createDataFrame([("B.mp4",)], "path STRING")
    got = {r.seq: r.unique_path for r in variants.unique_names(df, "path", "seq", taken).collect()}
    assert got == {1: "A.mp4", 2: "a (2).mp4", 3: "b (2).mp4"}


def test_selecting_no_target_is_an_error(spark):
    df = spark.createDataFrame([("n", "https://h", "stream")], "name STRING, url STRING, expectation STRING")
    with pytest.raises(ValueError):
        detection.select_targets(df, "absent")


def test_log_round_trip(spark, tmp_path):
    rows = [(T0, "INFO", "http", "GET https://h/a?token=1"), (T0, "DEBUG", "http", "x"), (T0, "WARN", "download", "[j1] slow")]
    entries = spark.createDataFrame(rows, "ts TIMESTAMP, level STRING, source STRING, message STRING")
    writers.write_log(entries, str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log")).collect()
    assert sorted(r.value.split()[1] for r in lines) == ["INFO", "WARN"]
    assert any("token=[redigido]" in r.value for r in lines)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app-2024-01-01.log").write_text("00:00:01.000  ERROR  http  bad\n    more\n00:00:02.000  INFO   http  ok\n")
    parsed = readers.read_app_log(spark, str(tmp_path / "in")).orderBy("offset").collect()
    assert [(r.level, r.is_continuation) for r in parsed] == [("ERROR", False), ("ERROR", True), ("INFO", False)]
    assert str(parsed[0].log_date) == "2024-01-01"


def test_unreadable_target_list_fails(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"name": "a", "url": ')
    with pytest.raises(Exception):
        readers.read_targets(spark, str(tmp_path / "t.json")).collect()
