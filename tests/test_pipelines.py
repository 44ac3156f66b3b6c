"""The operators put together, on a handful of texts and files."""

from pyspark.sql import functions as F

from mediasift.fixtures import hls as H
from mediasift.operators import events, hls
from mediasift.plans import pipelines, table_functions
from mediasift.sinks import writers
from mediasift.sources import readers
from mediasift.streaming import live
from mediasift.streaming.running import drain

SF = "/root/testdata/sf0.001"
MASTER = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5,RESOLUTION=10x20\nv.m3u8\n#EXT-X-SESSION-KEY:METHOD=SAMPLE-AES,KEYFORMAT="com.widevine"\n'
MPD = '<MPD><Period><AdaptationSet contentType="audio"><Representation id="a" bandwidth="9"/></AdaptationSet></Period></MPD>'


def test_corpus_to_variants_and_protection(spark):
    rows = [("m", "https://h.com/m.m3u8", "hls_playlist", MASTER), ("d", "https://h.com/d.mpd", "dash_manifest", MPD)]
    corpus = spark.createDataFrame(rows, "manifest_id STRING, url STRING, kind STRING, body STRING")
    got = {(r.source_id, r.track, r.bandwidth) for r in pipelines.variants_from_corpus(corpus).collect()}
    assert got == {("m", "muxed", 5), ("d", "audio_only", 9)}
    packages = pipelines.protected_packages(corpus).collect()
    assert [tuple(r) for r in packages] == [("https://h.com/m.m3u8", "Widevine")]


def test_files(spark, tmp_path):
    (tmp_path / "x.m3u8").write_bytes("﻿#EXTM3U\n".encode())
    assert readers.read_manifests(spark, str(tmp_path)).first().body == "#EXTM3U\n"
    assert readers.read_listing(spark, str(tmp_path)).first()["size"] == 11


def test_report_and_log_tail(spark, tmp_path):
    lines = spark.range(5).select(F.lit(0).alias("section"), F.lit(0).alias("part"), (-F.col("id")).alias("item"), F.lit(0).alias("line_no"), F.col("id").cast("string").alias("line"))
    writers.write_report(lines, str(tmp_path / "r"))
    parts = sorted((tmp_path / "r").glob("part-*.txt"))
    assert "".join(p.read_text() for p in parts).split() == ["4", "3", "2", "1", "0"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "app-2024-01-01.log").write_text("00:00:01.000  DEBUG  a  x\n00:00:02.000  WARN   b  y\n")
    tail = drain(live.stream_log(spark, str(tmp_path / "logs"), "WARN")).collect()
    assert [(r.level, r.message) for r in tail] == [("WARN", "y")]


def test_charsets_and_broken_bytes(spark):
    rows = [(1, None, b"a\xffb"), (2, ' "windows-1252" ', b"\x80"), (3, "shift_jis", "テ".encode("shift_jis") + b"\x81"), (4, "base64", b"YQ=="), (5, "utf-16", "x".encode("utf-16")),
            (6, "", "\ufeffok".encode()), (7, "latin1", b"\xe9"), (8, "us-ascii", b"a\xe9"), (9, "utf-8", None), (10, "x" * 300, b"ok")]
    got = {r.i: r.body for r in readers.decode_manifest(spark.createDataFrame(rows, "i INT, charset STRING, content BINARY")).collect()}
    assert got == {1: "a\ufffdb", 2: "€", 3: "テ\ufffd", 4: "YQ==", 5: "x", 6: "ok", 7: "é", 8: "a\ufffd", 9: None, 10: "ok"}


def test_table_functions_are_the_operators(spark):
    corpus = H.corpus(spark, SF)
    table_functions.register_table_functions(spark, corpus)
    assert spark.sql("SELECT count(*) FROM hls_parts()").first()[0] == hls.hls_parts(H.media(spark, SF)).count()
    one = H.media(spark, SF).select("manifest_id").first()[0]
    want = hls.hls_parts(H.media(spark, SF)).filter(F.col("manifest_id") == one).count()
    assert spark.sql(f"SELECT count(*) FROM hls_parts('{one}')").first()[0] == want > 0
    assert spark.sql("SELECT count(*) FROM hls_parts('absent')").first()[0] == 0


def test_tags_of_long_pages_and_late_headers(spark):
    """A running depth over 50,000 tags; the last request and extra headers of an id, wherever they stand."""
    html = "<source src='http://x/no.mp4'>" + "".join(f"<video src='http://x/{i}.mp4'><source src=\"http://x/s{i}.webm\"></video>" for i in range(16_000)) + "<source src='http://x/no2.mp4'>"
    pages = spark.createDataFrame([(1, "http://x/", html), (1, "http://x/", html), (None, "http://y/", "<audio><source src=a.mp3></audio>")], "page_id LONG, url STRING, html STRING")
    found = events.html_media_elements(pages)
    assert found.count() == 32_001 and found.filter(F.col("src").contains("no")).count() == 0

    def event(seq, method, params):
        return (1, seq, None, method, params)

    rows = [event(1, "Network.responseReceived", '{"requestId":"r","response":{"url":"http://x/a.mp4","mimeType":"video/mp4","headers":{}}}'),
            event(2, "Network.requestWillBeSent", '{"requestId":"r","request":{"url":"http://x/a.mp4","headers":{"Cookie":"old"}}}'),
            event(4, "Network.requestWillBeSentExtraInfo", '{"requestId":"r","headers":{"cookie":"new"}}'),
            event(3, "Network.requestWillBeSentExtraInfo", '{"requestId":"r","headers":{"cookie":"mid"}}'),
            event(5, "Network.responseReceived", '{"requestId":"alone","response":{"url":"http://x/b.mp4","headers":{}}}')]
    got = events.correlate_requests(events.parse_net_events(spark.createDataFrame(rows, events.EVENT_SCHEMA)))
    assert sorted((r.request_id, r.cookie) for r in got.collect()) == [("alone", None), ("r", "new")]


def test_a_corpus_of_playlists_is_rendered_once(spark, tmp_path):
    """Streams, renditions, heads and durations start from one written table, not from the corpus."""
    media = "#EXTM3U\n#EXTINF:2.5,\na.ts\n#EXTINF:x,\n#EXT-X-MAP:URI=\"i.mp4\"\n#EXTINF:4,t\nb.ts\n#EXTINF:9,\n#EXT-X-ENDLIST"
    master = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\nv.m3u8\n"
    rows = [("m", "https://h.example/m", "hls_playlist", media), ("s", "https://h.example/s", "hls_playlist", master)]
    spark.createDataFrame(rows, "manifest_id string, url string, kind string, body string").write.parquet(str(tmp_path / "given-texts"))
    found = pipelines.variants_from_corpus(spark.read.parquet(str(tmp_path / "given-texts")))
    assert not [f for f in found.filter("delivery = 'hls_segments'").inputFiles() if "given-texts" in f]
    by_id = {r["source_id"]: r for r in found.collect()}
    assert by_id["m"]["duration_seconds"] == 6.5 and by_id["m"]["is_live"] is False
    assert by_id["s"]["url"] == "https://h.example/v.m3u8"


def test_durations_without_addresses_are_those_of_the_segments(spark):
    bodies = ["#EXTM3U\n#EXTINF:1,\na\n\n  b \n#EXTINF:2\n#EXTINF:3,x\r\nc\n#EXTINF:9,", "#EXTM3U", "", None, "#EXTM3U\n#EXTINF:1e1,\nhttps://[x\n"]
    media = spark.createDataFrame([(str(i), "https://h.example/m", b) for i, b in enumerate(bodies)], "manifest_id string, url string, body string")
    sums = lambda rows: {r[0]: (r[1], r[2]) for r in rows.groupBy("manifest_id").agg({"duration": "sum", "*": "count"}).collect()}
    assert sums(hls.segment_durations(media)) == sums(hls.hls_segments(media))


def test_parts_start_from_playlists_written_once(spark, tmp_path):
    """Masters and media playlists of one corpus start from one written table; texts captured twice count once."""
    media = "#EXTM3U\n#EXT-X-MAP:URI=\"i.mp4\"\n#EXTINF:2.5,\na.ts\n"
    rows = [("m", "https://h.example/v.m3u8", "hls_playlist", media), ("m2", "https://h.example/v.m3u8", "hls_playlist", media),
            ("s", "https://h.example/s", "hls_playlist", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\nv.m3u8\n"), ("p", "https://h.example/p", "unknown", "x")]
    spark.createDataFrame(rows, "manifest_id string, url string, kind string, body string").write.parquet(str(tmp_path / "given-texts"))
    chosen = spark.createDataFrame([("a", "v", "https://h.example/s", "hls_segments"), ("b", "v", "https://h.example/v.m3u8", "hls_segments"), ("c", "v", "https://h.example/none", "hls_segments")], "source_id string, variant_id string, url string, delivery string")
    parts = pipelines.parts_of_variants(chosen, spark.read.parquet(str(tmp_path / "given-texts")))
    assert not [f for f in parts.inputFiles() if "given-texts" in f]
    got = sorted((r.source_id, r.ordinal, not r.is_init, r.uri, r.seconds) for r in parts.collect())
    assert got == [(s, 0, late, f"https://h.example/{u}", t) for s in "ab" for late, u, t in ((False, "i.mp4", None), (True, "a.ts", 2.5))]
