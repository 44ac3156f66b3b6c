"""Names, keys, ranks and joins on inputs that repeat, collide or tie."""

import random
import re

from pyspark.sql import functions as F

from mediasift.functions import urls
from mediasift.operators import dash, extractor, files, hls, inspection, jobs, variants
from mediasift.plans import pipelines
from mediasift.sinks import writers


def test_spellings_of_one_address_share_a_key(spark):
    rows = [("https://h.com/a/../b.mp4",), ("https://H.com/b.mp4#x",), ("https://h.com/b%20c.mp4",), ("https://h.com/b c.mp4",), ("https://Me:Pw@h.com/b.mp4",)]
    got = [r[0] for r in spark.createDataFrame(rows, "url STRING").select(urls.candidate_key("url")).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == "https://Me:Pw@h.com/b.mp4"


def test_names_are_unique_and_never_taken(spark):
    def check(paths, existing):
        df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path STRING, seq BIGINT")
        there = spark.createDataFrame([(e,) for e in existing], "path STRING")
        got = [r.unique_path for r in variants.unique_names(df, "path", "seq", there).orderBy("seq").collect()]
        lower = [g.lower() for g in got]
        assert len(set(lower)) == len(paths) and not set(lower) & {e.lower() for e in existing}
        return got

    assert check(["a.mp4", "a.mp4", "a (2).mp4"], []) == ["a.mp4", "a (3).mp4", "a (2).mp4"]
    assert check(["b.mp4"], ["b (2).mp4"]) == ["b.mp4"]
    assert check(["c.mp4", "C.mp4", "c.mp4"], ["c.mp4", "c (3).mp4"]) == ["c (2).mp4", "C (4).mp4", "c (5).mp4"]
    rng = random.Random(4)
    names = [f"x{n}{e}" for n in ("", " (2)", " (3)", " (2) (2)", " (7)") for e in (".mp4", "")]
    for _ in range(3):
        check([rng.choice(names) for _ in range(60)], [rng.choice(names) for _ in range(6)])


def test_video_ranks_are_row_numbers(spark):
    rng = random.Random(7)
    rows = [(f"s{i % 2}", i, rng.choice([None, 718, 719, 720, 721]), rng.choice([None, 0, 1, 19_999, 20_000, 999_998, 999_999, 2_000_000])) for i in range(400)]
    df = spark.createDataFrame(rows, "source_id STRING, ordinal BIGINT, height INT, bandwidth BIGINT").withColumn("track", F.lit("muxed"))
    got = {(r.source_id, r.ordinal): r.video_rank for r in variants.rank_videos(df).collect()}
    for source in ("s0", "s1"):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (-((r[2] or 0) * 1_000_000 + min(r[3] or 0, 999_999)), r[1]))
        assert [got[source, r[1]] for r in own] == list(range(1, len(own) + 1))


def test_a_file_has_one_verdict(spark):
    sums = spark.createDataFrame([("l1", 0, "00", "a.bin", "a.bin"), ("l2", 0, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", "A.bin", "a.bin")], "list_id STRING, line_no INT, sha256 STRING, name STRING, name_key STRING")
    one = spark.createDataFrame([("A.BIN", bytearray(b"a")), ("b", bytearray(b"b"))], "name STRING, content BINARY")
    assert sorted((r.name, r.verdict) for r in files.verify_checksums(one, sums).collect()) == [("A.BIN", "match"), ("b", "unlisted")]
    of_list = one.limit(1).select("name", "content", F.explode(F.array(F.lit("l1"), F.lit("l2"), F.lit("l3"))).alias("list_id"))
    assert {r.list_id: r.verdict for r in files.verify_checksums(of_list, sums).collect()} == {"l1": "mismatch", "l2": "match", "l3": "unlisted"}


def test_second_probes_and_answers_multiply_nothing(spark):
    found = spark.createDataFrame([("c", "https://h/v.mp4", "progressive_video", 5, "https://h/page")], "candidate_id STRING, url STRING, kind STRING, content_length BIGINT, page_url STRING")
    probes = spark.createDataFrame([("https://h/v.mp4", "video/mp4", 7, 1), ("https://h/v.mp4", "application/vnd.apple.mpegurl", 9, 2)], "url STRING, content_type STRING, content_length BIGINT, ts INT")
    assert [r.content_length for r in variants.progressive_variants(found, probes).collect()] == [9]
    assert [r.resolve_kind for r in variants.reclassify_by_probe(found, probes).collect()] == ["hls_playlist"]
    native = spark.createDataFrame([("c", 0)], "source_id STRING, variant_count INT")
    answers = spark.createDataFrame([("https://h/page", "x", 1), ("https://h/page", "y", 3)], "page_url STRING, source_id STRING, variant_count INT")
    assert [(r.resolved_by, r.source_id) for r in variants.resolve_with_fallback(native, answers, found).collect()] == [("extractor_page", "y")]


def test_pages_with_one_extractor_id_stay_apart(spark):
    body = '{"id":"same","formats":[{"format_id":"f","url":"https://h/v","vcodec":"h264","acodec":"aac","height":720}]}'
    dumps = spark.createDataFrame([("https://h/1", body), ("https://h/2", body), ("https://h/2", body)], "page_url STRING, body STRING")
    got = extractor.extractor_variants(extractor.read_extractor_dumps(dumps)).collect()
    assert sorted(r.page_url for r in got) == ["https://h/1", "https://h/2"]


def test_timeline_pieces_join_up(spark, monkeypatch):
    monkeypatch.setattr(dash, "TIMELINE_PIECE", 3)
    rng = random.Random(1)
    rows, expected = [], []
    for i in range(30):
        s = [(rng.choice([None, None, None, str(rng.randrange(1000))]), str(rng.randrange(1, 9)), rng.choice([None, "2", "-1"])) for _ in range(rng.randrange(0, 14))]
        clock = count = 0
        runs = []
        for t, d, r in s:
            start, repeats = int(t) if t else clock, max(int(r or 0), 0) + 1
            runs.append((start, int(d), repeats, count))
            clock, count = start + int(d) * repeats, count + repeats
        rows.append((i, s))
        expected.append(runs)
    df = spark.createDataFrame(rows, "i INT, s ARRAY<STRUCT<_t: STRING, _d: STRING, _r: STRING>>").orderBy("i")
    got = [[tuple(x) for x in r[0]] for r in df.select(dash.timeline_clock(F.col("s"))).collect()]
    assert got == expected


def test_a_run_of_millions_is_counted_out(spark):
    mpd = '<MPD type="static"><Period><AdaptationSet><SegmentTemplate media="$Time$.m4s"><SegmentTimeline><S t="0" d="1" r="2999999"/></SegmentTimeline></SegmentTemplate><Representation id="a" bandwidth="9"/></AdaptationSet></Period></MPD>'
    df = spark.createDataFrame([("d", "https://h.com/d.mpd", mpd)], "manifest_id STRING, url STRING, body STRING")
    parts = dash.dash_segments(dash.dash_representations(dash.parse_manifests(df)))
    assert tuple(parts.agg(F.count("*"), F.min("ordinal"), F.max("ordinal"), F.countDistinct("ordinal")).first()) == (3_000_000, 0, 2_999_999, 3_000_000)
    shares = [r.n for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(shares) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(shares) < 1_500_000


def test_short_and_long_runs_of_one_timeline(spark, monkeypatch):
    monkeypatch.setattr(dash, "RUN_BLOCK", 4)
    monkeypatch.setattr(dash, "RUNS_TOGETHER", 2)
    repeats = [0, 3, 4, 11, -1, 7, 2, 0, 0, 12]
    s = "".join(f'<S d="{i + 1}" r="{r}"/>' for i, r in enumerate(repeats))
    mpd = f'<MPD type="static"><Period><AdaptationSet><SegmentTemplate initialization="i.mp4" media="$Number$-$Time$.m4s"><SegmentTimeline>{s}</SegmentTimeline></SegmentTemplate><Representation id="a" bandwidth="9"/></AdaptationSet></Period></MPD>'
    df = spark.createDataFrame([("d", "https://h.com/d.mpd", mpd)], "manifest_id STRING, url STRING, body STRING")
    expected, clock = [(-1, "https://h.com/i.mp4", True)], 0
    for i, r in enumerate(repeats):
        for _ in range(max(r, 0) + 1):
            expected.append((len(expected) - 1, f"https://h.com/{len(expected)}-{clock}.m4s", False))
            clock += i + 1
    parts = dash.dash_segments(dash.dash_representations(dash.parse_manifests(df)))
    assert sorted(tuple(r) for r in parts.select("ordinal", "uri", "is_init").collect()) == expected


FETCHES = "host STRING, ts TIMESTAMP, route STRING, status INT, headers MAP<STRING,STRING>, request_id INT, attempt INT, retry_after_s INT"


def test_only_what_follows_a_refusal_counts(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("h", at(0), "browser", 200, {}, 1, 0, None), ("h", at(1), "direct", 403, {"A": "b"}, 2, 0, None), ("h", at(2), "direct", 403, {}, 2, 1, None),
        ("h", at(3), "browser", 200, {}, 3, 0, None), ("h", at(4), "direct", 503, {}, 4, 0, None), ("h", at(5), "direct", 200, {}, 4, 1, None),
        ("k", at(0), "browser", 200, {}, 5, 0, None), ("k", at(1), "direct", 403, {}, 6, 0, None), ("k", at(2), "direct", 200, {}, 7, 0, None),
    ]
    log = spark.createDataFrame(rows, FETCHES)
    routes = {(r.host, r.ts.second): r.expected_route for r in jobs.route_hosts(log).collect()}
    assert [routes["h", s] for s in range(6)] == ["direct"] * 4 + ["browser"] * 2 and routes["k", 2] == "direct"
    assert {r.host: r.browser_outcome for r in jobs.refusal_diagnosis(log).collect()} == {"h": "browser_succeeded", "k": "not_tried"}
    audit = {(r.request_id, r.attempt): (r.expected_delay_s, r.too_early) for r in jobs.retry_audit(log).collect()}
    assert audit[2, 1] == (None, False) and audit[4, 1] == (0.4, False)


PLAYLIST = "#EXTM3U\n#EXT-X-TARGETDURATION:5\n#EXTINF:5,\na.ts\n#EXTINF:4.5,\nb.ts\n"


def test_corpus_of_media_playlists_and_two_periods(spark):
    mpd = "<MPD><Period><AdaptationSet contentType='video'><Representation id='a' bandwidth='9' height='10'/></AdaptationSet></Period><Period><AdaptationSet contentType='video'><Representation id='b' bandwidth='8' height='20'/></AdaptationSet></Period></MPD>"
    rows = [("vod", "https://h.com/v.m3u8", "hls_playlist", PLAYLIST + "#EXT-X-ENDLIST\n"), ("live", "https://h.com/l.m3u8", "hls_playlist", PLAYLIST), ("d", "https://h.com/d.mpd", "dash_manifest", mpd)]
    corpus = spark.createDataFrame(rows, "manifest_id STRING, url STRING, kind STRING, body STRING")
    got = {(r.source_id, r.track, r.is_live, r.duration_seconds, r.delivery, r.container) for r in pipelines.variants_from_corpus(corpus).collect() if r.source_id != "d"}
    assert got == {("vod", "muxed", False, 9.5, "hls_segments", "mp4"), ("live", "muxed", True, 9.5, "hls_segments", "mp4")}
    assert sorted(r.height for r in pipelines.variants_from_corpus(corpus).collect() if r.source_id == "d") == [10, 20]


def test_candidates_resolve_end_to_end(spark):
    drm = '#EXTM3U\n#EXT-X-TARGETDURATION:5\n#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://k",KEYFORMAT="com.widevine"\n#EXTINF:5,\na.ts\n#EXT-X-ENDLIST\n'
    rows = [
        ("file", "https://h.com/f.mp4", "progressive_video", "https://h.com/p1"), ("list", "https://h.com/v.m3u8", "hls_playlist", "https://h.com/p1"),
        ("moved", "https://h.com/m.mp4", "progressive_video", "https://h.com/p1"), ("drm", "https://d.com/x/d.m3u8", "hls_playlist", "https://h.com/p2"),
        ("page", "https://h.com/p3", "page_embed", "https://h.com/p3"), ("none", "https://n.com/q.m3u8", "hls_playlist", "https://h.com/p4"),
    ]
    found = spark.createDataFrame([(*r, 1, None) for r in rows], "candidate_id STRING, url STRING, kind STRING, page_url STRING, content_length BIGINT, candidate_key STRING").withColumn("candidate_key", F.col("url"))
    texts = [("https://h.com/v.m3u8", "hls_playlist", PLAYLIST), ("https://h.com/m.mp4", "hls_playlist", PLAYLIST), ("https://d.com/x/d.m3u8", "hls_playlist", drm)]
    manifests = spark.createDataFrame([(u, *x) for u, *x in [(t[0], *t) for t in texts]], "manifest_id STRING, url STRING, kind STRING, body STRING")
    probes = spark.createDataFrame([("https://h.com/m.mp4", "application/vnd.apple.mpegurl", 3)], "url STRING, content_type STRING, content_length BIGINT")
    dumps = spark.createDataFrame([("https://h.com/p3", '{"id":"z","url":"https://h.com/z.mp4"}')], "page_url STRING, body STRING")
    resolved, offered = pipelines.resolve_candidates(found, manifests, probes, dumps)
    assert {r.candidate_id: r.resolved_by for r in resolved.collect()} == {"file": "native", "list": "native", "moved": "native", "drm": "native", "page": "extractor_url", "none": "unresolved"}
    assert sorted((r.source_id, r.track) for r in offered.collect()) == [("file", "muxed"), ("list", "muxed"), ("moved", "muxed"), ("page", "muxed")]


def test_log_days_replace_themselves(spark, tmp_path):
    import datetime as dt

    entries = spark.createDataFrame([(dt.datetime(2024, 1, 1), "INFO", "http", "x")], "ts TIMESTAMP, level STRING, source STRING, message STRING")
    for _ in range(2):
        writers.write_log(entries, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 1


def test_streams_of_an_inspection(spark):
    body = "\n".join([
        "Input #0, mov, from 'x: y.mp4':", "  Duration: 00:01:02.50, start: 0.0, bitrate: 9 kb/s", "  Stream #0:0[0x1](und): Video: h264 (High) (avc1 / 0x31), yuv420p(tv, bt709), 1920x1080 [SAR 1:1 DAR 16:9], 4500 kb/s, 30 fps (default)",
        "  Stream #0:1(eng): Audio: aac (LC), 44100 Hz, stereo, fltp, 128 kb/s", "  Stream #0:2: Video: mjpeg, yuvj420p, 90x90, 90k tbr (attached pic)", "  Stream #0:3: Subtitle: mov_text", "  Stream #0:4: Data: none",
    ])
    df = spark.createDataFrame([("j", body)], "job_id STRING, body STRING")
    streams = inspection.parse_inspections(df)
    got = [(r.type, r.codec, r.width, r.height, r.sample_rate, r.channels, r.kbps) for r in streams.orderBy("stream_no").collect()]
    assert got == [("video", "h264", 1920, 1080, None, None, 4500), ("audio", "aac", None, None, 44100, "stereo", 128), ("subtitle", "mov_text", None, None, None, None, None)]
    assert inspection.inspection_reports(df, streams).first().duration_seconds == 62.5


def test_nothing_secret_is_left_in_a_text(spark):
    from mediasift.functions import redaction

    secrets = ["s3cr3tvalue", "Q1w2E3r4T5y6U7i8O9p0aaa", "carla"]
    text = f"see https://h.com/a?token={secrets[0]}&q=1#f, 'http://h.com/?x={secrets[1]}' and Cookie: a={secrets[0]}\nC:\\Users\\{secrets[2]}\\f.txt \"C:\\\\Users\\\\{secrets[2]}\\\\g\" x-api-key :{secrets[0]} plain: kept"
    got = spark.createDataFrame([(text,)], "t STRING").select(redaction.redact_text(F.col("t")), redaction.leaks(redaction.redact_text(F.col("t")))).first()
    assert not any(s in got[0] for s in secrets) and not got[1]
    assert "q=1" in got[0] and re.search(r"see https://h\.com/a\?token=\[redigido\]&q=1 '", got[0]) and "f.txt" in got[0]
