"""Rules of the column expressions, one table of cases per rule."""

from pyspark.sql import functions as F

from mediasift.functions import classify as K
from mediasift.functions import manifests as M
from mediasift.functions import redaction as R
from mediasift.functions import sql
from mediasift.functions import text as X
from mediasift.functions import urls as U


def results(spark, schema, cases, expression):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i INT, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression.alias("r")).collect()]


def check(spark, schema, table, expression):
    assert results(spark, schema, [c[:-1] for c in table], expression) == [c[-1] for c in table]


def test_resolve(spark):
    base = "https://H.example.com/a/b/c.m3u8?x=1"
    check(spark, "ref STRING, base STRING", [
        ("d.ts", base, "https://h.example.com/a/b/d.ts"),
        ("../d.ts?y=2", base, "https://h.example.com/a/d.ts?y=2"),
        ("./../../../d.ts", base, "https://h.example.com/d.ts"),
        ("/r/d.ts", base, "https://h.example.com/r/d.ts"),
        ("//o.example.com:443/d.ts", base, "https://o.example.com/d.ts"),
        ("?z=3", base, "https://h.example.com/a/b/c.m3u8?z=3"),
        ('"HTTP://UP.example.com"', base, "http://up.example.com/"),
        ("sp ace.ts", base, "https://h.example.com/a/b/sp%20ace.ts"),
        ("é.ts", base, "https://h.example.com/a/b/%C3%A9.ts"),
        ("  ", base, None),
        (None, base, None),
    ], U.resolve_url("ref", "base"))


def test_candidate_key(spark):
    check(spark, "u STRING", [
        ("https://H.com/v.mp4?token=1&b=2&a=1#f", "https://h.com/v.mp4?a=1&b=2"),
        ("https://h.com/v.mp4?Range=0-1&SIG=x", "https://h.com/v.mp4"),
        ("https://h.com/v.mp4?tokens=1", "https://h.com/v.mp4?tokens=1"),
        ("https://h.com", "https://h.com/"),
        ("https://h.com/v?B=1&a=2&_=9", "https://h.com/v?B=1&a=2"),
    ], U.candidate_key("u"))


def test_family_key(spark):
    check(spark, "u STRING", [
        ("https://h.com/a/b/1.ts?x", "h.com/a/b"), ("https://h.com/1.ts", "h.com/1.ts"), ("https://H.com:8080/a/", "h.com/a"),
    ], U.family_key("u"))


def test_classify(spark):
    check(spark, "u STRING, m STRING", [
        ("https://h.com/a.m3u8", "text/plain", K.HLS),
        ("https://h.com/a.M3U8", None, K.UNKNOWN),
        ("https://h.com/a.MP4", None, K.VIDEO),
        ("https://h.com/a.mp4", "video/iso.segment", K.SEGMENT),
        ("https://h.com/a.mp4", "audio/mp4", K.AUDIO),
        ("https://h.com/00042.mp4", None, K.SEGMENT),
        ("https://h.com/x-init.mp4", None, K.SEGMENT),
        ("https://h.com/media-1.2.mp4", None, K.SEGMENT),
        ("https://h.com/media-1.mp4", None, K.VIDEO),
        ("https://h.com/get?file=movie.mp4%3Fa", None, K.VIDEO),
        ("https://h.com/x.ism/Manifest", None, K.SMOOTH),
        ("https://h.com/x", " Application/DASH+xml ; a=b", K.DASH),
        ("https://ads.doubleclick.net/a.mp4", "video/mp4", K.UNKNOWN),
        ("https://h.com/preroll/a.mp4", None, K.UNKNOWN),
        ("blob:https://h.com/1", "video/mp4", K.UNKNOWN),
    ], K.classify(F.col("u"), F.col("m")))


def test_drm(spark):
    check(spark, "m STRING, f STRING", [
        ("SAMPLE-AES", None, "DRM"), ("SAMPLE-AES", "other", None), ("AES-128", "com.widevine", None), ("NONE", None, None),
        ("SAMPLE-AES", "com.apple.streamingkeydelivery", "FairPlay"), ("SAMPLE-AES-CTR", "urn:uuid:EDEF8BA9-79D6", "Widevine"),
    ], K.hls_drm(F.col("m"), F.col("f")))


def test_redaction(spark):
    token = "aB3" * 8
    cases = [
        ("GET https://H.com/a?token=1&q=2#x end", "GET https://h.com/a?token=[redigido]&q=2 end"),
        (f"https://h.com/a?s={token}", "https://h.com/a?s=[redigido]"),
        ("https://h.com/a?e=1792333176", "https://h.com/a?e=1792333176"),
        (f"tail p.m3u8?e=1&s={token}", "tail p.m3u8?e=1&s=[redigido]"),
        ("Cookie: a=b; c=d", "Cookie: [redigido]"),
        ("path/cookie: stays", "path/cookie: stays"),
        ("C:\\Users\\Someone\\x.mp4", "%USERPROFILE%\\x.mp4"),
        ("plain text", "plain text"),
        (None, ""),
    ]
    check(spark, "t STRING", cases, R.redact_text(F.col("t")))
    twice = results(spark, "t STRING", [(c[1],) for c in cases], R.redact_text(F.col("t")))
    assert twice == [c[1] for c in cases]
    assert not any(results(spark, "t STRING", [(c[1],) for c in cases], R.leaks(F.col("t"))))


def test_attributes(spark):
    text = 'BANDWIDTH=1, CODECS="a,b=c",empty=,name="x",NAME="y"'
    got = results(spark, "t STRING", [(text,)], M.attr_map(F.col("t")))[0]
    assert got == {"BANDWIDTH": "1", "CODECS": "a,b=c", "EMPTY": "", "NAME": "y"}


def test_template(spark):
    check(spark, "t STRING", [
        ("$RepresentationID$/$Number%05d$.m4s", "v1/00007.m4s"), ("a$$b", "a$b"), ("$Time%x$", "255"), ("$Unknown$", "$Unknown$"),
        ("x$open", "x$open"), ("plain", "plain"), ("$Number%d$", "7"), ("$Bandwidth%03X$", "064"),
    ], M.expand_template(F.col("t"), F.lit("v1"), F.lit(100), F.lit(7), F.lit(255)))
    assert results(spark, "t STRING", [("$Time%2x$",)], M.expand_template(F.col("t"), F.lit("v"), F.lit(1), F.lit(1), F.lit(255))) == ["ff"]


def test_numbers(spark):
    check(spark, "t STRING", [("PT1H2M3.5S", 3723.5), ("P1DT1S", 86401.0), ("-PT5S", -5.0), ("PT", None), ("PT10M", 600.0), ("x", None)],
          X.iso_seconds(F.col("t")))
    check(spark, "t STRING", [("30000/1001", 30000 / 1001), ("25", 25.0), ("1/0", None), ("1d", None), ("NaN", None)], X.frame_rate(F.col("t")))
    check(spark, "t STRING", [("0x0AFF", "0AFF"), ("ABC", None), ("", None)], F.hex(X.hex_bytes(F.col("t"))))
    check(spark, "b BIGINT", [(None, "-"), (0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (10 * 1024, "10 KB"), (5 << 40, "5.0 TB")],
          X.fmt_bytes(F.col("b")))
    check(spark, "b BIGINT", [(None, 268435456), (1, 268435456), (1 << 30, int((1 << 30) * 2.2)), (2 ** 63 - 1, 2 ** 63 - 1)],
          X.required_bytes(F.col("b")))


def test_names(spark):
    check(spark, "t STRING", [("a:b?c", "a b c"), (" .. ", "video"), ("nul", "nul_"), ("x" * 130, "x" * 120), (None, "video")],
          X.safe_name(F.col("t")))


def test_sql_functions_equal_the_expressions(spark):
    sql.register_sql_functions(spark)
    row = spark.sql(
        "SELECT classify(u, 'video/mp4') a, candidate_key(u) b, family_key(u) c, redact_text(u) d, stable_id(u) e,"
        " expand_template('$Number%03d$', 'r', 1L, 7L, 0L) f FROM VALUES ('https://h.com/a/x.mp4?token=1&q=2') t(u)"
    ).first()
    assert row[:4] == (K.VIDEO, "https://h.com/a/x.mp4?q=2", "h.com/a", "https://h.com/a/x.mp4?token=[redigido]&q=2")
    assert len(row.e) == 16 and row.f == "007"
