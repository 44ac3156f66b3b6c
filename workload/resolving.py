"""Resolution order, nested masters, and the column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.fixtures import dash as Dx
from mediasift.fixtures import hls as H
from mediasift.fixtures import traffic as T
from mediasift.fixtures.tables import table
from mediasift.functions import classify as K
from mediasift.functions.decoding import with_ascii_host
from mediasift.functions import headers as Hd
from mediasift.functions import manifests as M
from mediasift.functions import text as X
from mediasift.operators import hls as P
from mediasift.operators import registry as R
from mediasift.operators import variants as V
from mediasift.operators.written import written
from mediasift.plans import pipelines, table_functions
from mediasift.sources import readers

from .hls import SEGMENTS, VARIANTS
from .registry import ORACLES, query
from .traffic import ACCEPTED, CANDIDATES, R_CTE, accepted

C_CTE = f"{R_CTE}, c AS ({CANDIDATES})"


def probes(spark, sf_dir):
    """A probe for every other candidate: some files turn out to be playlists."""
    found = R.candidates(accepted(spark, sf_dir))
    n = F.length("candidate_key") + F.col("hit_count")
    return found, found.filter(n % 2 == 0).select(
        "url", F.when(n % 3 == 0, "application/x-mpegURL").otherwise("video/mp4").alias("content_type"), (n * 1000).alias("content_length")
    )


@query("reclassify_by_probe", f"""WITH {C_CTE}, n AS (SELECT *, length(candidate_key) + hit_count AS n FROM c)
SELECT candidate_key, CASE WHEN kind LIKE 'progressive%' AND n % 6 = 0 THEN 'hls_playlist' ELSE kind END AS resolve_kind FROM n""")
def reclassify_by_probe(spark, sf_dir):
    return V.reclassify_by_probe(*probes(spark, sf_dir)).select("candidate_key", "resolve_kind")


@query("progressive_variants", f"""WITH {C_CTE}, n AS (SELECT *, length(candidate_key) + hit_count AS n FROM c)
SELECT url, CASE kind WHEN 'progressive_audio' THEN 'audio_only' ELSE 'muxed' END AS track, CASE kind WHEN 'progressive_audio' THEN 'mp3' ELSE 'mp4' END AS container,
 CASE WHEN n % 2 = 0 THEN n * 1000 ELSE content_length END AS content_length FROM n WHERE kind LIKE 'progressive%'""")
def progressive_variants(spark, sf_dir):
    return V.progressive_variants(*probes(spark, sf_dir)).select("url", "track", "container", "content_length")


@query("resolve_with_fallback", f"""WITH {C_CTE}, n AS (SELECT *, length(candidate_key) + hit_count AS n, CAST(regexp_extract(page_url, '(\\d+)$', 1) AS INTEGER) AS p FROM c)
SELECT candidate_key, CASE WHEN n % 3 = 0 THEN 'native' WHEN p % 2 = 0 AND p % 5 <> 0 THEN 'extractor_page' WHEN n % 4 = 0 THEN 'extractor_url' ELSE 'unresolved' END AS resolved_by FROM n""")
def resolve_with_fallback(spark, sf_dir):
    found = R.candidates(accepted(spark, sf_dir))
    n = F.length("candidate_key") + F.col("hit_count")
    native = found.select(F.col("candidate_id").alias("source_id"), F.when(n % 3 == 0, 4).otherwise(0).alias("variant_count"))
    p = F.regexp_extract("page_url", r"(\d+)$", 1).cast("int")
    pages = found.filter(p % 2 == 0).select("page_url").distinct().select(
        "page_url", F.concat(F.lit("x"), "page_url").alias("source_id"), F.when(p % 5 != 0, 2).otherwise(0).alias("variant_count")
    )
    urls = found.filter(n % 4 == 0).select(F.col("url").alias("page_url"), F.lit("u").alias("source_id"), F.lit(1).alias("variant_count"))
    return V.resolve_with_fallback(native, pages.unionByName(urls), found).select("candidate_key", "resolved_by")


@query("nested_best", f"""WITH {VARIANTS}, s AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY bandwidth DESC, ordinal) AS k FROM variants WHERE iframe_only = 0),
outer_s AS (SELECT l_orderkey AS k FROM lineitem GROUP BY 1)
SELECT concat('outer-', o.k) AS manifest_id, s.uri AS playlist_uri, s.bandwidth AS nested_bandwidth
FROM outer_s o JOIN s ON s.manifest_id = concat('master-', o.k) AND s.k = 1
UNION ALL SELECT concat('outer-', o.k), concat('https://cdn.example.com/o/', o.k, '/master.m3u8?t=1'), NULL FROM outer_s o
 WHERE concat('master-', o.k) NOT IN (SELECT manifest_id FROM s)
UNION ALL SELECT manifest_id, uri, NULL FROM s""")
def nested_best(spark, sf_dir):
    """All streams of all masters and of a master over each of them, whose only stream is itself a master."""
    inner = H.masters(spark, sf_dir)
    outer = inner.select(
        F.regexp_replace("manifest_id", "master", "outer").alias("manifest_id"), F.concat("url", F.lit("&outer=1")).alias("url"),
        F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\nmaster.m3u8?t=1\n").alias("body"),
    )
    variants = P.hls_master_variants(inner.select("manifest_id", "url", "body").unionByName(outer))
    return P.nested_best(variants, inner).select("manifest_id", "playlist_uri", "nested_bandwidth")


LISTED = f"""v AS (SELECT source_id, variant_id, track, 'hls_segments' AS delivery, container, height, bandwidth, NULL::DOUBLE AS duration_seconds, 0 AS is_live, section * 1000000 + ordinal AS place FROM ({ORACLES["hls_resolve"]})
 UNION ALL SELECT concat('media-', l_orderkey), concat('media-', l_orderkey), 'muxed', 'hls_segments', 'mp4', NULL, NULL, sum(l_quantity), CAST(coalesce(max(o_orderstatus), '-') = 'O' AS INTEGER), 0
 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"""


@query("resolve_corpus", f"""WITH {LISTED}
SELECT source_id, variant_id, track, container, height, bandwidth, duration_seconds, is_live, delivery FROM v
UNION ALL SELECT source_id, variant_id, track, container, height, bandwidth, NULL, 0, 'dash' FROM ({ORACLES["dash_resolve"]})""")
def resolve_corpus(spark, sf_dir):
    """Masters, media playlists, DASH manifests and pages that are none of these, to what each offers."""
    corpus = H.corpus(spark, sf_dir).unionByName(Dx.manifests(spark, sf_dir).select("manifest_id", "url", F.lit(K.DASH).alias("kind"), "body"))
    rows = pipelines.variants_from_corpus(corpus)
    delivery = F.when(F.col("delivery").startswith("hls"), F.col("delivery")).otherwise("dash")
    duration = F.when(F.col("delivery") == "hls_segments", F.round("duration_seconds", 3))
    return rows.select(
        "source_id", "variant_id", "track", "container", "height", "bandwidth", duration.alias("duration_seconds"),
        F.col("is_live").cast("int").alias("is_live"), delivery.alias("delivery"),
    )


@query("plans_end_to_end", f"""WITH {LISTED},
b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(height, 0) * 1000000::BIGINT + least(coalesce(bandwidth, 0), 999999) DESC, place) AS k FROM v WHERE track IN ('muxed', 'video_only'))
SELECT source_id, variant_id AS video_id, track, delivery, container, CAST(track = 'video_only' AS INTEGER) AS needs_merge, duration_seconds, is_live,
 concat('downloads/', source_id, ' [', CASE WHEN height >= 2160 THEN '4K' WHEN height IS NULL THEN 'SD' ELSE concat(height, 'p') END, '].', container) AS output_path FROM b WHERE k = 1""")
def plans_end_to_end(spark, sf_dir):
    """Playlist texts to the plan of every source."""
    corpus = H.corpus(spark, sf_dir)
    sources = corpus.select(F.col("manifest_id").alias("source_id"), F.col("manifest_id").alias("title"), F.crc32(F.col("manifest_id").cast("binary")).alias("seq"))
    plans = V.make_plans(sources, pipelines.variants_from_corpus(corpus))
    return plans.select(
        "source_id", "video_id", "track", "delivery", "container", F.col("needs_merge").cast("int").alias("needs_merge"),
        F.round("duration_seconds", 3).alias("duration_seconds"), F.col("is_live").cast("int").alias("is_live"), "output_path",
    )


@query("parts_of_variants", f"""WITH {SEGMENTS},
m AS (SELECT manifest_id, map_uri, min(ordinal) AS ordinal FROM segments GROUP BY 1, 2),
p AS (SELECT manifest_id, ordinal, 0 AS is_init, uri, duration AS seconds FROM segments UNION ALL SELECT manifest_id, ordinal, 1, map_uri, NULL FROM m)
SELECT concat(w, '-', replace(manifest_id, 'media-', '')) AS source_id, ordinal, is_init, uri, seconds FROM p, (VALUES ('outer'), ('plain')) AS t(w)""")
def parts_of_variants(spark, sf_dir):
    """Every media playlist twice: named by a variant, and behind a nested master that also offers a worse stream."""
    media = written(H.media(spark, sf_dir))
    nested = media.select(
        F.regexp_replace("manifest_id", "media", "nested").alias("manifest_id"), F.regexp_replace("url", "media", "nested").alias("url"), "kind",
        F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\nworse.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=9\nmedia.m3u8\n#EXT-X-I-FRAME-STREAM-INF:BANDWIDTH=99,URI=\"trick.m3u8\"\n").alias("body"),
    )
    chosen = [
        lists.select(F.regexp_replace("manifest_id", old, new).alias("source_id"), F.lit("v").alias("variant_id"), "url", F.lit("hls_segments").alias("delivery"))
        for lists, old, new in ((nested, "nested", "outer"), (media, "media", "plain"))
    ]
    parts = pipelines.parts_of_variants(chosen[0].unionByName(chosen[1]), media.unionByName(nested).unionByName(media))
    return parts.select("source_id", "ordinal", F.col("is_init").cast("int").alias("is_init"), "uri", "seconds")


@query("sql_table_functions", f"""WITH d AS (SELECT * FROM ({ORACLES["dash_segments"]})), h AS (SELECT * FROM ({ORACLES["hls_parts"]}))
SELECT 'dash' AS source, manifest_id, count(*) AS n, count(DISTINCT uri) AS uris FROM d GROUP BY manifest_id
UNION ALL SELECT 'hls', manifest_id, count(*), count(DISTINCT uri) FROM h GROUP BY manifest_id""")
def sql_table_functions(spark, sf_dir):
    """Parts and segments of the whole corpus, asked for in SQL."""
    corpus = H.corpus(spark, sf_dir).unionByName(Dx.manifests(spark, sf_dir).select("manifest_id", "url", F.lit(K.DASH).alias("kind"), "body"))
    table_functions.register_table_functions(spark, corpus)
    return spark.sql(
        "SELECT 'dash' AS source, manifest_id, count(*) AS n, count(DISTINCT uri) AS uris FROM dash_segments() GROUP BY manifest_id"
        " UNION ALL SELECT 'hls', manifest_id, count(*), count(DISTINCT uri) FROM hls_parts() GROUP BY manifest_id"
    )


@query("decode_manifests", """
SELECT doc_id, kind, CASE kind WHEN 4 THEN concat('a', chr(65533), 'b') WHEN 5 THEN 'café €' WHEN 6 THEN 'テスト' ELSE coalesce(text, '') END AS body FROM documents, range(0, 7) AS t(kind)""")
def decode_manifests(spark, sf_dir):
    """All texts in charsets that Spark decodes and that it does not, with quotes, a name nobody knows and a broken byte."""
    text = F.coalesce("text", F.lit(""))
    forms = [
        (None, text.cast("binary")), (' "UTF-16LE" ', F.encode(text, "UTF-16LE")), ("no-such-charset", text.cast("binary")), ("utf-32-be", F.encode(text, "UTF-32")),
        ("UTF-8", F.lit(b"a\xffb")), ("windows-1252", F.lit(b"caf\xe9 \x80")), ("Shift_JIS", F.lit("テスト".encode("shift_jis"))),
    ]
    made = [F.struct(F.lit(i).alias("kind"), F.lit(c).cast("string").alias("charset"), data.alias("content")) for i, (c, data) in enumerate(forms)]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*made)).alias("f")).select("doc_id", "f.*")
    return readers.decode_manifest(rows).select("doc_id", "kind", "body")


@query("ascii_hosts", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'xn--mnchen-3ya.example' WHEN 1 THEN concat('cdn', p_partkey, '.example.com') WHEN 2 THEN 'xn--r8jz45g.xn--zckzah' END AS host FROM part""")
def ascii_hosts(spark, sf_dir):
    host = F.when(F.col("p_partkey") % 4 == 0, "münchen.example").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("cdn"), F.col("p_partkey").cast("string"), F.lit(".example.com"))).when(F.col("p_partkey") % 4 == 2, "例え.テスト")
    return with_ascii_host(table(spark, sf_dir, "part").select("p_partkey", host.alias("name")), "name", "host").select("p_partkey", "host")


@query("expand_templates", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('r', l_suppkey, '/', lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(6, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0'), '-', printf('%x', l_orderkey), '-$-',
 lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(5, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), ' '), '$Nope$', l_linenumber, '$end') AS name FROM lineitem""")
def expand_templates(spark, sf_dir):
    name = M.expand_template(
        F.concat(F.lit("$RepresentationID$/$Number%06d$-$Time%01x$-$$-$Bandwidth%5d$$Nope$"), F.col("l_linenumber").cast("string"), F.lit("$end")),
        F.concat(F.lit("r"), F.col("l_suppkey").cast("string")), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey"),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("name"))


@query("labels", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN q < 60 THEN concat('0:', lpad(CAST(q AS VARCHAR), 2, '0')) WHEN q < 3600 THEN concat(q // 60, ':', lpad(CAST(q % 60 AS VARCHAR), 2, '0'))
  ELSE concat(q // 3600, ':', lpad(CAST(q % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(q % 60 AS VARCHAR), 2, '0')) END AS duration,
 CASE WHEN h >= 4320 THEN '8K' WHEN h >= 2160 THEN '4K' ELSE concat(h, 'p') END AS resolution
FROM (SELECT *, CAST(l_quantity AS BIGINT) * 97 + 1 AS q, l_linenumber * 700 AS h FROM lineitem)""")
def labels(spark, sf_dir):
    seconds = F.col("l_quantity") * 97 + 1.25
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.fmt_duration(seconds).alias("duration"),
        X.resolution_label(F.lit(None).cast("int"), F.col("l_linenumber") * 700).alias("resolution"),
    )


@query("parse_numbers", """
SELECT p_partkey, p_size * 3600 + 90.5 AS iso, p_size * 60 + 7.25 AS clock, round(p_size * 1000 / 1001.0::DOUBLE, 6) AS rate, p_size AS width, 720 AS height,
 p_partkey AS range_start, p_partkey + 9 AS range_end, p_partkey AS asset, CASE WHEN p_partkey % 2 = 0 THEN lpad(printf('%X', p_partkey), 8, '0') END AS iv FROM part""")
def parse_numbers(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    hexed = F.lpad(F.hex("p_partkey"), 8, "0")
    bounds = X.range_bounds(F.concat(F.lit("Bytes="), key, F.lit("-"), (F.col("p_partkey") + 9).cast("string")))
    shape = X.resolution(F.concat(size, F.lit("X720")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.iso_seconds(F.concat(F.lit("PT"), size, F.lit("H1M30.5S"))).alias("iso"),
        X.clock_seconds(F.concat(F.lit("0:"), F.lpad(size, 2, "0"), F.lit(":07.25"))).alias("clock"),
        F.round(X.frame_rate(F.concat(size, F.lit("000/1001"))), 6).alias("rate"), shape["width"].alias("width"), shape["height"].alias("height"),
        bounds["start"].alias("range_start"), bounds["end"].alias("range_end"),
        X.asset_length(F.concat(F.lit("bytes 0-1/"), key), F.lit("5")).alias("asset"),
        F.hex(X.hex_bytes(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0x"), hexed)).otherwise(F.substring(hexed, 1, 7)))).alias("iv"),
    )


@query("codec_content", """
SELECT l_returnflag, l_linestatus, l_linenumber % 3 AS k, count(*) AS n, CAST(l_linenumber % 3 <> 1 AS INTEGER) AS video, CAST(l_linenumber % 3 <> 0 AS INTEGER) AS audio,
 CASE l_returnflag WHEN 'A' THEN 'Widevine' WHEN 'N' THEN 'DRM' END AS hls_system, CASE l_linestatus WHEN 'F' THEN 'PlayReady' END AS dash_system,
 CASE l_linenumber % 3 WHEN 0 THEN 'refused' WHEN 1 THEN 'retryable' ELSE 'success' END AS status FROM lineitem GROUP BY ALL""")
def codec_content(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    codecs = F.when(k == 0, 'HVC1.1, "vp09.00"').when(k == 1, "text, mp4a.40.2").otherwise("avc1.4d,ac-3")
    flag = F.col("l_returnflag")
    method = F.when(flag == "R", "AES-128").otherwise("SAMPLE-AES")
    fmt = F.when(flag == "A", "com.Widevine")
    scheme = F.when(F.col("l_linestatus") == "F", "URN:UUID:9A04F079-9840-4286-AB92-E65BE0885F95").otherwise("urn:other")
    code = F.when(k == 0, 403).when(k == 1, 503).otherwise(206)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", k.alias("k"), K.has_video(codecs).cast("int").alias("video"), K.has_audio(codecs).cast("int").alias("audio"),
        K.hls_drm(method, fmt).alias("hls_system"), K.dash_drm(scheme).alias("dash_system"), K.status_class(code).alias("status"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("request_context", f"""WITH {R_CTE}
SELECT request_id, CASE WHEN request_id % 2 = 0 THEN 'https://ref.example.com/' ELSE page_url END AS referer, regexp_extract(page_url, '^https://[^/]*', 0) AS origin,
 CASE WHEN cookie IS NOT NULL THEN cookie END AS cookie, 'authorization,x-a' AS authenticating, 'accept,authorization,x-a' AS extra FROM r""")
def request_context(spark, sf_dir):
    rows = T.responses(spark, sf_dir)
    headers = F.create_map(
        F.lit(":authority"), F.lit("h"), F.lit("Accept"), F.lit("*/*"), F.lit("AUTHORIZATION"), F.lit("b"), F.lit("X-A"), F.lit("1"),
        F.lit("x-client-data"), F.lit("z"), F.lit("If-Range"), F.lit("e"), F.lit("Cookie"), F.coalesce("cookie", F.lit("")),
        F.lit("Referer"), F.when(F.col("request_id") % 2 == 0, F.lit("https://ref.example.com/")).otherwise(F.lit("")),
    )
    rows = rows.withColumn("c", Hd.request_context(Hd.lower_keys(headers), F.col("page_url")))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return rows.select(
        "request_id", "c.referer", "c.origin", "c.cookie", names(Hd.authenticating_headers(F.col("c.extra"))).alias("authenticating"),
        names(F.col("c.extra")).alias("extra"),
    )


@query("safe_names", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CON_' WHEN 1 THEN concat(p_name, ' x y') WHEN 2 THEN 'video' ELSE repeat('ab', 60) END AS name,
 concat(p_partkey, ' é') AS from_url FROM part""")
def safe_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit("CON")).when(k == 1, F.concat(F.lit(" .."), "p_name", F.lit(':\t x<>|y. '))).when(k == 2, F.lit("..:?")).otherwise(F.lit("ab" * 90))
    url = F.concat(F.lit("https://h.example.com/d/"), F.col("p_partkey").cast("string"), F.lit("%20%C3%A9.mp4?x=1"))
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_name(raw).alias("name"), X.name_from_url(url).alias("from_url"))
