"""HLS queries, checked against the line items the texts were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.fixtures import hls as H
from mediasift.operators import hls as P

from .registry import query

ITEMS = f"i AS ({H.ITEMS_SQL.format(lineitem='lineitem')})"
VARIANTS = f"""{ITEMS},
v AS (SELECT l_orderkey, ordinal, l_partkey, l_returnflag, l_partkey % 7 = 0 AS trick,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS bandwidth,
 CASE WHEN l_partkey % 7 <> 0 AND l_partkey % 2 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) - 7 END AS avg_bandwidth,
 CASE WHEN l_partkey % 7 <> 0 AND l_returnflag <> 'R' THEN [360, 720, 1080, 2160][l_linenumber % 4 + 1] END AS height
 FROM i),
variants AS (SELECT concat('master-', l_orderkey) AS manifest_id,
 5 + 2 * (ordinal - 1) + CASE WHEN trick THEN 0 ELSE 1 END AS ordinal,
 concat('https://cdn.example.com/o/', l_orderkey, '/', CASE WHEN trick THEN concat('trick/', l_partkey, '.m3u8')
   ELSE concat('v/', l_partkey, '.m3u8?s=', ordinal) END) AS uri,
 bandwidth, avg_bandwidth, CAST(floor(height * 16 / 9.0) AS INTEGER) AS width, height,
 CASE WHEN trick THEN NULL WHEN l_returnflag = 'A' THEN 'avc1.640028,mp4a.40.2' WHEN l_returnflag = 'N' THEN 'hvc1.1.6' END AS codecs,
 CASE WHEN NOT trick AND l_returnflag = 'N' THEN 'aud' END AS audio_group,
 CAST(trick AS INTEGER) AS iframe_only FROM v)"""


@query("hls_split", f"""
SELECT 'master' AS playlist_role, count(DISTINCT l_orderkey) AS n FROM lineitem
UNION ALL SELECT 'media', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'reject', count(*) FROM orders WHERE o_orderkey % 10 = 0""")
def hls_split(spark, sf_dir):
    return P.split_playlists(H.corpus(spark, sf_dir)).groupBy("playlist_role").agg(F.count("*").alias("n"))


@query("hls_variants", f"WITH {VARIANTS} SELECT * FROM variants")
def hls_variants(spark, sf_dir):
    masters = P.split_playlists(H.masters(spark, sf_dir)).filter("playlist_role = 'master'")
    return P.hls_master_variants(masters).select(
        "manifest_id", "ordinal", "uri", "bandwidth", "avg_bandwidth", "width", "height", "codecs",
        "audio_group", F.col("iframe_only").cast("int").alias("iframe_only"),
    )


RENDITIONS = """renditions AS (
 SELECT concat('master-', o.k) AS manifest_id, r.*, CASE r.ordinal
   WHEN 2 THEN 'https://cdn.example.com/o/audio/en.m3u8' WHEN 3 THEN 'https://cdn.example.com/abs/de.m3u8'
   ELSE concat('https://cdn.example.com/o/', o.k, '/subs/pt.m3u8') END AS uri
 FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o,
  (VALUES (2, 'AUDIO', 'aud', 'English, main', 'en', 1, '6'), (3, 'AUDIO', 'aud', 'Deutsch', 'de', 0, '2'),
          (4, 'SUBTITLES', 'subs', 'Legenda', 'pt', 0, NULL)) r(ordinal, type, group_id, name, language, is_default, channels))"""


@query("hls_renditions", f"WITH {RENDITIONS} SELECT * FROM renditions")
def hls_renditions(spark, sf_dir):
    return P.hls_renditions(H.masters(spark, sf_dir)).select(
        "manifest_id", "ordinal", "type", "group_id", "name", "language",
        F.col("is_default").cast("int").alias("is_default"), "channels", "uri",
    )


@query("hls_resolve", f"""WITH {VARIANTS}, {RENDITIONS},
flags AS (SELECT manifest_id, bool_or(height IS NOT NULL OR codecs IS NOT NULL) AS vouched FROM variants WHERE iframe_only = 0 GROUP BY 1),
s AS (SELECT v.*, codecs IS NULL AND height IS NULL AND vouched AS audio FROM variants v JOIN flags USING (manifest_id) WHERE iframe_only = 0)
SELECT manifest_id AS source_id, 0 AS section, ordinal, left(sha256(uri), 16) AS variant_id,
 CASE WHEN audio THEN 'audio_only' WHEN audio_group IS NOT NULL THEN 'video_only' ELSE 'muxed' END AS track,
 height, coalesce(avg_bandwidth, bandwidth) AS bandwidth, CASE WHEN audio THEN 'Audio' END AS name, audio_group,
 CASE WHEN audio THEN 'm4a' ELSE 'mp4' END AS container FROM s
UNION ALL SELECT manifest_id, CASE type WHEN 'AUDIO' THEN 1 ELSE 2 END, ordinal, left(sha256(uri), 16),
 CASE type WHEN 'AUDIO' THEN 'audio_only' ELSE 'subtitle' END, NULL, NULL,
 CASE WHEN ordinal = 2 THEN 'English, main 6ch (default)' ELSE name END,
 CASE type WHEN 'AUDIO' THEN group_id END, CASE type WHEN 'AUDIO' THEN 'm4a' ELSE 'vtt' END FROM renditions""")
def hls_resolve(spark, sf_dir):
    masters = H.masters(spark, sf_dir)
    return P.hls_resolve(P.hls_master_variants(masters), P.hls_renditions(masters)).select(
        "source_id", "section", "ordinal", "variant_id", "track", "height", "bandwidth", "name", "audio_group", "container"
    )


SEGMENTS = f"""{ITEMS},
f AS (SELECT *, lag(l_returnflag) OVER w AS prev_flag, lag(l_linestatus) OVER w AS prev_status
 FROM i WINDOW w AS (PARTITION BY l_orderkey ORDER BY ordinal)),
k AS (SELECT *, max(CASE WHEN prev_flag IS NULL OR prev_flag <> l_returnflag THEN ordinal END) OVER
 (PARTITION BY l_orderkey ORDER BY ordinal) AS key_at,
 CASE WHEN ordinal % 2 = 0 THEN ordinal * 5000 END AS given, l_partkey + 1000 AS len FROM f),
g AS (SELECT k.*, owner.l_partkey AS key_part, count(given) OVER
 (PARTITION BY k.l_orderkey, k.l_suppkey % 3 ORDER BY k.ordinal) AS run
 FROM k JOIN i owner ON owner.l_orderkey = k.l_orderkey AND owner.ordinal = k.key_at),
b AS (SELECT *, coalesce(first_value(given) OVER r, 0)
  + coalesce(sum(len) OVER (PARTITION BY l_orderkey, l_suppkey % 3, run ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chained
 FROM g WINDOW r AS (PARTITION BY l_orderkey, l_suppkey % 3, run ORDER BY ordinal)),
segments AS (SELECT concat('media-', l_orderkey) AS manifest_id, ordinal - 1 AS ordinal,
 concat('https://cdn.example.com/o/', l_orderkey, '/file', l_suppkey % 3, '.ts') AS uri,
 l_quantity AS duration, concat('part ', ordinal) AS title, l_orderkey % 1000 + ordinal - 1 AS media_sequence,
 CAST(l_linenumber = 4 AS INTEGER) AS discontinuity, CAST(coalesce(given, chained) AS BIGINT) AS range_offset, len AS range_length,
 CASE WHEN l_returnflag <> 'R' THEN 'AES-128' END AS key_method,
 CASE l_returnflag WHEN 'A' THEN concat('https://cdn.example.com/o/', l_orderkey, '/keys/', key_part, '.key')
  WHEN 'N' THEN concat('https://cdn.example.com/o/', l_orderkey, '/k2,v2.key') END AS key_uri,
 CASE l_returnflag WHEN 'A' THEN lpad(printf('%X', l_orderkey % 1000 + ordinal - 1), 32, '0')
  WHEN 'N' THEN lpad(printf('%X', key_part), 32, '0') END AS iv_hex,
 concat('https://cdn.example.com/o/', l_orderkey, '/init-', l_linestatus, '.mp4') AS map_uri FROM b)"""


@query("hls_segments", f"WITH {SEGMENTS} SELECT * FROM segments")
def hls_segments(spark, sf_dir):
    media = P.split_playlists(H.media(spark, sf_dir)).filter("playlist_role = 'media'")
    return P.hls_segments(media).select(
        "manifest_id", "ordinal", "uri", "duration", "title", "media_sequence",
        F.col("discontinuity").cast("int").alias("discontinuity"), "range_offset", "range_length",
        "key_method", "key_uri", F.hex("iv").alias("iv_hex"), "map_uri",
    )


@query("hls_parts", f"""WITH {SEGMENTS},
m AS (SELECT manifest_id, map_uri, min(ordinal) AS ordinal FROM segments GROUP BY 1, 2)
SELECT manifest_id, ordinal, 0 AS is_init, uri, concat('bytes=', range_offset, '-', range_offset + range_length - 1) AS range,
 duration AS seconds, key_uri, iv_hex FROM segments
UNION ALL SELECT manifest_id, ordinal, 1, map_uri, 'bytes=0-719', NULL, NULL, NULL FROM m""")
def hls_parts(spark, sf_dir):
    return P.hls_parts(H.media(spark, sf_dir)).select(
        "manifest_id", "ordinal", F.col("is_init").cast("int").alias("is_init"), "uri", "range", "seconds", "key_uri",
        F.hex("iv").alias("iv_hex"),
    )


@query("hls_playlist_summary", """
SELECT concat('media-', l_orderkey) AS manifest_id, 50.0 AS target_duration, 4 AS version,
 CAST(coalesce(max(o_orderstatus), '-') = 'O' AS INTEGER) AS is_live, sum(l_quantity) AS total_duration,
 count(*) AS segment_count, 1 AS is_fragmented
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def hls_playlist_summary(spark, sf_dir):
    media = H.media(spark, sf_dir)
    return P.playlist_summary(P.hls_segments(media), media).select(
        "manifest_id", "target_duration", "version", F.col("is_live").cast("int").alias("is_live"),
        F.round("total_duration", 3).alias("total_duration"), "segment_count",
        F.col("is_fragmented").cast("int").alias("is_fragmented"),
    )


@query("hls_playlist_keys", f"""WITH {SEGMENTS}
SELECT manifest_id, key_method, key_uri, min(ordinal) AS ordinal, NULL AS system
FROM segments WHERE key_method IS NOT NULL GROUP BY 1, 2, 3""")
def hls_playlist_keys(spark, sf_dir):
    return P.playlist_keys(P.hls_segments(H.media(spark, sf_dir))).select(
        "manifest_id", "key_method", "key_uri", "ordinal", "system"
    )
