"""DASH queries, checked against the line items the manifests were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.fixtures import dash as X
from mediasift.operators import dash as P

from .registry import query

REPS = f"""i AS ({X.PLACED_SQL.format(lineitem='lineitem')}),
reps AS (SELECT *, concat('dash-', l_orderkey) AS manifest_id,
 CASE WHEN l_suppkey % 4 = 0 THEN concat('rep-', period_no, '-', set_no, '-0') ELSE concat('r', l_partkey) END AS rep_id,
 concat('https://cdn.example.com/base/', CASE WHEN period_no = 1 THEN 'p1/' ELSE '' END, 'set', set_no, '/') AS base_url,
 CASE l_returnflag WHEN 'A' THEN 'video' WHEN 'N' THEN 'audio' ELSE 'text' END AS content_type,
 CASE l_returnflag WHEN 'A' THEN 'video/webm' WHEN 'N' THEN 'audio/mp4' ELSE 'text/vtt' END AS mime,
 CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'vp9,opus' ELSE 'vp9' END WHEN 'N' THEN 'mp4a.40.2' END AS codecs,
 CASE WHEN l_returnflag = 'A' THEN 1280 END AS width, CASE WHEN l_returnflag = 'A' THEN l_linenumber * 180 END AS height,
 CASE WHEN l_returnflag = 'A' THEN round(30000 / 1001.0, 6) END AS frame_rate,
 CASE WHEN l_returnflag = 'N' THEN 'pt' END AS lang, CAST(round(l_extendedprice * 10) AS BIGINT) AS bandwidth,
 CASE WHEN period_no = 0 THEN l_orderkey % 40 ELSE 60.5 + l_orderkey % 50 - l_orderkey % 40 END AS period_seconds,
 CASE l_returnflag WHEN 'A' THEN 'webm' WHEN 'N' THEN 'm4a' ELSE 'vtt' END AS container FROM i)"""


def reps(spark, sf_dir, layouts=True):
    return P.dash_representations(P.parse_manifests(X.manifests(spark, sf_dir), layouts))


@query("dash_representations", f"""WITH {REPS}
SELECT manifest_id, period_no, set_no, rep_id, base_url, content_type, mime, codecs, width, height, frame_rate, lang, bandwidth,
 round(period_seconds, 3) AS period_seconds, container FROM reps""")
def dash_representations(spark, sf_dir):
    return reps(spark, sf_dir, layouts=False).select(
        "manifest_id", "period_no", "set_no", "rep_id", "base_url", "content_type", "mime", "codecs", "width", "height",
        F.round("frame_rate", 6).alias("frame_rate"), "lang", "bandwidth", F.round("period_seconds", 3).alias("period_seconds"), "container",
    )


@query("dash_segments", f"""WITH {REPS},
tl AS (SELECT * FROM (VALUES (0, 0, 0, 2.0), (1, 2000, 0, 2.0), (2, 4000, 0, 2.0), (3, 6000, 0, 1.5), (4, 0, 90000, 1.0)) t(k, add, fix, seconds)),
s AS (
 SELECT manifest_id, period_no, set_no, rep_id, -1 AS ordinal, concat(base_url, 'i-', rep_id, '.mp4') AS uri, NULL AS range, 1 AS is_init, 0.0 AS seconds
  FROM reps WHERE l_orderkey % 2 = 0 AND l_linestatus = 'O'
 UNION ALL SELECT manifest_id, period_no, set_no, rep_id, k, concat(base_url, rep_id, '/', CASE WHEN fix > 0 THEN fix ELSE l_partkey + add END, '.m4s'), NULL, 0, seconds
  FROM reps, tl WHERE l_orderkey % 2 = 0 AND l_linestatus = 'O'
 UNION ALL SELECT manifest_id, period_no, set_no, rep_id, k, concat(base_url, '$', bandwidth, '/', lpad(CAST(k + 1 AS VARCHAR), 4, '0'), '.m4s'), NULL, 0, 4.0
  FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(period_seconds, 0) / 4.0) AS BIGINT))) AS k FROM reps WHERE l_orderkey % 2 = 0 AND l_linestatus = 'F')
 UNION ALL SELECT manifest_id, period_no, set_no, rep_id, k, CASE k WHEN -1 THEN concat(base_url, 'li.mp4') WHEN 0 THEN concat(base_url, 'a.m4s') ELSE 'https://cdn.example.com/b.m4s' END,
  CASE k WHEN -1 THEN '0-99' WHEN 0 THEN '100-199' END, CASE WHEN k = -1 THEN 1 ELSE 0 END, CASE WHEN k = -1 THEN 0 ELSE 4.5 END
  FROM reps, (VALUES (-1), (0), (1)) t(k) WHERE l_orderkey % 2 = 1 AND l_linestatus = 'F'
 UNION ALL SELECT manifest_id, period_no, set_no, rep_id, 0, base_url, NULL, 0, period_seconds FROM reps WHERE l_orderkey % 2 = 1 AND l_linestatus = 'O')
SELECT manifest_id, period_no, set_no, rep_id, ordinal, uri, range, is_init, round(seconds, 3) AS seconds FROM s""")
def dash_segments(spark, sf_dir):
    return P.dash_segments(reps(spark, sf_dir)).select(
        "manifest_id", "period_no", "set_no", "rep_id", "ordinal", "uri", "range", F.col("is_init").cast("int").alias("is_init"),
        F.round("seconds", 3).alias("seconds"),
    )


@query("dash_resolve", f"""WITH {REPS},
v AS (SELECT *, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'muxed' ELSE 'video_only' END WHEN 'N' THEN 'audio_only' ELSE 'subtitle' END AS track FROM reps),
d AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, track, height, bandwidth, codecs, lang ORDER BY period_no, set_no) AS rn FROM v)
SELECT manifest_id AS source_id, period_no, set_no, track, height, bandwidth, codecs, lang AS language, left(sha256(concat(base_url, rep_id)), 16) AS variant_id,
 CASE WHEN track = 'audio_only' THEN concat('pt', CASE WHEN bandwidth > 0 THEN concat(' ', bandwidth // 1000, ' kbps') ELSE '' END) END AS name, container
FROM d WHERE rn = 1""")
def dash_resolve(spark, sf_dir):
    return P.dash_resolve(reps(spark, sf_dir, layouts=False)).select(
        "source_id", "period_no", "set_no", "track", "height", "bandwidth", "codecs", "language", "variant_id", "name", "container"
    )


@query("dash_protection", f"""
SELECT concat('dash-', l_orderkey) AS manifest_id, 1 AS is_protected, 'Widevine' AS system FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY l_orderkey""")
def dash_protection(spark, sf_dir):
    parsed = P.parse_manifests(X.manifests(spark, sf_dir))
    return P.manifest_protection(P.dash_protections(parsed)).select(
        "manifest_id", F.col("is_protected").cast("int").alias("is_protected"), "system"
    )
