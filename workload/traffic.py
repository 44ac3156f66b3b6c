"""Traffic queries: classification, candidates, families, protection."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.fixtures import traffic as T
from mediasift.functions import classify as K
from mediasift.functions import urls as U
from mediasift.operators import registry as R
from mediasift.options import CandidateOptions

from .registry import query

R_CTE = f"r AS ({T.RESPONSES_SQL.format(events='events')})"

# What an event is, without looking at any URL.
KIND = """CASE event_type WHEN 'click' THEN 'media_segment' WHEN 'view' THEN 'hls_playlist'
 WHEN 'signup' THEN 'dash_manifest' WHEN 'purchase' THEN 'progressive_video' ELSE 'progressive_audio' END"""
NOISY = "(request_id % 19 = 0)"
ACCEPTED = (
    f"NOT {NOISY} AND NOT (event_type = 'purchase' AND content_length > 0 AND content_length < 65536)"
)
FILE = """CASE event_type WHEN 'view' THEN 'master.m3u8' WHEN 'signup' THEN 'manifest.mpd'
 WHEN 'purchase' THEN concat('movie', request_id % 9, '.mp4') ELSE 'track.mp3' END"""
KEY = f"concat('https://cdn', page_id % 4, '.example.com/v', page_id % 7, '/', {FILE}, '?q=', request_id % 3)"


def accepted(spark, sf_dir, **options):
    rows = R.classify_observations(T.responses(spark, sf_dir))
    return R.filter_candidates(rows, CandidateOptions(**options))


CANDIDATES = f"""
SELECT {KEY} AS candidate_key, arg_min(url, seq) AS url, min({KIND}) AS kind, count(*) AS hit_count,
 epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us,
 arg_min(mime_type, seq) FILTER (mime_type IS NOT NULL) AS mime_type,
 CASE WHEN arg_min(content_length, seq) IS NULL THEN NULL ELSE max(content_length) END AS content_length,
 arg_min(page_url, seq) AS page_url,
 arg_min(page_title, seq) FILTER (page_title IS NOT NULL) AS page_title,
 coalesce(arg_max(cookie, seq) FILTER (cookie IS NOT NULL), arg_max(cookie, seq)) AS cookie
FROM r WHERE event_type <> 'click' AND {ACCEPTED} GROUP BY 1"""


@query("candidates", f"WITH {R_CTE} {CANDIDATES}")
def candidates(spark, sf_dir):
    found = R.candidates(accepted(spark, sf_dir))
    return R.snapshot(found).select(
        "candidate_key", "url", "kind", "hit_count",
        F.unix_micros("first_seen").alias("first_seen_us"), F.unix_micros("last_seen").alias("last_seen_us"),
        "mime_type", "content_length", "page_url", "page_title", "cookie",
    )


@query("classified", f"""WITH {R_CTE}
SELECT request_id, CASE WHEN {NOISY} THEN CASE WHEN resource_type = 'Media' THEN 'progressive_video' ELSE 'unknown' END ELSE {KIND} END AS kind,
 CAST({NOISY} AS INTEGER) AS noise, 0 AS opaque FROM r""")
def classified(spark, sf_dir):
    return R.classify_observations(T.responses(spark, sf_dir)).select(
        "request_id", "kind", F.col("is_noise").cast("int").alias("noise"), F.col("is_opaque").cast("int").alias("opaque")
    )


@query("classify_filter", f"""WITH {R_CTE}
SELECT page_id, {KIND} AS kind, count(*) AS n, sum(content_length) AS bytes FROM r
WHERE NOT {NOISY} AND event_type IN ('click', 'view', 'purchase', 'signup')
 AND NOT (event_type = 'purchase' AND content_length > 0 AND content_length < 200000) GROUP BY 1, 2""")
def classify_filter(spark, sf_dir):
    rows = accepted(spark, sf_dir, include_audio=False, min_progressive_bytes=200_000)
    return rows.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum("content_length").alias("bytes"))


@query("candidates_per_page", f"WITH {R_CTE} SELECT page_id, {KEY} AS candidate_key, count(*) AS hit_count, max(seq) AS last_seq FROM r WHERE event_type <> 'click' AND {ACCEPTED} GROUP BY 1, 2")
def candidates_per_page(spark, sf_dir):
    found = R.candidates(accepted(spark, sf_dir).withColumn("request", F.col("seq").cast("string")).withColumn("cookie", F.lit("x")), by=["page_id"])
    return found.select("page_id", "candidate_key", "hit_count", F.col("request").cast("bigint").alias("last_seq"))


@query("opaque_pages", f"""WITH {R_CTE}
SELECT page_url AS candidate_key, 'page_embed' AS kind, count(*) AS hit_count, epoch_us(min(ts)) AS first_seen_us,
 epoch_us(max(ts)) AS last_seen_us, nullif(arg_min(coalesce(page_title, '-'), seq), '-') AS page_title
FROM r WHERE NOT {NOISY} GROUP BY 1""")
def opaque_pages(spark, sf_dir):
    rows = T.responses(spark, sf_dir).withColumn("mime_type", F.lit("application/vnd.yt-ump; a=b"))
    found = R.candidates(R.filter_candidates(R.classify_observations(rows)))
    return found.select(
        "candidate_key", "kind", "hit_count", F.unix_micros("first_seen").alias("first_seen_us"),
        F.unix_micros("last_seen").alias("last_seen_us"), "page_title",
    )


@query("segment_families", f"""WITH {R_CTE}
SELECT concat('cdn', page_id % 4, '.example.com/v', page_id % 7) AS family, count(*) AS segment_count, sum(content_length) AS total_bytes,
 epoch_us(max(ts)) AS last_seen_us, arg_min(url, seq) AS sample_url FROM r WHERE event_type = 'click' AND NOT {NOISY} GROUP BY 1""")
def segment_families(spark, sf_dir):
    families = R.rank_families(R.segment_families(accepted(spark, sf_dir)))
    return families.select("family", "segment_count", "total_bytes", F.unix_micros("last_seen").alias("last_seen_us"), "sample_url")


@query("mark_protected", f"""WITH {R_CTE}, c AS ({CANDIDATES})
SELECT candidate_key, CAST(p AS INTEGER) AS is_protected, CASE WHEN p THEN 'Widevine' END AS protection_system
FROM (SELECT candidate_key, contains(candidate_key, '/v3/') AS p FROM c)""")
def mark_protected(spark, sf_dir):
    rows = T.responses(spark, sf_dir)
    packages = rows.filter("event_type = 'signup' and page_id % 7 = 3").select(
        F.col("url").alias("manifest_url"), F.lit("Widevine").alias("system")
    )
    marked = R.mark_protected(R.candidates(accepted(spark, sf_dir)), packages)
    return marked.select("candidate_key", F.col("is_protected").cast("int").alias("is_protected"), "protection_system")


@query("add_manual", f"""WITH {R_CTE}, c AS ({CANDIDATES}), manual AS (SELECT DISTINCT {KEY} AS candidate_key, event_type FROM r WHERE seq % 97 = 0)
SELECT candidate_key, kind, hit_count FROM c WHERE candidate_key NOT IN (SELECT candidate_key FROM (
  SELECT CASE WHEN {NOISY} THEN replace({KEY}, concat('cdn', page_id % 4, '.example.com'), 'pubads.g.doubleclick.net') ELSE {KEY} END AS candidate_key FROM r WHERE event_type <> 'click' AND seq % 97 = 0))
UNION ALL SELECT DISTINCT CASE WHEN {NOISY} THEN replace(k, concat('cdn', page_id % 4, '.example.com'), 'pubads.g.doubleclick.net') ELSE k END,
 CASE WHEN {NOISY} OR event_type = 'click' THEN 'page_embed' ELSE {KIND} END, 1
FROM (SELECT *, CASE WHEN event_type = 'click' THEN concat('https://cdn', page_id % 4, '.example.com/v', page_id % 7, '/seg-', request_id % 50, '.ts?q=', request_id % 3) ELSE {KEY} END AS k
 FROM r WHERE seq % 97 = 0)""")
def add_manual(spark, sf_dir):
    manual = T.responses(spark, sf_dir).filter("seq % 97 = 0").select("url", "ts", "seq")
    return R.add_manual(R.candidates(accepted(spark, sf_dir)), manual).select("candidate_key", "kind", "hit_count")


@query("trace", f"""WITH {R_CTE}
SELECT request_id, CAST({NOISY} AS INTEGER) AS noise, CASE event_type WHEN 'click' THEN 'media_segment' WHEN 'signup' THEN 'dash_manifest'
 WHEN 'purchase' THEN 'progressive_video' ELSE 'unknown' END AS by_mime, {KIND} AS by_path,
 CASE WHEN resource_type = 'Media' THEN 'progressive_video' ELSE 'unknown' END AS by_resource FROM r WHERE page_id % 7 = 2""")
def trace(spark, sf_dir):
    return R.trace(T.responses(spark, sf_dir), "/v2/").select(
        "request_id", F.col("is_noise").cast("int").alias("noise"), "by_mime", "by_path", "by_resource"
    )


@query("first_k_candidates", f"""WITH {R_CTE}, c AS (SELECT page_id, {KEY} AS candidate_key, min({KIND}) AS kind, min(seq) AS first_seq,
 CASE WHEN arg_min(content_length, seq) IS NULL THEN NULL ELSE max(content_length) END AS content_length FROM r WHERE event_type <> 'click' AND {ACCEPTED} GROUP BY 1, 2),
 k AS (SELECT page_id, candidate_key, kind, row_number() OVER (PARTITION BY page_id ORDER BY kind NOT IN ('hls_playlist', 'dash_manifest'), coalesce(content_length, 0) DESC, first_seq, candidate_key) AS candidate_rank FROM c)
SELECT * FROM k WHERE candidate_rank <= 3""")
def first_k_candidates(spark, sf_dir):
    found = R.candidates(accepted(spark, sf_dir), by=["page_id"])
    return R.first_k_candidates(found, ["page_id"]).select("page_id", "candidate_key", "kind", "candidate_rank")


@query("fallback_targets", f"""WITH {R_CTE}, c AS ({CANDIDATES})
SELECT candidate_key, 0 AS target_no, page_url AS target_url FROM c UNION ALL SELECT candidate_key, 1, url FROM c""")
def fallback_targets(spark, sf_dir):
    return R.fallback_targets(R.candidates(accepted(spark, sf_dir))).select("candidate_key", "target_no", "target_url")


@query("url_parts", f"""WITH {R_CTE}
SELECT request_id, 'https' AS scheme, CASE WHEN {NOISY} THEN 'pubads.g.doubleclick.net' ELSE concat('cdn', page_id % 4, '.example.com') END AS host,
 regexp_extract(url, '^https://[^/]*([^?]*)', 1) AS path, concat('token=t', request_id, '&q=', request_id % 3) AS query,
 CASE event_type WHEN 'click' THEN '.ts' WHEN 'view' THEN '.m3u8' WHEN 'signup' THEN '.mpd' WHEN 'purchase' THEN '.mp4' ELSE '.mp3' END AS ext,
 left(sha256(url), 16) AS id, concat('https://', split_part(url, '/', 3), '/up/x.ts') AS resolved FROM r""")
def url_parts(spark, sf_dir):
    rows = T.responses(spark, sf_dir)
    upper = F.concat(F.upper(F.substring("url", 1, 12)), F.substr("url", F.lit(13)))
    return rows.select(
        "request_id", U.url_scheme(upper).alias("scheme"), U.url_host(upper).alias("host"), U.url_path("url").alias("path"),
        U.url_query("url").alias("query"), U.url_extension(U.url_path("url")).alias("ext"), U.stable_id("url").alias("id"),
        U.resolve_url(F.lit("../up/./x.ts"), "url").alias("resolved"),
    )


@query("normalize_seed", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('https://www.google.com/search?q=', replace(p_name, ' ', '%20'))
 WHEN 1 THEN concat('https://part', p_partkey, '.example.com/') ELSE concat('https://ex.com/p/', p_partkey) END AS url FROM part""")
def normalize_seed(spark, sf_dir):
    from mediasift.fixtures.tables import table

    key = F.col("p_partkey").cast("string")
    typed = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name"))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("part"), key, F.lit(".example.com")))
        .otherwise(F.concat(F.lit("HTTPS://EX.com:443/p/"), key))
    )
    return table(spark, sf_dir, "part").select("p_partkey", U.normalize_seed(typed).alias("url"))
