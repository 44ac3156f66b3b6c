"""Extractor, variant, plan, job and inspection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.fixtures import hls as H
from mediasift.fixtures import traffic as T
from mediasift.fixtures import transfers as D
from mediasift.fixtures.tables import table
from mediasift.operators import extractor as E
from mediasift.operators import hls as P
from mediasift.operators import inspection as N
from mediasift.operators import jobs as J
from mediasift.operators import variants as V
from mediasift.operators.written import written

from .registry import ORACLES, query

R_CTE = f"r AS ({T.RESPONSES_SQL.format(events='events')})"
J_CTE = f"j0 AS ({D.JOBS_SQL.format(events='events')})"


def bytes_label(b: str) -> str:
    units = "".join(
        f"WHEN {b} < {1024 ** (p + 1)}.0 THEN CASE WHEN {b} / {1024 ** p}.0 < 10 THEN printf('%.1f {u}', round({b} / {1024 ** p}.0::DOUBLE, 1))"
        f" ELSE printf('%.0f {u}', round({b} / {1024 ** p}.0::DOUBLE, 0)) END "
        for p, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB"))
    )
    return f"CASE WHEN {b} IS NULL OR {b} < 0 THEN '-' WHEN {b} < 1024 THEN concat({b}, ' B') {units} END"


def rate_label(b: str) -> str:
    return (
        f"CASE WHEN {b} >= 1000000 THEN printf('%.1f Mbps', round({b} / 1e6, 1)) ELSE printf('%.0f kbps', round({b} / 1e3, 0)) END"
    )


FORMATS = f"""i AS ({H.ITEMS_SQL.format(lineitem='lineitem')}),
f0 AS (SELECT concat('src-', l_orderkey) AS source_id, l_orderkey, ordinal - 1 AS ordinal, concat('f', ordinal) AS variant_id,
 concat('https://x.example.com/', l_partkey) AS url, CASE l_returnflag WHEN 'A' THEN 'muxed' WHEN 'N' THEN 'video_only' ELSE 'audio_only' END AS track,
 CASE WHEN l_partkey % 13 <> 0 THEN l_linenumber % 4 * 360 END AS height,
 nullif(CAST(round(l_extendedprice / 100) AS BIGINT), 0) * 1000 AS bandwidth, l_linenumber % 2 * 30 + 30 AS fps,
 CASE l_returnflag WHEN 'N' THEN 'webm' ELSE 'mp4' END AS container, l_orderkey % 50 + 100 AS duration,
 CASE l_returnflag WHEN 'A' THEN 'H.264' WHEN 'N' THEN 'VP9' ELSE 'Opus' END AS codec
 FROM i WHERE l_partkey % 11 <> 0 AND l_orderkey % 97 <> 0 AND l_orderkey % 9 <> 0),
f1 AS (SELECT *, CASE WHEN bandwidth > 0 THEN CAST(floor(bandwidth / 8.0::DOUBLE * duration) AS BIGINT) END AS bytes FROM f0),
f2 AS (SELECT *, {bytes_label('bytes')} AS size_label, concat_ws(' - ',
  CASE track WHEN 'audio_only' THEN 'Audio' ELSE CASE WHEN height IS NULL THEN 'SD' ELSE concat(height, 'p') END END,
  CASE WHEN track <> 'audio_only' AND fps > 31 THEN concat(fps, 'fps') END, CASE WHEN bandwidth > 0 THEN {rate_label('bandwidth')} END, codec) AS label FROM f1),
listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, track, label, container, size_label ORDER BY ordinal) AS rn FROM f2) WHERE rn = 1),
offered AS (SELECT source_id, l_orderkey, ordinal, variant_id, track, height, bandwidth, container, label, size_label, bytes FROM listed
 UNION ALL SELECT concat('src-', l_orderkey), l_orderkey, 0, 'best', 'muxed', NULL, NULL, 'mkv', 'SD', '-', NULL FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 9 = 0 AND l_orderkey % 97 <> 0))"""


def parsed_dumps(spark, sf_dir):
    return E.read_extractor_dumps(D.dumps(spark, sf_dir))


def listed(spark, sf_dir):
    return E.extractor_variants(parsed_dumps(spark, sf_dir))


def kept(spark, sf_dir):
    """The same rows from a table, for queries with several branches over them: dumps are parsed once."""
    return written(listed(spark, sf_dir))


@query("extractor_dumps", """
SELECT concat('src-', l_orderkey) AS source_id, concat('Title: ', l_orderkey % 50) AS title, l_orderkey % 50 + 100 AS duration,
 CASE WHEN l_orderkey % 9 <> 0 THEN count(*) END AS formats FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY l_orderkey""")
def extractor_dumps(spark, sf_dir):
    return parsed_dumps(spark, sf_dir).select(
        "source_id", "title", "duration", F.when(F.col("formats").isNotNull(), F.size("formats")).alias("formats")
    )


@query("extractor_variants", f"""WITH {FORMATS}
SELECT source_id, ordinal, variant_id, url, track, height, bandwidth, container, label, size_label FROM listed
UNION ALL SELECT concat('src-', l_orderkey), 0, 'best', concat('https://one.example.com/', l_orderkey), 'muxed', NULL, NULL, 'mkv', 'SD', '-'
 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 9 = 0 AND l_orderkey % 97 <> 0)""")
def extractor_variants(spark, sf_dir):
    return listed(spark, sf_dir).select(
        "source_id", "ordinal", "variant_id", "url", "track", "height", "bandwidth", "container", "label", "size_label"
    )


SCORE = "coalesce(height, 0) * 1000000 + least(coalesce(bandwidth, 0), 999999)"


@query("rank_videos", f"""WITH {FORMATS}
SELECT source_id, ordinal, {SCORE} AS score, row_number() OVER (PARTITION BY source_id ORDER BY {SCORE} DESC, ordinal) AS video_rank
FROM offered WHERE track <> 'audio_only'""")
def rank_videos(spark, sf_dir):
    return V.rank_videos(kept(spark, sf_dir)).select("source_id", "ordinal", "score", "video_rank")


@query("rank_audios", f"""WITH {FORMATS}
SELECT source_id, ordinal, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(bandwidth, 0) DESC, ordinal) AS audio_rank
FROM offered WHERE track = 'audio_only'""")
def rank_audios(spark, sf_dir):
    return V.rank_audios(kept(spark, sf_dir)).select("source_id", "ordinal", "audio_rank")


@query("rank_videos_whole_table", f"""
SELECT l_returnflag AS source_id, l_orderkey * 100 + l_linenumber AS ordinal, l_partkey, l_suppkey, epoch_us(l_shipdate) AS shipped,
 rank() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_linenumber * 360 AS BIGINT) * 1000000 + least(CAST(round(l_extendedprice * 20) AS BIGINT), 999999) DESC, l_orderkey * 100 + l_linenumber) AS first_rank
FROM lineitem""")
def rank_videos_whole_table(spark, sf_dir):
    """Three sources hold the whole table, so each ladder is cut into chunks."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"),
        F.lit("muxed").alias("track"), (F.col("l_linenumber") * 360).alias("height"),
        F.round(F.col("l_extendedprice") * 20).cast("bigint").alias("bandwidth"), "l_partkey", "l_suppkey",
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"),
    )
    ranked = V.rank_videos(rows)
    # Equal (score, ordinal) pairs share the best rank, as the table repeats its key.
    first = ranked.groupBy("source_id", "ordinal", "score").agg(F.min("video_rank").alias("first_rank"))
    return ranked.join(first, ["source_id", "ordinal", "score"]).select(
        "source_id", "ordinal", "l_partkey", "l_suppkey", "shipped", "first_rank"
    )


@query("pair_audio", f"""WITH {FORMATS},
a AS (SELECT source_id, arg_max(variant_id, coalesce(bandwidth, 0) * 1000 - ordinal) AS audio_id FROM offered WHERE track = 'audio_only' GROUP BY 1)
SELECT source_id, ordinal, track, CASE WHEN track = 'video_only' THEN audio_id END AS audio_id FROM offered LEFT JOIN a USING (source_id) WHERE track <> 'audio_only'""")
def pair_audio(spark, sf_dir):
    rows = V.conform(kept(spark, sf_dir))
    return V.pair_audio(V.videos_of(rows), V.audios_of(rows)).select("source_id", "ordinal", "track", "audio_id")


@query("pair_audio_groups", f"""
SELECT source_id, section * 1000 + ordinal AS ordinal, track, audio_group, CASE WHEN track = 'video_only' THEN 'English, main 6ch (default)' END AS audio_name
FROM ({ORACLES["hls_resolve"]}) WHERE track IN ('muxed', 'video_only')""")
def pair_audio_groups(spark, sf_dir):
    """All videos of all masters beside all audio: renditions of a group and streams without one."""
    masters = H.masters(spark, sf_dir)
    rows = P.hls_resolve(P.hls_master_variants(masters), P.hls_renditions(masters))
    rows = V.conform(rows.withColumn("ordinal", F.col("section") * 1000 + F.col("ordinal")).withColumn("variant_id", F.coalesce("name", "variant_id")))
    rows = written(rows)
    paired = V.pair_audio(V.videos_of(rows), V.audios_of(rows))
    return paired.select("source_id", "ordinal", "track", "audio_group", F.col("audio_id").alias("audio_name"))


@query("describe_sources", f"""WITH {FORMATS},
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, track = 'audio_only' ORDER BY CASE WHEN track = 'audio_only' THEN coalesce(bandwidth, 0) ELSE {SCORE} END DESC, ordinal) AS k FROM offered)
SELECT source_id, count(*) FILTER (track <> 'audio_only') AS videos, count(*) FILTER (track = 'audio_only') AS audios,
 CASE WHEN count(*) FILTER (track <> 'audio_only') > 0 THEN concat(string_agg(concat(label, ' [external]'), '; ' ORDER BY k) FILTER (track <> 'audio_only' AND k <= 3),
  CASE WHEN count(*) FILTER (track <> 'audio_only') > 3 THEN concat('; +', count(*) FILTER (track <> 'audio_only') - 3) ELSE '' END) END AS best_videos
FROM k GROUP BY 1""")
def describe_sources(spark, sf_dir):
    described = V.describe_sources(V.conform(kept(spark, sf_dir)))
    return described.select("source_id", "videos", "audios", "best_videos")


PLANS = f"""{FORMATS},
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {SCORE} DESC, ordinal) AS k FROM offered WHERE track <> 'audio_only') WHERE k = 1),
a AS (SELECT source_id, arg_max(variant_id, coalesce(bandwidth, 0) * 1000 - ordinal) AS audio_id, arg_max(bytes, coalesce(bandwidth, 0) * 1000 - ordinal) AS audio_bytes,
 arg_max(ordinal, coalesce(bandwidth, 0) * 1000 - ordinal) AS audio_ordinal, max(coalesce(bandwidth, 0)) AS audio_rate FROM offered WHERE track = 'audio_only' GROUP BY 1)"""


@query("make_plans", f"""WITH {PLANS},
p AS (SELECT v.*, CASE WHEN track = 'video_only' THEN audio_id END AS chosen, CASE WHEN track = 'video_only' THEN audio_bytes END AS chosen_bytes,
 concat('downloads/Title ', l_orderkey % 50, ' [', CASE WHEN height IS NULL THEN 'SD' ELSE concat(height, 'p') END, ']') AS stem FROM v LEFT JOIN a USING (source_id))
SELECT source_id, variant_id AS video_id, chosen AS audio_id, CAST(chosen IS NOT NULL AS INTEGER) AS needs_merge,
 CASE WHEN bytes IS NOT NULL OR chosen_bytes IS NOT NULL THEN coalesce(bytes, 0) + coalesce(chosen_bytes, 0) END AS estimated_bytes,
 CASE WHEN chosen IS NULL THEN variant_id ELSE concat(variant_id, '+', chosen) END AS format_selector,
 concat(stem, CASE WHEN n > 1 THEN concat(' (', n, ')') ELSE '' END, '.', container) AS output_path
FROM (SELECT *, row_number() OVER (PARTITION BY lower(concat(stem, '.', container)) ORDER BY l_orderkey) AS n FROM p)""")
def make_plans(spark, sf_dir):
    dumps = parsed_dumps(spark, sf_dir)
    variants = E.extractor_variants(dumps)
    sources = dumps.select("source_id", "title", F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint").alias("seq"))
    return V.make_plans(sources, variants).select(
        "source_id", "video_id", "audio_id", F.col("needs_merge").cast("int").alias("needs_merge"), "estimated_bytes",
        "format_selector", "output_path",
    )


def chosen_plans(spark, sf_dir):
    """Every source takes its first video in document order, and its first audio when the key is even."""
    variants = kept(spark, sf_dir)
    first = lambda track: F.min(F.when(track, F.col("ordinal")))
    plans = variants.groupBy("source_id").agg(
        first(F.col("track") != "audio_only").alias("video_ordinal"), first(F.col("track") == "audio_only").alias("_audio")
    ).filter(F.col("video_ordinal").isNotNull())
    number = F.regexp_extract("source_id", r"(\d+)$", 1).cast("bigint")
    plans = plans.select(
        "source_id", F.col("source_id").alias("job_id"), "video_ordinal", F.when(number % 2 == 0, F.col("_audio")).alias("audio_ordinal"),
        F.lit(False).alias("audio_only"), (number % 3 != 0).alias("muxer_available"),
        F.when(number % 4 != 0, number % 4 * 100_000_000).alias("free_bytes"),
    )
    return V.compare_with_best(plans, variants)


CHOSEN = f"""{PLANS},
c0 AS (SELECT source_id, l_orderkey, min(ordinal) FILTER (track <> 'audio_only') AS vo, min(ordinal) FILTER (track = 'audio_only') AS ao FROM offered GROUP BY 1, 2),
c AS (SELECT c0.source_id, c0.l_orderkey, x.track, {SCORE.replace('height', 'x.height').replace('bandwidth', 'x.bandwidth')} AS score, x.bytes, x.label,
 CASE WHEN c0.l_orderkey % 2 = 0 THEN y.ordinal END AS ao, y.bandwidth AS arate, ao IS NOT NULL AS any_audio
 FROM c0 JOIN offered x ON x.source_id = c0.source_id AND x.ordinal = c0.vo LEFT JOIN offered y ON y.source_id = c0.source_id AND y.ordinal = c0.ao),
d AS (SELECT c.*, v.label AS best_label, {SCORE.replace('height', 'v.height').replace('bandwidth', 'v.bandwidth')} AS best_score, a.audio_rate FROM c JOIN v USING (source_id) LEFT JOIN a USING (source_id))"""


@query("audit_plans", f"""WITH {CHOSEN}
SELECT source_id AS job_id, 'plan' AS code FROM d
UNION ALL SELECT source_id, 'mute' FROM d WHERE track = 'video_only' AND ao IS NULL
UNION ALL SELECT source_id, 'below_best_video' FROM d WHERE best_score > score
UNION ALL SELECT source_id, 'below_best_audio' FROM d WHERE track = 'video_only' AND ao IS NOT NULL AND audio_rate > coalesce(arate, 0)
UNION ALL SELECT source_id, 'no_muxer_extractor' FROM d WHERE track = 'video_only' AND ao IS NOT NULL AND l_orderkey % 3 = 0""")
def audit_plans(spark, sf_dir):
    return V.audit_plans(chosen_plans(spark, sf_dir)).select("job_id", "code")


@query("choice_warning", f"""WITH {CHOSEN}
SELECT source_id AS job_id, CASE WHEN bytes > 0 AND l_orderkey % 4 * 100000000 < greatest(268435456, CAST(floor(bytes * 2.2::DOUBLE) AS BIGINT)) AND l_orderkey % 4 <> 0 THEN 'space'
 WHEN track = 'video_only' AND NOT any_audio THEN 'mute' WHEN track = 'video_only' AND l_orderkey % 3 = 0 THEN 'two_files' END AS warning FROM d""")
def choice_warning(spark, sf_dir):
    return V.choice_warning(chosen_plans(spark, sf_dir)).select("job_id", "warning")


@query("unique_names", """
SELECT p_partkey, CASE WHEN n = 1 THEN path ELSE concat(p_name, ' (', n, ').mp4') END AS unique_path
FROM (SELECT *, concat(p_name, '.mp4') AS path, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def unique_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".mp4")).alias("path"))
    return V.unique_names(parts, "path", "p_partkey").select("p_partkey", "unique_path")


@query("subtitle_outputs", """
SELECT s_suppkey AS ordinal, concat('out/', s_nationkey, '.', CASE s_suppkey % 3 WHEN 0 THEN 'pt' WHEN 1 THEN 'Name' ELSE 'sub' END,
 CASE WHEN n > 1 THEN concat(' (', n, ')') ELSE '' END, '.vtt') AS subtitle_path,
 CASE WHEN s_suppkey % 10 = 0 THEN concat('subtitle ''', CASE s_suppkey % 3 WHEN 0 THEN 'pt' WHEN 1 THEN 'Name' ELSE 'sub' END, ''' failed: 404') END AS warning
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier)""")
def subtitle_outputs(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("string")
    plans = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_name").alias("job_id"),
        F.concat(F.lit("out/"), F.col("n_nationkey").cast("string"), F.lit(".mp4")).alias("output_path"),
    )
    subtitles = suppliers.select(
        nation.alias("source_id"), F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("seq"),
        F.when(F.col("s_suppkey") % 3 == 0, "pt").alias("language"), F.when(F.col("s_suppkey") % 3 == 1, "Name:").alias("name"),
        F.lit("vtt").alias("container"), F.when(F.col("s_suppkey") % 10 == 0, "404").alias("error"),
    )
    outputs = V.subtitle_outputs(plans, subtitles)
    return outputs.select("ordinal", "subtitle_path", F.regexp_replace("warning", "Name:", "Name").alias("warning"))


# --- jobs -------------------------------------------------------------------------------------

PROGRESS = f"""{J_CTE}, p AS (SELECT concat('job', page_id) AS job_id, seq, CASE WHEN done_now * 2 < total_now THEN 'video' WHEN done_now * 4 < total_now * 3 THEN 'audio' ELSE 'finalizing' END AS stage,
 done_now, total_now, content_length, CAST(floor(done_now * 10.0 / total_now + 1e-12) AS BIGINT) AS decile FROM j0),
s AS (SELECT *, lag(stage) OVER w AS prev, max(decile) OVER (PARTITION BY job_id, stage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM p WINDOW w AS (PARTITION BY job_id ORDER BY seq))"""


@query("milestones", f"""WITH {PROGRESS}
SELECT job_id, seq, CASE WHEN prev IS NULL OR prev <> stage THEN concat('stage: ', stage)
 ELSE concat(stage, ' ', decile * 10, '% - ', done_now, '/', total_now, ' segments, ', CASE WHEN content_length <= 0 THEN '-' ELSE concat({bytes_label('content_length')}, '/s') END) END AS message
FROM s WHERE prev IS NULL OR prev <> stage OR decile > reached""")
def milestones(spark, sf_dir):
    return J.milestones(D.progress_events(spark, sf_dir)).select("job_id", "seq", "message")


@query("progress_columns", f"WITH {J_CTE} SELECT seq, round(done_now / total_now::DOUBLE, 6) AS fraction, NULL::DOUBLE AS eta_seconds FROM j0")
def progress_columns(spark, sf_dir):
    return J.progress_columns(D.progress_events(spark, sf_dir)).select("seq", F.round("fraction", 6).alias("fraction"), "eta_seconds")


@query("stage_offsets", f"""WITH {PROGRESS}, b AS (SELECT job_id, stage, max(done_now) * 1000 AS top FROM p GROUP BY 1, 2)
SELECT p.seq, done_now * 1000 + coalesce((SELECT sum(top) FROM b WHERE b.job_id = p.job_id AND b.stage < 'z' AND
 CASE p.stage WHEN 'audio' THEN b.stage = 'video' WHEN 'finalizing' THEN b.stage IN ('video', 'audio') ELSE false END), 0) AS job_bytes FROM p""")
def stage_offsets(spark, sf_dir):
    return J.stage_offsets(D.progress_events(spark, sf_dir)).select("seq", "job_bytes")


EVENTS = f"""{R_CTE}, e AS (SELECT concat('job', page_id, '-', seq // 2000) AS job_id, CAST(seq // 500 % 4 + 1 AS INTEGER) AS attempt, seq, ts, url,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'muxing' ELSE 'downloading' END AS state,
 event_type IN ('error', 'purchase') AS terminal, event_type IN ('error', 'purchase', 'signup') AS stated, seq % 2 AS warnings FROM r),
t AS (SELECT *, min(CASE WHEN terminal THEN seq END) OVER (PARTITION BY job_id, attempt) AS stop FROM e)"""


@query("state_timeline", f"""WITH {EVENTS}
SELECT seq, state, lag(state) OVER (PARTITION BY job_id, attempt ORDER BY seq) AS previous_state FROM t WHERE stop IS NULL OR seq <= stop""")
def state_timeline(spark, sf_dir):
    return J.state_timeline(D.job_events(spark, sf_dir)).select("seq", "state", "previous_state")


@query("job_summary", f"""WITH {EVENTS}, m AS (SELECT *, max(attempt) OVER (PARTITION BY job_id) AS last FROM t),
g AS (SELECT job_id, max(attempt) AS attempts, min(ts) AS created, sum(warnings) AS warnings, min(seq) FILTER (attempt = last AND terminal) AS stop,
 arg_max(state, attempt * 100000000 + seq) FILTER (stated) AS last_state FROM m GROUP BY 1)
SELECT g.job_id, g.attempts, g.warnings, coalesce(e.state, g.last_state) AS final_state,
 round((epoch_us(e.ts) - epoch_us(g.created)) / 1e6, 3) AS elapsed_seconds,
 CAST(coalesce(coalesce(e.state, g.last_state) IN ('failed', 'canceled') AND NOT (e.seq IS NOT NULL AND e.seq % 6 = 0), false) AS INTEGER) AS may_retry
FROM g LEFT JOIN e ON e.seq = g.stop""")
def job_summary(spark, sf_dir):
    return J.job_summary(D.job_events(spark, sf_dir)).select(
        "job_id", "attempts", "warnings", "final_state", F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.col("may_retry").cast("int").alias("may_retry"),
    )


RUNS = f"""{EVENTS}, q AS (SELECT job_id, attempt, min(ts) FILTER (state = 'downloading') AS a, min(ts) FILTER (terminal) AS b, min(ts) FILTER (state = 'queued') AS queued FROM e GROUP BY 1, 2),
ch AS (SELECT a AS ts, 1 AS c, job_id, attempt FROM q WHERE a IS NOT NULL UNION ALL SELECT b, -1, job_id, attempt FROM q WHERE a IS NOT NULL AND b IS NOT NULL),
run AS (SELECT *, sum(c) OVER (ORDER BY ts, c, job_id, attempt) AS running FROM ch)"""


def stated_events(spark, sf_dir):
    """Job events where a transfer report is a downloading state of its own."""
    events = D.job_events(spark, sf_dir)
    return events.withColumn("state", F.coalesce("state", F.when(F.col("stage") == "video", "downloading")))


@query("concurrency", f"WITH {RUNS} SELECT epoch_us(ts) AS ts_us, c AS change, job_id, attempt, running FROM run")
def concurrency(spark, sf_dir):
    steps = J.concurrency(J.run_intervals(stated_events(spark, sf_dir)))
    return steps.select(F.unix_micros("ts").alias("ts_us"), "change", "job_id", "attempt", "running")


@query("peak_concurrency", f"""WITH {RUNS}
SELECT max(running) AS peak, epoch_us(min(ts) FILTER (running = (SELECT max(running) FROM run))) AS peak_at_us, CAST(max(running) <= 8 AS INTEGER) AS within_limit FROM run""")
def peak_concurrency(spark, sf_dir):
    return J.peak_concurrency(stated_events(spark, sf_dir), limit=8).select(
        "peak", F.unix_micros("peak_at").alias("peak_at_us"), F.col("within_limit").cast("int").alias("within_limit")
    )


@query("queue_waits", f"WITH {RUNS} SELECT job_id, attempt, round((epoch_us(a) - epoch_us(queued)) / 1e6, 3) AS wait_seconds FROM q")
def queue_waits(spark, sf_dir):
    waits = J.queue_waits(J.run_intervals(stated_events(spark, sf_dir)))
    return waits.select("job_id", "attempt", F.round("wait_seconds", 3).alias("wait_seconds"))


FETCH = f"""{R_CTE}, f AS (SELECT seq, seq // 5 AS request_id, ts, concat('h', page_id % 40) AS host, CASE WHEN seq % 3 = 0 THEN 'browser' ELSE 'direct' END AS route,
 CAST(seq % 5 AS INTEGER) AS attempt, [200, 403, 429, 503, 200][seq % 5 + 1] AS status, CASE WHEN seq % 7 = 0 THEN seq % 60 END AS ra FROM r)"""


@query("retry_audit", f"""WITH {FETCH}, d AS (SELECT *, lag(ts) OVER w AS pts, lag(ra) OVER w AS pra, lag(attempt) OVER w AS pa, lag(status) OVER w AS pst FROM f WINDOW w AS (PARTITION BY request_id ORDER BY attempt)),
x AS (SELECT *, CASE WHEN pts IS NULL OR pst NOT IN (408, 429, 500, 502, 503, 504) OR pa >= 4 THEN NULL WHEN pra > 0 THEN least(pra, 30) ELSE 0.4 * pow(2, pa) END AS expected FROM d)
SELECT request_id, attempt, round(expected, 3) AS expected_delay_s, CAST(coalesce((epoch_us(ts) - epoch_us(pts)) / 1e6 < expected, false) AS INTEGER) AS too_early FROM x""")
def retry_audit(spark, sf_dir):
    return J.retry_audit(D.fetch_log(spark, sf_dir)).select(
        "request_id", "attempt", F.round("expected_delay_s", 3).alias("expected_delay_s"), F.col("too_early").cast("int").alias("too_early")
    )


@query("retry_summary", f"""WITH {FETCH} SELECT request_id, count(*) AS attempts, arg_max(status, attempt) AS final_status,
 CAST(count(*) >= 5 AND arg_max(status, attempt) IN (429, 503) AS INTEGER) AS exhausted FROM f GROUP BY 1""")
def retry_summary(spark, sf_dir):
    return J.retry_summary(J.retry_audit(D.fetch_log(spark, sf_dir))).select(
        "request_id", "attempts", "final_status", F.col("exhausted").cast("int").alias("exhausted")
    )


@query("refusal_diagnosis", f"""WITH {FETCH}, r1 AS (SELECT host, arg_min(seq, ts) FILTER (route = 'direct' AND status = 403) AS s, min(ts) FILTER (route = 'direct' AND status = 403) AS refused FROM f GROUP BY 1),
a AS (SELECT host, s, count(*) FILTER (route = 'browser' AND status = 200 AND ts >= refused) AS ok, count(*) FILTER (route = 'browser' AND ts >= refused) AS asked FROM f JOIN r1 USING (host) GROUP BY 1, 2)
SELECT host, 403 AS status, CASE WHEN s % 4 = 0 THEN 'user-agent' ELSE 'referer, user-agent' END AS headers_sent, CAST(s % 4 = 0 AS INTEGER) AS had_cookie,
 CASE WHEN ok > 0 THEN 'browser_succeeded' WHEN asked > 0 THEN 'browser_refused' ELSE 'not_tried' END AS browser_outcome FROM a WHERE s IS NOT NULL""")
def refusal_diagnosis(spark, sf_dir):
    return J.refusal_diagnosis(D.fetch_log(spark, sf_dir)).select(
        "host", "status", "headers_sent", F.col("had_cookie").cast("int").alias("had_cookie"), "browser_outcome"
    )


@query("route_hosts", f"""WITH {FETCH}, r1 AS (SELECT host, min(ts) FILTER (route = 'direct' AND status = 403) AS refused FROM f GROUP BY 1),
h AS (SELECT host, min(ts) FILTER (route = 'browser' AND status = 200 AND ts >= refused) AS since FROM f JOIN r1 USING (host) GROUP BY 1)
SELECT seq // 5 AS request_id, attempt, CASE WHEN ts > since THEN 'browser' ELSE 'direct' END AS expected_route FROM f JOIN h USING (host)""")
def route_hosts(spark, sf_dir):
    return J.route_hosts(D.fetch_log(spark, sf_dir)).select("request_id", "attempt", "expected_route")


def order_parts(spark, sf_dir):
    return H.items(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("job_id"), (F.col("ordinal") - 1).alias("ordinal"),
        F.concat(F.lit("https://c/"), F.col("l_partkey").cast("string")).alias("uri"), F.lit(None).cast("string").alias("range"),
    )


def decisions(spark, sf_dir):
    parts = order_parts(spark, sf_dir)
    ends = J.resume_identities(parts).withColumn("k", F.col("job_id").cast("bigint"))
    identity = F.when(F.col("k") % 5 == 0, F.lit("other")).otherwise(F.col("current_identity"))
    body = F.concat(
        F.lit('{"schema":1,"partesEscritas":'), F.greatest(F.col("total") - 1, F.lit(1)).cast("string"), F.lit(',"bytes":1000,"totalDePartes":'),
        F.col("total").cast("string"), F.lit(',"identidade":"'), identity, F.lit('"}'),
    )
    body = F.when(F.col("k") % 7 == 0, F.lit("{broken")).otherwise(body)
    checkpoints = N.read_checkpoints(ends.select("job_id", body.alias("body")))
    listing = ends.filter("k % 11 <> 0").select("job_id", (F.lit(1000) + F.col("k") % 3 * 500 - F.lit(500)).alias("part_bytes"))
    return parts, J.resume_decisions(parts, checkpoints, listing)


DECIDED = """d AS (SELECT l_orderkey AS k, count(*) AS total, CASE WHEN l_orderkey % 5 = 0 OR l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 OR l_orderkey % 3 = 0 THEN 'restart'
 WHEN l_orderkey % 3 = 1 THEN 'resume' ELSE 'trim_and_resume' END AS decision, greatest(count(*) - 1, 1) AS written FROM lineitem GROUP BY 1)"""


@query("resume_decisions", f"WITH {DECIDED} SELECT CAST(k AS VARCHAR) AS job_id, total, decision, CASE decision WHEN 'restart' THEN 0 ELSE written END AS resume_from FROM d")
def resume_decisions(spark, sf_dir):
    return decisions(spark, sf_dir)[1].select("job_id", "total", "decision", "resume_from")


@query("remaining_parts", f"WITH {DECIDED} SELECT CAST(k AS VARCHAR) AS job_id, CASE decision WHEN 'restart' THEN total ELSE total - written END AS remaining FROM d WHERE decision = 'restart' OR total > 1")
def remaining_parts(spark, sf_dir):
    left = J.remaining_parts(*decisions(spark, sf_dir))
    return left.groupBy("job_id").agg(F.count("*").alias("remaining"))


# --- inspections ------------------------------------------------------------------------------

STREAMS = """s AS (SELECT o_orderkey AS k, 'video' AS type, 'h264' AS codec, [360, 720, 1080][o_orderkey % 3 + 1] AS height, NULL AS sample_rate, CAST(o_orderkey % 5000 AS INTEGER) AS kbps FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 11 <> 0
 UNION ALL SELECT o_orderkey, 'audio', 'aac', NULL, 44100, 128 FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 5 <> 0)"""


@query("parse_inspections", f"WITH {STREAMS} SELECT CAST(k AS VARCHAR) AS job_id, type, codec, height, sample_rate, kbps, CASE type WHEN 'audio' THEN 'stereo' END AS channels FROM s")
def parse_inspections(spark, sf_dir):
    return N.parse_inspections(D.inspections(spark, sf_dir)).select(
        "job_id", "type", "codec", "height", "sample_rate", "kbps", "channels"
    )


@query("verify_outputs", """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey % 23 = 0 OR (o_orderkey % 11 = 0 AND o_orderkey % 5 = 0) AS unread, o_orderkey % 13 = 0 AS ao,
 o_orderkey % 11 <> 0 AS video, [360, 720, 1080][o_orderkey % 3 + 1] AS height, o_orderkey % 10 * 60 + 30.5 AS real FROM orders)
SELECT job_id, 'unreadable' AS code FROM o WHERE unread UNION ALL SELECT job_id, 'output' FROM o WHERE NOT unread
UNION ALL SELECT job_id, 'no_audio' FROM o WHERE NOT unread AND k % 5 = 0 UNION ALL SELECT job_id, 'no_video' FROM o WHERE NOT unread AND NOT ao AND NOT video
UNION ALL SELECT job_id, 'smaller' FROM o WHERE NOT unread AND NOT ao AND video AND height < 720
UNION ALL SELECT job_id, 'truncated' FROM o WHERE NOT unread AND NOT ao AND video AND real < 300 * 0.95""")
def verify_outputs(spark, sf_dir):
    texts = D.inspections(spark, sf_dir)
    reports = N.inspection_reports(texts, N.parse_inspections(texts))
    plans = texts.select(
        "job_id", (F.col("o_orderkey") % 13 == 0).alias("audio_only"), F.lit(720).alias("height"), F.lit(300.0).alias("expected_seconds"),
        (F.col("o_orderkey") * 1000).alias("file_bytes"),
    )
    return N.verify_outputs(plans, reports).select("job_id", "code")


@query("mux_progress", f"""WITH {J_CTE}
SELECT concat('job', page_id) AS job_id, seq, round((done_now % 3600) + 0.5, 2) AS position_seconds,
 CASE WHEN page_id % 3 = 0 THEN round(least(1, ((done_now % 3600) + 0.5) / 100), 6) WHEN done_now >= 3 THEN round(least(1, ((done_now % 3600) + 0.5) / 60.25), 6) END AS fraction
FROM j0 WHERE done_now <> 3""")
def mux_progress(spark, sf_dir):
    rows = D.from_sql(spark, sf_dir, D.JOBS_SQL, "events")
    second = F.col("done_now") % 3600
    clock = F.format_string("00:%02d:%02d.50", F.floor(second / 60), second % 60)
    line = F.when(F.col("done_now") == 3, F.lit("  Duration: 00:01:00.25, start: 0")).otherwise(F.concat(F.lit("frame=1 time="), clock, F.lit(" bitrate=1")))
    rows = rows.select(
        F.concat(F.lit("job"), F.col("page_id").cast("string")).alias("job_id"), "seq", line.alias("line"),
        F.when(F.col("page_id") % 3 == 0, F.lit(100.0)).alias("expected_seconds"),
    )
    return N.parse_mux_progress(rows).select(
        "job_id", "seq", F.round("position_seconds", 2).alias("position_seconds"), F.round("fraction", 6).alias("fraction")
    )


@query("progress_lines", f"""WITH {R_CTE} SELECT seq, content_length AS bytes, CASE seq % 3 WHEN 0 THEN 5000 WHEN 1 THEN 7000 END AS total_bytes, CASE WHEN seq % 2 = 0 THEN 12.5 ELSE 0 END AS rate FROM r WHERE seq % 10 <> 0""")
def progress_lines(spark, sf_dir):
    rows = T.responses(spark, sf_dir)
    received = F.when(F.col("seq") % 10 == 0, F.lit("NA")).otherwise(F.col("content_length").cast("string"))
    line = F.concat_ws(
        " ", F.lit("PROGRESS"), received, F.when(F.col("seq") % 3 == 0, "5000").otherwise("NA"),
        F.when(F.col("seq") % 3 == 1, "7000.0").otherwise("NA"), F.when(F.col("seq") % 2 == 0, "12.5").otherwise("NA"),
    )
    parsed = E.parse_progress_lines(rows.select(F.lit("j").alias("job_id"), "seq", line.alias("line")))
    return parsed.select("seq", "bytes", "total_bytes", "rate")
