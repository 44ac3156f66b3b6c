"""Capture, page and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.fixtures import captures as C
from mediasift.fixtures import traffic as T
from mediasift.operators import detection as D
from mediasift.operators import events as E
from mediasift.operators import registry as R
from mediasift.operators import reports as P

from .registry import query
from .traffic import CANDIDATES, KEY

R_CTE = f"r AS ({T.RESPONSES_SQL.format(events='events')})"


@query("correlate_requests", f"""WITH {R_CTE}
SELECT concat('r', request_id) AS request_id, page_id AS visit_id, url, mime_type, content_length, resource_type,
 CASE WHEN request_id % 11 <> 0 THEN concat('c=', request_id) END AS cookie,
 CASE WHEN request_id % 13 <> 0 THEN 'agent' ELSE 'default' END AS agent,
 CASE WHEN request_id % 11 <> 0 THEN 'extra' WHEN request_id % 13 <> 0 THEN 'plain' END AS x_token, NULL AS range_header,
 regexp_extract(page_url, '^https://[^/]*', 0) AS origin FROM r""")
def correlate_requests(spark, sf_dir):
    events = E.parse_net_events(C.net_events(spark, sf_dir))
    seen = E.correlate_requests(events, C.visits(spark, sf_dir))
    get = lambda path: F.get_json_object("request", path)
    agent = get("$.user_agent")
    return seen.select(
        "request_id", "visit_id", "url", "mime_type", "content_length", "resource_type", "cookie",
        F.when(agent == "agent", agent).otherwise("default").alias("agent"), get("$.extra['x-token']").alias("x_token"),
        get("$.extra.range").alias("range_header"), get("$.origin").alias("origin"),
    )


@query("refresh_requests", f"""WITH {R_CTE},
seen AS (SELECT {KEY} AS candidate_key, arg_max(concat('c=', request_id), request_id) FILTER (request_id % 11 <> 0) AS cookie
 FROM r WHERE request_id % 19 <> 0 AND event_type <> 'click' GROUP BY 1)
SELECT candidate_key, hit_count, seen.cookie FROM ({CANDIDATES}) AS c LEFT JOIN seen USING (candidate_key)""")
def refresh_requests(spark, sf_dir):
    rows = T.responses(spark, sf_dir).withColumn("cookie", F.lit(None).cast("string"))
    found = R.candidates(R.filter_candidates(R.classify_observations(rows)))
    seen = E.correlate_requests(E.parse_net_events(C.net_events(spark, sf_dir)))
    return E.refresh_requests(found, seen).select("candidate_key", "hit_count", "cookie")


@query("dom_elements", f"""WITH {R_CTE} SELECT page_id, seq, url, page_title, page_url FROM r WHERE event_type = 'purchase' AND seq % 29 <> 0""")
def dom_elements(spark, sf_dir):
    return E.read_dom_reports(C.dom_reports(spark, sf_dir))[0].select("page_id", "seq", "url", "page_title", "page_url")


@query("blob_only_pages", f"""WITH {R_CTE}
SELECT page_url, count(*) AS blob_players FROM r WHERE event_type = 'view' AND seq % 29 <> 0
 AND page_url NOT IN (SELECT page_url FROM r WHERE event_type = 'signup' AND seq % 7 = 0) GROUP BY 1""")
def blob_only_pages(spark, sf_dir):
    _, blobs = E.read_dom_reports(C.dom_reports(spark, sf_dir))
    signups = T.responses(spark, sf_dir).filter("event_type = 'signup' and seq % 7 = 0")
    return E.blob_only_pages(blobs, signups)


@query("html_media_elements", """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^(https?://[^/?#]*(/([^?#]*/)?)?)', 1) AS dir FROM pages)
SELECT page_id, 'video' AS tag, concat(lower(origin), '/v/', page_id, '.mp4?a=1&b=2') AS src FROM p
UNION ALL SELECT page_id, 'source', concat(dir, CASE WHEN ends_with(dir, '/') THEN '' ELSE '/' END, 'alt.webm') FROM p
UNION ALL SELECT page_id, 'audio', concat('https://cdn.example.com/', page_id, '.mp3') FROM p""")
def html_media_elements(spark, sf_dir):
    return E.html_media_elements(C.media_pages(spark, sf_dir)).select("page_id", "tag", "src")


@query("union_observations", f"""WITH {R_CTE} SELECT 'network' AS origin, count(*) AS n, count(DISTINCT url) AS urls FROM r
UNION ALL SELECT 'dom', count(*), count(DISTINCT url) FROM r WHERE event_type = 'purchase' AND seq % 29 <> 0
UNION ALL SELECT 'manual', count(*), count(DISTINCT url) FROM r WHERE seq % 97 = 0""")
def union_observations(spark, sf_dir):
    network = T.responses(spark, sf_dir)
    elements, _ = E.read_dom_reports(C.dom_reports(spark, sf_dir))
    rows = R.union_observations(network, elements, network.filter("seq % 97 = 0").select("url", "ts", "seq"))
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


SEEN = """t AS (SELECT n_nationkey AS k, n_name AS name, ['any_media', 'stream', 'file', 'video', 'drm_refusal'][n_nationkey % 5 + 1] AS expectation FROM nation),
o AS (SELECT n_name AS target, s_suppkey AS ordinal, ['progressive_audio', 'hls_playlist', 'page_embed', 'subtitle', 'progressive_video'][(s_suppkey * 7 + s_nationkey) % 5 + 1] AS kind,
 ['Audio file', 'HLS', 'Page', 'Subtitle', 'Video file'][(s_suppkey * 7 + s_nationkey) % 5 + 1] AS kind_label, s_suppkey % 13 = 0 AS drm, s_suppkey % 4 AS variants
 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 6 <> 0),
m AS (SELECT target, count(*) AS n, bool_or(kind = 'hls_playlist') AS stream, bool_or(kind IN ('progressive_audio', 'progressive_video')) AS file,
 bool_or(kind IN ('hls_playlist', 'progressive_video') OR (kind = 'page_embed' AND variants > 0)) AS video, bool_or(drm) AS drm FROM o GROUP BY 1),
j AS (SELECT t.*, coalesce(n, 0) AS n, coalesce(CASE expectation WHEN 'stream' THEN stream WHEN 'video' THEN video WHEN 'file' THEN file WHEN 'drm_refusal' THEN drm ELSE n > 0 END, false) AS ok
 FROM t LEFT JOIN m ON name = target),
verdicts AS (SELECT *, CASE WHEN k = 7 THEN 'error' WHEN n = 0 AND k IN (0, 8) THEN 'error' WHEN NOT ok AND k % 4 = 0 AND k NOT IN (0, 8) THEN 'error' WHEN ok THEN 'passed' ELSE 'failed' END AS outcome FROM j)"""


def verdicts(spark, sf_dir):
    return D.judge(C.targets(spark, sf_dir), C.observations(spark, sf_dir), C.detection_visits(spark, sf_dir))


@query("judge", f"WITH {SEEN} SELECT name, outcome, n AS observed FROM verdicts")
def judge(spark, sf_dir):
    return verdicts(spark, sf_dir).select("name", "outcome", "observed")


@query("pass_rate", f"WITH {SEEN} SELECT count(*) FILTER (outcome = 'passed') AS passed, count(*) AS total, CAST(bool_or(outcome <> 'passed') AS INTEGER) AS exit_status FROM verdicts")
def pass_rate(spark, sf_dir):
    return D.pass_rate(verdicts(spark, sf_dir))


@query("kind_summary", f"""WITH {SEEN}, g AS (SELECT target, kind_label, count(*) AS n, min(ordinal) AS first FROM o GROUP BY 1, 2)
SELECT target, string_agg(CASE WHEN n = 1 THEN kind_label ELSE concat(kind_label, ' x', n) END, ', ' ORDER BY first) AS kinds FROM g GROUP BY 1""")
def kind_summary(spark, sf_dir):
    return D.kind_summary(C.observations(spark, sf_dir))


@query("select_targets", "SELECT n_name AS name FROM nation WHERE contains(n_name, '1')")
def select_targets(spark, sf_dir):
    return D.select_targets(C.targets(spark, sf_dir), "ation_1").unionByName(
        D.select_targets(C.targets(spark, sf_dir), "nation_21")
    ).select("name")


@query("download_outcomes", f"""WITH {SEEN}, a AS (SELECT target, count(*) AS attempts, min(ordinal) FILTER (ordinal % 5 = 0 OR ordinal % 7 = 0) AS hit, min(ordinal) AS head FROM o GROUP BY 1)
SELECT name, coalesce(attempts, 0) AS attempts, CASE WHEN attempts IS NULL THEN 'no_candidate' WHEN hit IS NULL THEN 'failed' WHEN hit % 5 = 0 THEN 'downloaded' ELSE 'downloading' END AS outcome,
 coalesce(hit, head) * 4096 AS best_bytes FROM t LEFT JOIN a ON name = target""")
def download_outcomes(spark, sf_dir):
    outcomes = D.download_outcomes(C.targets(spark, sf_dir), C.attempts(spark, sf_dir))
    return outcomes.select("name", "attempts", "outcome", F.col("best.bytes").alias("best_bytes"))


def numbered(lines: list[tuple[int, str]], columns: str, source: str) -> str:
    """A row per line of every row of ``source``; a line that is NULL is none."""
    rows = " UNION ALL ".join(f"SELECT {columns}, {n} AS line_no, {text} AS line FROM {source}" for n, text in lines)
    return f"SELECT * FROM ({rows}) WHERE line IS NOT NULL"


DETECTION_LINES = [
    (0, "''"), (1, "concat('## ', CASE outcome WHEN 'passed' THEN '[ok]' WHEN 'failed' THEN '[failed]' ELSE '[error]' END, ' ', name)"), (2, "''"),
    (3, "concat('- Page: `https://site.example.com/', k, '?token=[redigido]`')"),
    (4, """concat('- Expected: ', CASE expectation WHEN 'stream' THEN 'an HLS or DASH manifest' WHEN 'file' THEN 'a progressive file'
 WHEN 'video' THEN 'a video: file, manifest, or extracted page' WHEN 'drm_refusal' THEN 'recognise the DRM and refuse' ELSE 'any downloadable media' END)"""),
    (5, """concat('- Result: ', CASE WHEN outcome = 'error' THEN CASE WHEN k = 7 THEN 'budget spent' WHEN k IN (0, 8) THEN 'navigation failed' ELSE 'the player never started' END
 ELSE concat(CASE WHEN ok THEN CASE expectation WHEN 'stream' THEN 'manifest detected' WHEN 'video' THEN 'video detected' WHEN 'file' THEN 'progressive file detected'
  WHEN 'drm_refusal' THEN 'DRM recognised and refused' ELSE 'media detected' END
 WHEN expectation = 'stream' THEN 'no HLS or DASH manifest appeared' WHEN expectation = 'video' AND n > 0 THEN 'only media that is no video appeared'
 WHEN expectation = 'file' THEN 'no progressive file appeared' WHEN expectation = 'drm_refusal' AND n = 0 THEN 'nothing detected, so refusal is not shown'
 WHEN expectation = 'drm_refusal' THEN 'media detected without recognising protection' ELSE 'no media detected' END, CASE WHEN kinds IS NULL THEN '' ELSE concat(' (', kinds, ')') END) END)"""),
    (6, "concat('- Time: ', printf('%.1f', k * 1.5::DOUBLE), 's')"),
    (7, "CASE WHEN n > 0 THEN '' END"), (8, "CASE WHEN n > 0 THEN '| Kind | Qualities | Size | URL |' END"), (9, "CASE WHEN n > 0 THEN '| --- | --- | --- | --- |' END"),
]
DETECTION_HEAD = [
    (0, "'# Detection check'"), (1, "''"), (2, "'run 1'"), (3, "''"),
    (4, "concat('**', passed, ' of ', total, '** targets passed.')"),
]


@query("detection_report", f"""WITH {SEEN}, g AS (SELECT target, kind_label, count(*) AS c, min(ordinal) AS first FROM o GROUP BY 1, 2),
l AS (SELECT target, string_agg(CASE WHEN c = 1 THEN kind_label ELSE concat(kind_label, ' x', c) END, ', ' ORDER BY first) AS kinds FROM g GROUP BY 1),
totals AS (SELECT count(*) FILTER (outcome = 'passed') AS passed, count(*) AS total FROM verdicts),
d AS (SELECT verdicts.*, kinds FROM verdicts LEFT JOIN l ON target = name)
SELECT k AS section, 1 AS part, ordinal AS item, 0 AS line_no, concat('| ', kind_label, ' | ', CASE WHEN drm THEN CASE WHEN ordinal % 26 = 0 THEN 'DRM: Widevine' ELSE 'DRM: unknown' END WHEN variants > 0 THEN CAST(variants AS VARCHAR)
 WHEN ordinal % 8 = 0 THEN 'failed at https://h/x?token=[redigido]' ELSE '-' END, ' | ',
 CASE WHEN ordinal % 3 = 0 THEN '-' WHEN ordinal < 512 THEN concat(ordinal * 2, ' KB') ELSE concat(regexp_replace(printf('%.1f', round(ordinal / 512.0::DOUBLE, 1)), '\\.0$', ''), ' MB') END,
 ' | `https://cdn.example.com/', ordinal, '?sig=[redigido]&n=1` |') AS line FROM o JOIN t ON name = target
UNION ALL {numbered(DETECTION_LINES, "k AS section, 0 AS part, 0 AS item", "d")}
UNION ALL {numbered(DETECTION_HEAD, "-1 AS section, 0 AS part, 0 AS item", "totals")}""")
def detection_report(spark, sf_dir):
    lines = P.render_detection_report(verdicts(spark, sf_dir), C.observations(spark, sf_dir), "run 1")
    return lines.select("section", "part", "item", "line_no", "line")


def moved(ordinal: str) -> str:
    """The label of ``ordinal`` times 4096 bytes."""
    return f"CASE WHEN {ordinal} >= 256 THEN printf('%.1f MB', round({ordinal} / 256.0::DOUBLE, 1)) ELSE printf('%.1f KB', {ordinal} * 4.0::DOUBLE) END"


ATTEMPT_HEAD = [
    (0, "'# Download check, run 1'"), (1, "''"), (2, "concat(passed, '/', total, ' downloaded')"), (3, "''"),
    (4, "'| Target | Result | Via | Bytes | Error |'"), (5, "'| --- | --- | --- | --- | --- |'"),
]
ATTEMPT_SECTION = [(0, "''"), (1, "concat('## ', name)"), (2, "''"), (3, "concat('- Page: `https://site.example.com/', k, '?token=abc`')")]
ATTEMPT_ITEM = [
    (0, f"""concat('- ', result, ', ', kind, ' via ', CASE WHEN ordinal % 2 = 0 THEN 'native' ELSE '-' END, ', 720p, ', {moved("ordinal")}, ' in ', ordinal % 50,
 's, `https://cdn.example.com/', ordinal, '?sig=[redigido]&n=1`')"""),
    (1, "CASE WHEN result = 'failed' THEN '  - error: a\\|b c' END"),
]


@query("attempt_report", f"""WITH {SEEN}, a AS (SELECT target, min(ordinal) FILTER (ordinal % 5 = 0 OR ordinal % 7 = 0) AS hit, min(ordinal) AS head FROM o GROUP BY 1),
f AS (SELECT k, name, coalesce(hit, head) AS best, hit, head FROM t LEFT JOIN a ON name = target), tried AS (SELECT * FROM f WHERE head IS NOT NULL),
totals AS (SELECT count(hit) AS passed, count(*) AS total FROM f),
i AS (SELECT o.*, k, CASE WHEN ordinal % 5 = 0 THEN 'downloaded' WHEN ordinal % 7 = 0 THEN 'downloading' ELSE 'failed' END AS result FROM o JOIN t ON name = target)
SELECT -1 AS section, 0 AS part, k AS item, 0 AS line_no, concat('| ', name, ' | ', CASE WHEN head IS NULL THEN 'no_candidate' WHEN hit IS NULL THEN 'failed' WHEN hit % 5 = 0 THEN 'downloaded' ELSE 'downloading' END,
 ' | ', CASE WHEN best % 2 = 0 THEN 'native' ELSE '-' END, ' | ', CASE WHEN best IS NULL THEN '-' ELSE {moved("best")} END,
 ' | ', CASE WHEN head IS NOT NULL AND hit IS NULL THEN 'a\\|b c' ELSE '-' END, ' |') AS line FROM f
UNION ALL {numbered(ATTEMPT_HEAD, "-2 AS section, 0 AS part, 0 AS item", "totals")}
UNION ALL {numbered(ATTEMPT_SECTION, "k AS section, 0 AS part, 0 AS item", "tried")}
UNION ALL {numbered(ATTEMPT_ITEM, "k AS section, 1 AS part, ordinal AS item", "i")}""")
def attempt_report(spark, sf_dir):
    outcomes = D.download_outcomes(C.targets(spark, sf_dir), C.attempts(spark, sf_dir))
    lines = P.render_attempt_report(outcomes, C.attempts(spark, sf_dir), "run 1")
    return lines.select("section", "part", "item", "line_no", "line")
