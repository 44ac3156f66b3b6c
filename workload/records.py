"""Redaction, log and file queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from mediasift.fixtures import records as D
from mediasift.fixtures import traffic as T
from mediasift.fixtures.tables import table
from mediasift.functions import redaction as X
from mediasift.operators import files as Fi
from mediasift.operators import logs as L
from mediasift.operators import redaction as Rd

from .registry import query

R_CTE = f"r AS ({T.RESPONSES_SQL.format(events='events')})"
E_CTE = f"e AS ({D.LOG_FILES_SQL.format(events='events')})"
NOW = dt.datetime(2000, 6, 1)


@query("redact_urls", f"""WITH {R_CTE}
SELECT request_id, concat(split_part(url, '?', 1), '?token=[redigido]&q=', request_id % 3) AS url FROM r""")
def redact_urls(spark, sf_dir):
    rows = T.responses(spark, sf_dir).withColumn("url", F.concat("url", F.lit("#frag")))
    return rows.select("request_id", X.scrub_url(F.col("url")).alias("url"))


@query("redact_log", f"""WITH {E_CTE}
SELECT seq, concat('[job', page_id, '] GET ', split_part(url, '?', 1), '?token=[redigido]&q=', request_id % 3,
 CASE WHEN seq % 5 = 0 THEN ' Cookie: [redigido]' ELSE ' done' END) AS message FROM e""")
def redact_log(spark, sf_dir):
    return Rd.redact(D.log_entries(spark, sf_dir), ["message"]).select("seq", "message")


@query("redact_documents", """SELECT doc_id, text,
 concat('see https://h.example.com/a?token=[redigido]&q=1 ', text, chr(10), 'Cookie: [redigido]', chr(10), '%USERPROFILE%', chr(92), 'f.txt') AS with_secrets FROM documents""")
def redact_documents(spark, sf_dir):
    """Every text as it is, which holds nothing to redact, and with a secret of each kind around it."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    around = F.concat(
        F.lit("see https://h.example.com/a?token=t"), number, F.lit("&q=1 "), F.col("text"), F.lit("\nCookie: a="), number,
        F.lit("\nC:\\Users\\user"), number, F.lit("\\f.txt"),
    )
    return Rd.redact(docs.withColumn("with_secrets", around), ["text", "with_secrets"]).select("doc_id", "text", "with_secrets")


@query("redact_leaks", "SELECT 0 AS leaks")
def redact_leaks(spark, sf_dir):
    logs = D.log_entries(spark, sf_dir).select("message")
    texts = logs.unionByName(table(spark, sf_dir, "documents").select(F.col("text").alias("message")))
    return Rd.leak_check(Rd.redact(texts, ["message"]), "message").agg(F.count("*").alias("leaks"))


@query("redact_headers", f"""WITH {R_CTE}
SELECT request_id, '[redigido]' AS cookie, concat(split_part(url, '?', 1), '?token=[redigido]&q=', request_id % 3) AS referer FROM r""")
def redact_headers(spark, sf_dir):
    rows = T.responses(spark, sf_dir).withColumn(
        "headers", F.create_map(F.lit("Cookie"), F.lit("a=b"), F.lit("Referer"), F.col("url"))
    )
    rows = Rd.redact_header_maps(rows, "headers")
    return rows.select("request_id", F.col("headers")["Cookie"].alias("cookie"), F.col("headers")["Referer"].alias("referer"))


@query("parse_app_log", f"""WITH {E_CTE}, l AS (
SELECT strftime(ts, '%Y-%m-%d') AS log_date, seq * 2 AS line_no, level, source, 0 AS continuation,
 concat('[job', page_id, '] GET ', url, CASE WHEN seq % 5 = 0 THEN concat(' Cookie: sid=', seq) ELSE ' done' END) AS message FROM e
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), seq * 2 + 1, level, source, 1, concat('IOException: part ', seq) FROM e WHERE seq % 13 = 0)
SELECT * FROM l""")
def parse_app_log(spark, sf_dir):
    parsed = L.parse_app_log(D.log_lines(spark, sf_dir))
    return parsed.select(
        F.col("log_date").cast("string").alias("log_date"), "line_no", "level", "source",
        F.col("is_continuation").cast("int").alias("continuation"), "message",
    )


@query("log_profile", f"""WITH {E_CTE}
SELECT strftime(ts, '%Y-%m-%d') AS log_date, level, source, count(*) AS lines FROM e GROUP BY 1, 2, 3""")
def log_profile(spark, sf_dir):
    profile = L.log_profile(L.parse_app_log(D.log_lines(spark, sf_dir)))
    return profile.withColumn("log_date", F.col("log_date").cast("string"))


@query("job_warnings", f"""WITH {E_CTE}
SELECT concat('job', page_id) AS job_id, count(*) FILTER (level = 'WARN') AS warnings, count(*) FILTER (level = 'ERROR') AS errors
FROM e WHERE level IN ('WARN', 'ERROR') GROUP BY 1""")
def job_warnings(spark, sf_dir):
    return L.job_warnings(L.parse_app_log(D.log_lines(spark, sf_dir)))


@query("format_log", f"""WITH {E_CTE}
SELECT strftime(ts, '%Y-%m-%d') AS log_date, concat(strftime(ts, '%H:%M:%S.%g'), '  ', rpad(level, 5, ' '), '  ', rpad(source, 18, ' '), '  [job', page_id, '] GET ',
 split_part(url, '?', 1), '?token=[redigido]&q=', request_id % 3, CASE WHEN seq % 5 = 0 THEN ' Cookie: [redigido]' ELSE ' done' END) AS line
FROM e WHERE level <> 'DEBUG'""")
def format_log(spark, sf_dir):
    lines = L.format_log(D.log_entries(spark, sf_dir))
    return lines.select(F.col("log_date").cast("string").alias("log_date"), "line")


@query("expired_logs", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '2000-05-25' AND o_orderkey % 5 <> 0""")
def expired_logs(spark, sf_dir):
    return L.expired_logs(D.listing(spark, sf_dir), NOW, prefix="app-").select("o_orderkey")


@query("orphan_sweep", """
SELECT folder, sum(size) AS bytes, count(*) AS files FROM (SELECT concat('work/', CASE WHEN o_orderkey % 3 = 0 THEN 'app-' ELSE 'job-' END, o_custkey) AS folder,
 CAST(round(o_totalprice) AS BIGINT) AS size, o_orderdate FROM orders) GROUP BY 1 HAVING max(o_orderdate) <= TIMESTAMP '2000-05-31 18:00:00'""")
def orphan_sweep(spark, sf_dir):
    return Fi.orphan_sweep(D.listing(spark, sf_dir), NOW).select("folder", "bytes", "files")


@query("orphan_totals", """
SELECT 'work' AS root, count(*) AS folders, sum(bytes) AS bytes, sum(files) AS files FROM (
SELECT sum(CAST(round(o_totalprice) AS BIGINT)) AS bytes, count(*) AS files FROM orders
 GROUP BY o_orderkey % 3 = 0, o_custkey HAVING max(o_orderdate) <= TIMESTAMP '2000-05-31 18:00:00')""")
def orphan_totals(spark, sf_dir):
    return Fi.orphan_totals(Fi.orphan_sweep(D.listing(spark, sf_dir), NOW))


@query("parse_checksums", """
SELECT CAST(doc_id // 100 AS VARCHAR) AS list_id, concat('doc-', doc_id, '.txt') AS name_key,
 CASE WHEN doc_id % 17 = 0 THEN concat('00000000', substr(sha256(text), 9)) ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 11 <> 0""")
def parse_checksums(spark, sf_dir):
    return Fi.parse_checksums(D.checksum_lists(spark, sf_dir)).select("list_id", "name_key", "sha256")


@query("verify_checksums", """
SELECT concat('Doc-', doc_id, '.txt') AS name, CASE WHEN doc_id % 11 = 0 THEN 'unlisted'
 WHEN doc_id % 17 = 0 AND NOT starts_with(sha256(text), '00000000') THEN 'mismatch' ELSE 'match' END AS verdict FROM documents""")
def verify_checksums(spark, sf_dir):
    sums = Fi.parse_checksums(D.checksum_lists(spark, sf_dir))
    return Fi.verify_checksums(D.checksum_files(spark, sf_dir), sums).select("name", "verdict")


@query("capacity_check", """
SELECT o_orderkey, CASE WHEN est <= 0 THEN 268435456 ELSE greatest(268435456, CAST(floor(est * 2.2::DOUBLE) AS BIGINT)) END AS required_bytes,
 CAST(CASE WHEN o_orderkey % 7 IN (0, 6) THEN true ELSE (o_orderkey % 7) * 200000000 >= greatest(268435456, CAST(floor(est * 2.2::DOUBLE) AS BIGINT)) END AS INTEGER) AS fits
FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) * 1000 AS est FROM orders)""")
def capacity_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    plans = orders.select(
        "o_orderkey", (F.col("o_orderkey") % 7).cast("string").alias("root"),
        (F.round("o_totalprice").cast("bigint") * 1000).alias("estimated_bytes"),
    )
    # Volume 0 is not listed and volume 6 does not say how much is free.
    volumes = orders.select((F.col("o_orderkey") % 7).alias("v")).filter("v > 0").groupBy("v").agg(
        F.when(F.first("v") < 6, F.first("v") * 200_000_000).alias("free_bytes")
    ).select(F.col("v").cast("string").alias("root"), "free_bytes")
    return Fi.capacity_check(plans, volumes).select("o_orderkey", "required_bytes", F.col("fits").cast("int").alias("fits"))


@query("range_plan", """
WITH f AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) * 200 AS total, o_orderkey % 5 <> 0 AS ok FROM orders),
c AS (SELECT k, total, ok AND total >= 25165824 AS split, CAST(ceil(total / 4.0) AS BIGINT) AS chunk FROM f),
p AS (SELECT k, total, split, chunk, unnest(range(0, 4)) AS i FROM c)
SELECT k AS file_id, i AS part_no, CASE WHEN split THEN concat('bytes=', i * chunk, '-', least((i + 1) * chunk, total) - 1) ELSE 'bytes=0-' END AS range
FROM p WHERE (split AND i * chunk < total) OR (NOT split AND i = 0)""")
def range_plan(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"), (F.round("o_totalprice").cast("bigint") * 200).alias("total_bytes"),
        (F.col("o_orderkey") % 5 != 0).alias("accepts_ranges"),
    )
    return Fi.range_plan(files).select("file_id", "part_no", "range")


@query("block_plan", """
SELECT k AS file_id, i AS block_no, i * 8388608 AS start, least((i + 1) * 8388608, total) - 1 AS "end"
FROM (SELECT k, total, unnest(range(0, (total + 8388607) // 8388608)) AS i FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) * 200 AS total FROM orders))""")
def block_plan(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"), (F.round("o_totalprice").cast("bigint") * 200).alias("total_bytes")
    )
    return Fi.block_plan(files).select("file_id", "block_no", "start", "end")
