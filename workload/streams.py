"""Streaming queries over the event table, checked against the same rows in batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.fixtures import captures as C
from mediasift.fixtures import traffic as T
from mediasift.fixtures import transfers as D
from mediasift.operators import events as E
from mediasift.operators import rates
from mediasift.operators import registry as R
from mediasift.operators.ordered import first_per
from mediasift.streaming import live, processors, stateful
from mediasift.streaming.changes import CandidateTable, stream_registry
from mediasift.streaming.running import drain, shared_folder

from .captures import R_CTE
from .registry import query
from .traffic import ACCEPTED, KEY
from .transfers import EVENTS, PROGRESS


def stream_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A file stream over a table in two arrivals, the lower half of ``seq`` first.

    A trigger takes a number of files, so the halves are given equally many, and a half that wrote fewer gets empty ones:
    otherwise one arrival would reach into the other, and its rows come late.
    """
    folder = shared_folder(spark)
    middle = df.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    df.filter(F.col("seq") <= middle).write.mode("append").parquet(folder)
    count = lambda: len(spark.read.schema(df.schema).parquet(folder).inputFiles())
    first = count()
    upper = df.filter(F.col("seq") > middle).repartition(first)
    upper.write.mode("append").parquet(folder)
    for _ in range(2 * first - count()):
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", first).parquet(folder)


def responses(spark, sf_dir) -> DataFrame:
    return T.responses(spark, sf_dir).withColumn("visit_id", F.col("page_id"))


@query("stream_candidates", f"WITH {R_CTE} SELECT page_id AS visit_id, {KEY} AS candidate_key, count(*) AS hit_count, epoch_us(max(ts)) AS last_seen_us FROM r WHERE event_type <> 'click' AND {ACCEPTED} GROUP BY 1, 2")
def stream_candidates(spark, sf_dir):
    updates = drain(live.stream_candidates(stream_of(spark, responses(spark, sf_dir))), "update")
    latest = updates.groupBy("visit_id", "candidate_key", "period").agg(F.max("hit_count").alias("hit_count"), F.max("last_seen").alias("t"))
    merged = latest.groupBy("visit_id", "candidate_key").agg(F.sum("hit_count").alias("hit_count"), F.max("t").alias("t"))
    return merged.select("visit_id", "candidate_key", "hit_count", F.unix_micros("t").alias("last_seen_us"))


@query("stream_registry_changes", f"""WITH {R_CTE}, h AS (SELECT CAST(floor(max(seq) / 2) AS BIGINT) AS middle FROM r),
c AS (SELECT page_id AS visit_id, date_trunc('day', ts) AS day, {KEY} AS candidate_key, CAST(seq > middle AS INTEGER) AS batch, count(*) AS n FROM r, h WHERE event_type <> 'click' AND {ACCEPTED} GROUP BY ALL)
SELECT visit_id, CAST(day AS DATE) AS day, candidate_key, batch, CASE WHEN min(batch) OVER k < batch THEN 'updated' ELSE 'added' END AS change,
 CAST(sum(n) OVER (k ORDER BY batch) AS BIGINT) AS hit_count FROM c WINDOW k AS (PARTITION BY visit_id, day, candidate_key)""")
def stream_registry_changes(spark, sf_dir):
    """What each of two arrivals adds to the kept table and updates there."""
    rows = responses(spark, sf_dir)
    folder, table = shared_folder(spark), CandidateTable(shared_folder(spark), buckets=4)
    middle = rows.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.filter(half).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream_registry(arriving, table, shared_folder(spark)).awaitTermination()
    told = table.changes(rows, 0).unionByName(table.changes(rows, 1))
    return told.select("visit_id", F.to_date("day").alias("day"), "candidate_key", F.col("last_batch").cast("int").alias("batch"), F.col("last_change").alias("change"), "hit_count")


@query("stream_families", f"""WITH {R_CTE} SELECT page_id AS visit_id, concat('cdn', page_id % 4, '.example.com/v', page_id % 7) AS family, count(*) AS segment_count, sum(content_length) AS total_bytes
FROM r WHERE event_type = 'click' AND request_id % 19 <> 0 GROUP BY 1, 2""")
def stream_families(spark, sf_dir):
    updates = drain(live.stream_families(stream_of(spark, responses(spark, sf_dir))), "update")
    latest = updates.groupBy("visit_id", "family", "period").agg(F.max("segment_count").alias("segment_count"), F.max("total_bytes").alias("total_bytes"))
    return latest.groupBy("visit_id", "family").agg(F.sum("segment_count").alias("segment_count"), F.sum("total_bytes").alias("total_bytes"))


@query("stream_correlate", f"""WITH {R_CTE} SELECT concat('r', request_id) AS request_id, page_id AS visit_id, content_length,
 CASE WHEN request_id % 11 <> 0 THEN concat('c=', request_id) END AS cookie FROM r""")
def stream_correlate(spark, sf_dir):
    events = C.net_events(spark, sf_dir)
    # One request, extra and response a day behind all others: they move the watermarks past the last real row.
    end = events.agg((F.max("seq") + 1).alias("seq"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    behind = end.select(
        F.lit(-1).cast("bigint").alias("visit_id"), "seq", "ts", F.explode(F.array(*map(F.lit, E.METHODS[:3]))).alias("method"),
        F.lit('{"requestId":"end"}').alias("params"),
    )
    rows = drain(live.stream_correlate(E.parse_net_events(stream_of(spark, events.unionByName(behind)))))
    return rows.filter("visit_id >= 0").select("request_id", "visit_id", "content_length", "cookie")


@query("stream_once", f"WITH {R_CTE} SELECT DISTINCT concat('cdn', page_id % 4) AS host, CAST(floor(epoch(ts) / 86400) AS INTEGER) AS day FROM r")
def stream_once(spark, sf_dir):
    """A host once a day: a key is held for two days and then forgotten."""
    rows = responses(spark, sf_dir).withColumn("host", F.concat(F.lit("cdn"), (F.col("page_id") % 4).cast("string")))
    rows = rows.withColumn("day", F.floor(F.unix_seconds("ts") / 86400).cast("int"))
    return drain(live.stream_once(stream_of(spark, rows), ["host", "day"], "2 days")).select("host", "day")


@query("stream_refresh", f"""WITH {R_CTE} SELECT concat('r', request_id) AS request_id, url, content_length,
 CASE WHEN request_id % 11 <> 0 THEN concat('c=', request_id) END AS cookie, CAST(request_id % 11 <> 0 AND request_id % 7 = 0 AS INTEGER) AS refreshed FROM r""")
def stream_refresh(spark, sf_dir):
    events = E.parse_net_events(stream_of(spark, C.net_events(spark, sf_dir)))
    rows = drain(processors.stream_refresh(events), "update")
    last = rows.groupBy("request_id", "url", "content_length").agg(
        F.max_by("cookie", F.col("refreshed").cast("int")).alias("cookie"), F.max(F.col("refreshed").cast("int")).alias("refreshed")
    )
    return last


@query("stream_protection", f"""WITH {R_CTE}, c AS (SELECT DISTINCT page_id, {KEY} AS k FROM r WHERE event_type <> 'click' AND {ACCEPTED}),
m AS (SELECT DISTINCT page_id FROM r WHERE event_type = 'signup' AND page_id % 7 = 3 AND seq % 19 <> 0)
SELECT c.page_id AS visit_id, concat('cdn', c.page_id % 4, '.example.com/v', c.page_id % 7) AS family, count(*) AS candidates, CAST(any_value(m.page_id) IS NOT NULL AS INTEGER) AS is_protected
FROM c LEFT JOIN m ON c.page_id = m.page_id GROUP BY c.page_id""")
def stream_protection(spark, sf_dir):
    rows = responses(spark, sf_dir)
    found = first_per(R.observed_candidates(live.stream_observations(rows)), ["visit_id", "candidate_key"], ["seq"])
    packages = rows.filter("event_type = 'signup' and page_id % 7 = 3 and seq % 19 <> 0").select(
        "visit_id", F.col("url").alias("manifest_url"), "ts", "seq", F.lit("Widevine").alias("system")
    )
    events = live.protection_events(found.select("visit_id", "url", "ts", "seq"), packages)
    emitted = drain(processors.stream_protection(stream_of(spark, events)), "update")
    final = emitted.groupBy("visit_id", "family", "url").agg(F.max(F.col("is_protected").cast("int")).alias("p"))
    return final.groupBy("visit_id", "family").agg(F.count("*").alias("candidates"), F.max("p").alias("is_protected"))


@query("stream_jobs", f"""WITH {PROGRESS}, {EVENTS},
x AS (SELECT concat(job_id, '-a', attempt) AS job_id, seq, state AS now, CASE state WHEN 'muxing' THEN 'finalizing' WHEN 'downloading' THEN 'video' END AS stage FROM e),
q AS (SELECT job_id, seq, CASE stage WHEN 'finalizing' THEN 'muxing' ELSE 'downloading' END AS now, stage, prev, decile, reached FROM s
 UNION ALL SELECT job_id, seq, now, stage, lag(stage) OVER (PARTITION BY job_id, stage IS NULL ORDER BY seq), -1, -1 FROM x),
n AS (SELECT *, min(seq) FILTER (now IN ('completed', 'failed', 'canceled')) OVER (PARTITION BY job_id) AS last, lag(now) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM q),
k AS (SELECT * FROM n WHERE last IS NULL OR seq <= last)
SELECT job_id, seq, 'state' AS event, now AS detail FROM k WHERE before IS NULL OR before <> now
UNION ALL SELECT job_id, seq, 'stage', stage FROM k WHERE stage IS NOT NULL AND (prev IS NULL OR prev <> stage)
UNION ALL SELECT job_id, seq, 'milestone', concat(stage, ' ', decile * 10, '%') FROM k WHERE prev = stage AND decile > reached""")
def stream_jobs(spark, sf_dir):
    """Progress of one set of jobs and the state events of another, with reports after the end."""
    progress = D.progress_events(spark, sf_dir).withColumn("state", F.lit(None).cast("string"))
    states = D.job_events(spark, sf_dir).withColumn("job_id", F.concat("job_id", F.lit("-a"), F.col("attempt").cast("string")))
    events = progress.unionByName(states, allowMissingColumns=True).select(progress.columns)
    return drain(processors.stream_jobs(stream_of(spark, events)), "update").select("job_id", "seq", "event", "detail")


RATE = f"""WITH RECURSIVE {R_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS i, epoch_us(ts) AS t, greatest(content_length, 0) AS b, epoch_us(min(ts) OVER (PARTITION BY page_id)) AS t0 FROM r),
w AS (SELECT page_id, i, seq, t AS opened, 0::BIGINT AS held, b AS total, 0.0::DOUBLE AS rate, t, t0 FROM n WHERE i = 1
 UNION ALL SELECT n.page_id, n.i, n.seq, CASE WHEN (n.t - w.opened) / 1e6 >= 0.5 THEN n.t ELSE w.opened END, CASE WHEN (n.t - w.opened) / 1e6 >= 0.5 THEN 0 ELSE w.held + n.b + CASE WHEN w.i = 1 THEN w.total ELSE 0 END END, w.total + n.b,
 CASE WHEN (n.t - w.opened) / 1e6 < 0.5 THEN w.rate WHEN w.rate <= 0 THEN (w.held + n.b + CASE WHEN w.i = 1 THEN w.total ELSE 0 END) / ((n.t - w.opened) / 1e6) ELSE w.rate * 0.6 + 0.4 * (w.held + n.b + CASE WHEN w.i = 1 THEN w.total ELSE 0 END) / ((n.t - w.opened) / 1e6) END, n.t, n.t0
 FROM w JOIN n ON n.page_id = w.page_id AND n.i = w.i + 1)
SELECT concat('job', page_id) AS job_id, seq, round(CASE WHEN rate > 0 THEN rate WHEN (t - t0) / 1e6 > 0.1 AND total > 0 THEN total / ((t - t0) / 1e6) ELSE 0 END, 4) AS rate FROM w"""


@query("stream_rate", RATE)
def stream_rate(spark, sf_dir):
    rows = drain(stateful.stream_rate(stream_of(spark, transfer_samples(spark, sf_dir))), "update")
    return rows.select("job_id", "seq", F.round("bytes_per_second", 4).alias("rate"))


@query("smoothed_rate", RATE)
def smoothed_rate(spark, sf_dir):
    rows = rates.smoothed_rate(transfer_samples(spark, sf_dir))
    return rows.select("job_id", "seq", F.round("bytes_per_second", 4).alias("rate"))


def transfer_samples(spark, sf_dir) -> DataFrame:
    rows = T.responses(spark, sf_dir).select(
        F.concat(F.lit("job"), F.col("page_id").cast("string")).alias("job_id"), "seq", "ts", F.greatest("content_length", F.lit(0)).alias("bytes")
    )
    return rows.withColumn("started_at", F.lit(None).cast("timestamp"))


QUIET = f"""WITH {R_CTE}, n AS (SELECT page_id AS visit_id, {KEY} AS k, min(epoch_us(ts)) AS t FROM r WHERE event_type <> 'click' AND {ACCEPTED} GROUP BY 1, 2),
g AS (SELECT *, min(t) OVER (PARTITION BY visit_id) AS opened, t - lag(t, 1, t) OVER (PARTITION BY visit_id ORDER BY t, k) AS gap FROM n),
s AS (SELECT *, sum(CASE WHEN gap > {{quiet}} THEN 1 ELSE 0 END) OVER (PARTITION BY visit_id ORDER BY t, k) AS stretch FROM g)
SELECT visit_id, count(*) AS new_candidates, min(t) AS opened_us, max(t) AS last_new_us, least(max(t) + {{quiet}}, min(opened) + {{cap}}) AS closed_us,
 CAST(max(t) + {{quiet}} > min(opened) + {{cap}} AS INTEGER) AS hit_cap FROM s WHERE stretch = 0 AND t <= opened + {{cap}} GROUP BY 1"""
HOUR_US = 3_600_000_000


@query("stream_quiet_visits", QUIET.format(quiet=30 * HOUR_US, cap=200 * HOUR_US))
def stream_quiet_visits(spark, sf_dir):
    """Events lie hours apart here, so a visit is quiet after 30 hours and capped at 200."""
    rows = responses(spark, sf_dir)
    last = rows.orderBy(F.desc("ts")).limit(1).withColumns({"visit_id": F.lit(-1).cast("bigint"), "ts": F.col("ts") + F.expr("INTERVAL 900 DAY"), "seq": F.col("seq") + 1})
    observed = live.stream_observations(stream_of(spark, rows.unionByName(last.select(rows.columns))))
    closed = drain(live.stream_quiet_visits(observed, "1 day", 30 * 3600, 200 * 3600, 10_000 * 3600))
    return closed.filter("visit_id >= 0").select("visit_id", "new_candidates", "opened_us", "last_new_us", "closed_us", F.col("hit_cap").cast("int").alias("hit_cap"))
