"""Transfer jobs, progress and fetch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from .ordered import CHUNK_ROWS, Carry, by_count, cut_evenly, running

TERMINAL_STATES = ("completed", "failed", "canceled")
MAX_ATTEMPTS = 5
BACKOFF_SECONDS = 0.4
RETRY_AFTER_CAP_SECONDS = 30


# --- progress ---------------------------------------------------------------------------------

def stage_runs(progress: DataFrame) -> DataFrame:
    """Number the runs of equal stage of each job (gaps and islands), by sequence number."""
    rows = cut_evenly(progress.withColumn("stage", F.coalesce("stage", F.lit(""))), ["job_id"], "seq", "_part")
    chunk = F.col("_part")
    rows = running(rows, ["job_id"], ["seq"], chunk, {"_previous": Carry("last", F.col("stage"), inclusive=False)})
    changed = F.when(F.col("_previous").isNull() | (F.col("_previous") != F.col("stage")), 1).otherwise(0)
    rows = rows.withColumn("stage_changed", changed)
    rows = running(rows, ["job_id"], ["seq"], chunk, {"run_no": Carry("sum", F.col("stage_changed"))})
    return rows.drop("_previous", "_part")


def milestones(progress: DataFrame) -> DataFrame:
    """The reports worth a line: a change of stage, then each new tenth within it.

    A run of a stage is first reduced to the first report of each tenth, a
    partial aggregate of at most a dozen rows per run, and only those are put
    in order.
    """
    fraction = X.progress_fraction(
        F.col("segments_done"), F.col("segments_total"), F.col("bytes"), F.col("total_bytes")
    )
    tenth = F.coalesce(F.floor(fraction * 10 + 1e-12), F.lit(-1))
    rows = stage_runs(progress).withColumn("decile", tenth)
    report = F.struct("seq", "ts", "stage", "stage_changed", "segments_done", "segments_total", "bytes", "total_bytes", "rate")
    firsts = rows.groupBy("job_id", "run_no", "decile").agg(F.min_by(report, "seq").alias("r"))
    earlier = Window.partitionBy("job_id", "run_no").orderBy("r.seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_reached", F.max("decile").over(earlier))
    kept = firsts.filter(F.col("_reached").isNull() | (F.col("decile") > F.col("_reached")))
    rows = kept.select("job_id", "run_no", "decile", "r.*")
    opening = F.concat(F.lit("stage: "), F.when(F.col("stage") == "", F.lit("?")).otherwise(F.col("stage")))
    inside = F.concat(
        "stage", F.lit(" "), (F.col("decile") * 10).cast("string"), F.lit("% - "),
        X.progress_label(F.col("segments_done"), F.col("segments_total"), F.col("bytes"), F.col("total_bytes")),
        F.lit(", "), X.fmt_rate(F.coalesce("rate", F.lit(0.0))),
    )
    return rows.withColumn("message", F.when(F.col("stage_changed") == 1, opening).otherwise(inside)).drop("stage_changed")


def progress_columns(progress: DataFrame) -> DataFrame:
    """X11: fraction and remaining seconds of each report."""
    fraction = X.progress_fraction(
        F.col("segments_done"), F.col("segments_total"), F.col("bytes"), F.col("total_bytes")
    )
    return progress.withColumns(
        {"fraction": fraction, "eta_seconds": X.eta_seconds(F.col("bytes"), F.col("total_bytes"), F.col("rate"))}
    )


def stage_offsets(progress: DataFrame) -> DataFrame:
    """Bytes finished in the earlier stages of a job, added to the reports of the later ones."""
    stages = progress.groupBy("job_id", "stage").agg(F.max("bytes").alias("_bytes"), F.min("seq").alias("_first"))
    # One row per stage of a job, of which there are a handful.
    earlier = Window.partitionBy("job_id").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stages.withColumn("base_bytes", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)))
    joined = progress.join(offsets.select("job_id", "stage", "base_bytes"), ["job_id", "stage"], "left")
    return joined.withColumn("job_bytes", F.col("bytes") + F.col("base_bytes"))


# --- job states -------------------------------------------------------------------------------

def state_timeline(job_events: DataFrame) -> DataFrame:
    """The states a job went through; a final state stays, whatever is reported after it.

    A progress report (a row with a stage) means muxing in the finishing stage
    and downloading otherwise.
    """
    reported = F.when(
        F.col("stage").isNotNull(), F.when(F.col("stage") == "finalizing", "muxing").otherwise("downloading")
    )
    rows = job_events.withColumn("state", F.coalesce("state", reported))
    terminal = F.when(F.col("state").isin(*TERMINAL_STATES), F.col("seq"))
    ends = rows.groupBy("job_id", "attempt").agg(F.min(terminal).alias("_end"))
    rows = rows.join(ends, ["job_id", "attempt"], "left").filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    rows = running(
        rows, ["job_id", "attempt"], ["seq"], None,
        {"previous_state": Carry("last", F.col("state"), inclusive=False)},
    ).drop("_end")
    changed = F.col("previous_state").isNull() | (F.col("previous_state") != F.col("state"))
    return rows.withColumn("is_transition", changed)


def job_summary(job_events: DataFrame) -> DataFrame:
    """How each job stands: last attempt, final state, time taken, warnings, may it be retried.

    All mergeable aggregates. ``job_events`` may carry ``warnings`` (a count).
    """
    order = F.struct("attempt", "seq")
    warnings = F.col("warnings") if "warnings" in job_events.columns else F.lit(0)
    terminal = F.col("state").isin(*TERMINAL_STATES)
    # The first final state of the last attempt: later attempts sort first, then earlier rows.
    first_of_last = F.when(terminal, F.struct(-F.col("attempt"), F.col("seq")))
    last_state = F.when(F.col("state").isNotNull(), order)
    end = F.struct("attempt", "state", "ts", "error", "permanent")
    rows = job_events.withColumn("_warnings", warnings)
    summary = rows.groupBy("job_id").agg(
        F.max("attempt").alias("attempts"),
        F.min("ts").alias("created_at"),
        F.min_by(end, first_of_last).alias("_end"),
        F.max_by("state", last_state).alias("_last"),
        F.sum("_warnings").alias("warnings"),
    )
    done = F.coalesce(F.col("_end.attempt") == F.col("attempts"), F.lit(False))
    summary = summary.withColumn("_done", done)
    state = F.when(F.col("_done"), F.col("_end.state")).otherwise(F.col("_last"))
    permanent = F.col("_done") & F.coalesce("_end.permanent", F.lit(False))
    summary = summary.withColumns({"final_state": state, "is_permanent": permanent})
    return summary.withColumns(
        {
            "completed_at": F.when(F.col("_done"), F.col("_end.ts")),
            "elapsed_seconds": F.when(
                F.col("_done"), (F.unix_micros("_end.ts") - F.unix_micros("created_at")) / F.lit(1e6)
            ),
            "error": F.when(F.col("_done"), F.col("_end.error")),
            "may_retry": F.coalesce(F.col("final_state").isin("failed", "canceled"), F.lit(False)) & ~F.col("is_permanent"),
        }
    ).drop("_end", "_last", "_done")


def run_intervals(job_events: DataFrame) -> DataFrame:
    """When each attempt was queued, started and ended."""
    terminal = F.col("state").isin(*TERMINAL_STATES)
    working = F.col("state").isin("resolving", "downloading", "muxing")
    return job_events.groupBy("job_id", "attempt").agg(
        F.min(F.when(F.col("state") == "queued", F.col("ts"))).alias("queued_at"),
        F.min(F.when(working, F.col("ts"))).alias("started_at"),
        F.min(F.when(terminal, F.col("ts"))).alias("ended_at"),
    )


def queue_waits(intervals: DataFrame) -> DataFrame:
    """Seconds from queueing to start."""
    wait = (F.unix_micros("started_at") - F.unix_micros("queued_at")) / F.lit(1e6)
    return intervals.withColumn("wait_seconds", wait)


def concurrency(intervals: DataFrame, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """Jobs running at each start and end. An end at the same instant counts first.

    The whole fleet is one ordered group. It is cut at quantiles of time, so a
    busy hour is as many chunks as its changes need, and one row per chunk is
    carried across.
    """
    started = intervals.filter(F.col("started_at").isNotNull())
    changes = started.select(F.col("started_at").alias("ts"), F.lit(1).alias("change"), "job_id", "attempt").unionByName(
        started.filter(F.col("ended_at").isNotNull()).select(
            F.col("ended_at").alias("ts"), F.lit(-1).alias("change"), "job_id", "attempt"
        )
    )
    return running(
        changes, [], ["ts", "change", "job_id", "attempt"], None,
        {"running": Carry("sum", F.col("change"))}, rows_per_chunk,
    )


def peak_concurrency(job_events: DataFrame, limit: int, rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """The most jobs that ever ran at once, and whether the limit held."""
    steps = concurrency(run_intervals(job_events), rows_per_chunk)
    peak = steps.agg(
        F.max("running").alias("peak"), F.min_by("ts", F.struct(-F.col("running"), F.col("ts"))).alias("peak_at")
    )
    return peak.withColumns({"limit": F.lit(limit), "within_limit": F.col("peak") <= limit})


# --- fetch log --------------------------------------------------------------------------------

def retry_audit(fetch_log: DataFrame) -> DataFrame:
    """Attempts of each request with the least delay each should have waited.

    An answer that may be retried, and has attempts left, is waited out for its
    Retry-After (at most 30 s), else for 400 ms doubled per attempt. Attempts
    count from 0. After any other answer nothing has to be waited for. Chunks of attempts keep a request of any length
    spread out.
    """
    rows = running(
        fetch_log, ["request_id"], ["attempt"], by_count("attempt", 1024),
        {
            "_last_ts": Carry("last", F.unix_micros("ts"), inclusive=False),
            "_last": Carry("last", F.struct("status", "retry_after_s", "attempt"), inclusive=False),
        },
    )
    given = F.when(F.col("_last.retry_after_s") > 0, F.least(F.col("_last.retry_after_s"), F.lit(RETRY_AFTER_CAP_SECONDS)).cast("double"))
    backoff = F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2.0), F.col("_last.attempt"))
    retried = (K.status_class(F.col("_last.status")) == "retryable") & (F.col("_last.attempt") < MAX_ATTEMPTS - 1)
    expected = F.when(F.col("_last_ts").isNotNull() & retried, F.coalesce(given, backoff))
    waited = (F.unix_micros("ts") - F.col("_last_ts")) / F.lit(1e6)
    return rows.withColumns({"expected_delay_s": expected, "waited_s": waited}).withColumn(
        "too_early", F.coalesce(F.col("waited_s") < F.col("expected_delay_s"), F.lit(False))
    ).drop("_last", "_last_ts")


def retry_summary(audited: DataFrame) -> DataFrame:
    """Attempts per request, and whether they were used up."""
    summary = audited.groupBy("request_id").agg(
        F.count("*").alias("attempts"),
        F.max_by("status", "attempt").alias("final_status"),
        F.sum(F.col("too_early").cast("int")).alias("early_retries"),
        F.sum("expected_delay_s").alias("expected_wait_s"),
    )
    exhausted = (F.col("attempts") >= MAX_ATTEMPTS) & (K.status_class(F.col("final_status")) == "retryable")
    return summary.withColumn("exhausted", exhausted)


def refusal_diagnosis(fetch_log: DataFrame) -> DataFrame:
    """Per host, the first refusal of the direct client: what was sent, and how the browser fared from then on.

    ``fetch_log`` has ``host, ts, route, status, headers``. What the browser did before the refusal does not count.
    """
    refused = (F.col("route") == "direct") & F.col("status").isin(*K.REFUSAL_STATUS)
    through = (F.col("route") == "browser") & F.col("status").between(200, 299)
    names = F.array_sort(F.transform(F.map_keys("headers"), lambda k: F.lower(k)))
    names = F.array_join(F.filter(names, lambda n: n != "cookie"), ", ")
    cookie = F.exists(F.map_keys("headers"), lambda k: F.lower(k) == "cookie")
    rows = fetch_log.filter(refused | (F.col("route") == "browser"))
    rows = rows.select("host", "ts", "status", "route", names.alias("sent"), cookie.alias("cookie"), refused.alias("_refused"), through.alias("_through"))
    first = rows.groupBy("host").agg(
        F.min_by(F.struct("ts", "status", "sent", "cookie"), F.when(F.col("_refused"), F.struct("ts", "status"))).alias("f"),
    ).filter(F.col("f").isNotNull())
    later = rows.filter(F.col("route") == "browser").join(first.select("host", F.col("f.ts").alias("_refused_at")), "host")
    later = later.filter(F.col("ts") >= F.col("_refused_at")).groupBy("host").agg(
        F.min(F.when(F.col("_through"), F.col("ts"))).alias("browser_ok_at"), F.lit(True).alias("_asked")
    )
    first = first.join(later, "host", "left")
    outcome = (
        F.when(F.col("browser_ok_at").isNotNull(), "browser_succeeded").when(F.col("_asked"), "browser_refused").otherwise("not_tried")
    )
    return first.select(
        "host", F.col("f.ts").alias("refused_at"), F.col("f.status").alias("status"), F.col("f.sent").alias("headers_sent"),
        F.col("f.cookie").alias("had_cookie"), outcome.alias("browser_outcome"),
    )


def route_hosts(fetch_log: DataFrame) -> DataFrame:
    """Requests that belong on the browser: their host refused the direct client and after that served the browser.

    One row per host meets the log, so the ordered comparisons are filters on equi-joins.
    """
    refused = (F.col("route") == "direct") & F.col("status").isin(*K.REFUSAL_STATUS)
    served = (F.col("route") == "browser") & F.col("status").between(200, 299)
    refusals = fetch_log.filter(refused).groupBy("host").agg(F.min("ts").alias("_refused_at"))
    after = fetch_log.filter(served).select("host", "ts").join(refusals, "host").filter(F.col("ts") >= F.col("_refused_at"))
    since = after.groupBy("host").agg(F.min("ts").alias("_since"))
    joined = fetch_log.join(since, "host", "left")
    route = F.when(F.col("ts") > F.col("_since"), "browser").otherwise("direct")
    return joined.withColumn("expected_route", route).drop("_since")


# --- resuming ---------------------------------------------------------------------------------

def resume_identities(parts: DataFrame) -> DataFrame:
    """X21 per job. ``parts`` has ``job_id, ordinal, uri, range``."""
    ends = parts.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.min_by(F.struct("uri", "range"), "ordinal").alias("_first"),
        F.max_by(F.struct("uri", "range"), "ordinal").alias("_last"),
    )
    identity = X.resume_identity(
        F.col("total"), F.col("_first.uri"), F.col("_last.uri"), F.col("_first.range"), F.col("_last.range")
    )
    return ends.select("job_id", "total", identity.alias("current_identity"))


def resume_decisions(parts: DataFrame, checkpoints: DataFrame, listing: DataFrame) -> DataFrame:
    """May a job go on where it stopped? ``checkpoints`` come from ``read_checkpoints``.

    ``listing`` has ``job_id, part_bytes``; no row means no partial file.
    """
    joined = (
        resume_identities(parts).join(checkpoints, "job_id", "left").join(listing.select("job_id", "part_bytes"), "job_id", "left")
    )
    matches: Column = (
        (F.col("schema") == 1) & (F.col("written_parts") > 0) & (F.col("written_parts") <= F.col("total"))
        & (F.col("total_parts") == F.col("total")) & (F.col("identity") == F.col("current_identity"))
        & (F.col("part_bytes") >= F.col("bytes"))
    )
    ok = F.coalesce(matches, F.lit(False))
    decision = F.when(~ok, "restart").when(F.col("part_bytes") > F.col("bytes"), "trim_and_resume").otherwise("resume")
    return joined.select(
        "job_id", "total", decision.alias("decision"),
        F.when(ok, F.col("written_parts")).otherwise(0).alias("resume_from"),
        F.when(ok, F.col("bytes")).otherwise(0).alias("keep_bytes"),
    )


def remaining_parts(parts: DataFrame, decisions: DataFrame) -> DataFrame:
    """U4: the parts still to fetch. ``ordinal`` counts the parts of a job from 0."""
    joined = parts.join(decisions.select("job_id", "resume_from"), "job_id", "left")
    return joined.filter(F.col("ordinal") >= F.coalesce("resume_from", F.lit(0))).drop("resume_from")
