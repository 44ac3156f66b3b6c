"""Streams made of built-in operators.

The batch operators are mergeable aggregates and projections, so most streams
are the same functions over a streaming input. State is bounded by watermarks;
a visit id in the key gives each navigation state of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as X
from ..functions import urls as U
from ..operators import events as E
from ..operators import logs as L
from ..operators import registry as R
from ..options import CandidateOptions
from ..sources.lines import read_lines
from .stateful import close_quiet_visits

QUIET_SECONDS = 6
VISIT_CAP_SECONDS = 45


def stream_correlate(events: DataFrame, within: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """M1, M3: responses joined with their request and extra headers, on id and a stretch of time.

    ``events`` are parsed by ``parse_net_events``. A response whose request never comes is
    emitted once the watermark has passed it, and nothing pending outlives it.
    """
    # The state of a join holds its rows until the watermark passes them, and most of the disk is that state: responses come in
    # with the fields that go out, and the other two with their cookie, not with whole header maps.
    method = F.col("method")
    answer = H.lower_keys(F.col("p.response.headers"))
    length = X.asset_length(
        F.try_element_at(answer, F.lit("content-range")), F.try_element_at(answer, F.lit("content-length"))
    )
    received = events.filter(method == E.METHODS[2]).select(
        "visit_id", "request_id", "seq", "ts", F.col("p.response.url").alias("url"), F.col("p.response.mimeType").alias("mime_type"),
        F.col("p.type").alias("resource_type"), length.alias("content_length"),
    ).withWatermark("ts", late)

    def side(name: str, headers: Column, prefix: str) -> DataFrame:
        cookie = F.try_element_at(H.lower_keys(headers), F.lit("cookie"))
        rows = events.filter(method == name).select(
            F.col("visit_id").alias(f"{prefix}visit"), F.col("request_id").alias(f"{prefix}id"),
            F.col("ts").alias(f"{prefix}ts"), cookie.alias(f"{prefix}cookie"),
        )
        return rows.withWatermark(f"{prefix}ts", late)

    def near(prefix: str):
        return F.expr(
            f"visit_id = {prefix}visit AND request_id = {prefix}id"
            f" AND {prefix}ts BETWEEN ts - INTERVAL {within} AND ts + INTERVAL {within}"
        )

    sent = side(E.METHODS[0], F.col("p.request.headers"), "s_")
    extra = side(E.METHODS[1], F.col("p.headers"), "e_")
    joined = received.join(sent, near("s_"), "leftOuter").join(extra, near("e_"), "leftOuter")
    # As in merged headers the extra ones win; a name without a value is not there.
    return joined.select(
        "visit_id", "request_id", "seq", "ts", "url", "mime_type", "resource_type", "content_length",
        F.coalesce("e_cookie", "s_cookie").alias("cookie"),
    )


def stream_observations(observations: DataFrame, options: CandidateOptions = CandidateOptions()) -> DataFrame:
    return R.filter_candidates(R.classify_observations(observations), options)


def _periods(observations: DataFrame, late: str, hold: str) -> DataFrame:
    """With the stretch of time a row belongs to: groups that have one are given up when the watermark has passed it."""
    return observations.withWatermark("ts", late).withColumn("period", F.window("ts", hold))


def stream_candidates(
    observations: DataFrame, by: Sequence[str] = ("visit_id",), options: CandidateOptions = CandidateOptions(),
    late: str = "10 minutes", hold: str = "1 day",
) -> DataFrame:
    """M4, M7: the candidate list as it changes, for update mode, per ``period`` of length ``hold``.

    State ends when the watermark, ``late`` behind the newest row, passes a period; older rows are dropped. A visit that
    runs over the end of a period has a row in each. The columns merge: counts add up, first and last seen are min and max.
    """
    rows = stream_observations(_periods(observations, late, hold), options)
    return R.candidates(rows, [*by, "period"])


def stream_families(
    observations: DataFrame, by: Sequence[str] = ("visit_id",), options: CandidateOptions = CandidateOptions(),
    late: str = "10 minutes", hold: str = "1 day",
) -> DataFrame:
    """M5: segment families as they grow, for update mode, per ``period`` as in ``stream_candidates``."""
    rows = stream_observations(_periods(observations, late, hold), options)
    return R.segment_families(rows, [*by, "period"])


def stream_once(df: DataFrame, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """M9: the first row of each key: a diagnosis per host, an opaque page per visit."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def stream_quiet_visits(
    observations: DataFrame, late: str = "10 seconds", quiet_seconds: float = QUIET_SECONDS, cap_seconds: float = VISIT_CAP_SECONDS,
    hold_seconds: float = 3600,
) -> DataFrame:
    """M8: a visit closes when no new candidate came for six seconds, or 45 seconds after its first.

    Needs ``visit_id, ts`` and the classified columns. Candidates seen before do not keep a visit open. A visit closes
    once, in one row; what it shows later is ignored for ``hold_seconds``. Rows more than ``late`` behind are dropped.
    """
    rows = R.observed_candidates(observations).select("visit_id", "ts", "candidate_key")
    return close_quiet_visits(rows, late, quiet_seconds, cap_seconds, hold_seconds)


def stream_log(spark: SparkSession, path: str, minimum: str = "INFO") -> DataFrame:
    """Log entries at or above a level as they are written: files are followed from byte to byte.

    Continuation lines carry no level of their own and belong to ``parse_app_log``.
    """
    lines = read_lines(spark, path, stream=True)
    parsed = L.log_columns(lines).withColumnRenamed("own_level", "level")
    return parsed.filter(L.level_rank(F.col("level")) >= L.LEVELS.index(minimum) + 1)


def protection_events(candidates: DataFrame, protected_packages: DataFrame) -> DataFrame:
    """Input of ``processors.stream_protection``: candidates and protection notices keyed by visit and family."""
    seen = candidates.select(
        "visit_id", U.family_key("url").alias("family"), "ts", "seq", F.lit("candidate").alias("event"), "url", F.lit(None).cast("string").alias("system")
    )
    marks = protected_packages.select(
        "visit_id", U.family_key("manifest_url").alias("family"), "ts", "seq", F.lit("protected").alias("event"),
        F.col("manifest_url").alias("url"), F.coalesce("system", F.lit("DRM")).alias("system"),
    )
    return seen.unionByName(marks)
