"""Detection self-test: targets, observations, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from .ordered import first_per

EXPECTATIONS = ("any_media", "stream", "file", "video", "drm_refusal")


def select_targets(targets: DataFrame, only: str | None) -> DataFrame:
    """Targets whose name or URL contains a text. Selecting nothing is an error."""
    if only is None or not only.strip():
        return targets
    needle = only.lower()
    chosen = targets.filter(F.lower("name").contains(needle) | F.lower("url").contains(needle))
    if chosen.isEmpty():
        raise ValueError(f"no target matches {only!r}")
    return chosen


def kind_summary(observations: DataFrame) -> DataFrame:
    """A10: "kind xN" per target, kinds in the order they were first seen."""
    kinds = observations.groupBy("target", "kind").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    shown = F.when(F.col("n") == 1, X.kind_label(F.col("kind"))).otherwise(
        F.concat(X.kind_label(F.col("kind")), F.lit(" x"), F.col("n").cast("string"))
    )
    # At most one row per kind and target is left here.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", shown.alias("text")))), lambda r: r["text"])
    return kinds.groupBy("target").agg(F.concat_ws(", ", listed).alias("kinds"))


def match_targets(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """What was seen per target, targets with nothing seen included.

    The observations are folded per target before the join.
    """
    kind = F.col("kind")
    gives_video = (kind == K.VIDEO) | K.is_streaming(kind) | ((kind == K.PAGE) & (F.coalesce("variant_count", F.lit(0)) > 0))
    seen = observations.groupBy("target").agg(
        F.count("*").alias("observed"),
        F.max(K.is_streaming(kind)).alias("has_stream"),
        F.max(kind.isin(K.VIDEO, K.AUDIO)).alias("has_file"),
        F.max(gives_video).alias("has_video"),
        F.max(F.coalesce("is_protected", F.lit(False))).alias("has_drm"),
        F.max(K.is_downloadable(kind)).alias("has_media"),
    )
    joined = targets.join(seen, targets["name"] == seen["target"], "left").drop("target")
    return joined.fillna({"observed": 0, "has_stream": False, "has_file": False, "has_video": False, "has_drm": False, "has_media": False})


def judge(targets: DataFrame, observations: DataFrame, visits: DataFrame) -> DataFrame:
    """The verdict on each target.

    ``visits`` has ``target, error, navigation_error, playback_started, elapsed_s``.
    An error of the visit decides; a navigation error does when nothing was
    seen; a failure is an error when the player never started.
    """
    matched = match_targets(targets, observations)
    rows = matched.join(visits, matched["name"] == visits["target"], "left").drop("target")
    rows = rows.join(kind_summary(observations).withColumnRenamed("target", "name"), "name", "left")
    nothing = F.col("observed") == 0
    wanted = F.col("expectation")
    ok = (
        F.when(wanted == "stream", F.col("has_stream")).when(wanted == "video", F.col("has_video"))
        .when(wanted == "file", F.col("has_file")).when(wanted == "drm_refusal", F.col("has_drm"))
        .otherwise(F.col("has_media"))
    )
    good = (
        F.when(wanted == "stream", "manifest detected").when(wanted == "video", "video detected")
        .when(wanted == "file", "progressive file detected").when(wanted == "drm_refusal", "DRM recognised and refused")
        .otherwise("media detected")
    )
    bad = (
        F.when(wanted == "stream", "no HLS or DASH manifest appeared")
        .when((wanted == "video") & ~nothing, "only media that is no video appeared")
        .when(wanted == "file", "no progressive file appeared")
        .when((wanted == "drm_refusal") & nothing, "nothing detected, so refusal is not shown")
        .when(wanted == "drm_refusal", "media detected without recognising protection")
        .otherwise("no media detected")
    )
    started = F.coalesce("playback_started", F.lit(True))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(nothing & F.col("navigation_error").isNotNull(), F.col("navigation_error"))
        .when(~ok & ~started & F.col("navigation_error").isNull(), F.lit("the player never started"))
    )
    rows = rows.withColumns({"_ok": ok, "_error": error})
    text = F.when(F.col("_ok"), good).otherwise(bad)
    summary = F.concat(text, F.coalesce(F.concat(F.lit(" ("), "kinds", F.lit(")")), F.lit("")))
    return rows.withColumns(
        {
            "outcome": F.when(F.col("_error").isNotNull(), "error").when(F.col("_ok"), "passed").otherwise("failed"),
            "summary": F.coalesce("_error", summary),
            "error": F.col("_error"),
        }
    ).drop("_ok", "_error")


def pass_rate(verdicts: DataFrame) -> DataFrame:
    """How many passed, and the exit status of the run."""
    totals = verdicts.agg(F.count(F.when(F.col("outcome") == "passed", 1)).alias("passed"), F.count("*").alias("total"))
    return totals.withColumn("exit_status", F.when(F.col("passed") == F.col("total"), 0).otherwise(1))


def download_outcomes(targets: DataFrame, attempts: DataFrame) -> DataFrame:
    """What came of each target: the first success, else failed, else no candidate; with the row a report shows."""
    worked = F.col("outcome").isin("downloaded", "downloading")
    shown_first = F.when(F.col("outcome") != "failed", F.col("ordinal"))
    row = F.struct("kind", "url", "resolved_by", "quality", "bytes", "elapsed_s", "error")
    folded = attempts.groupBy("target").agg(
        F.count("*").alias("attempts"),
        F.min_by("outcome", F.when(worked, F.col("ordinal"))).alias("_success"),
        F.coalesce(F.min_by(row, shown_first), F.min_by(row, "ordinal")).alias("best"),
    )
    joined = targets.join(folded, targets["name"] == folded["target"], "left").drop("target")
    outcome = F.when(F.col("attempts").isNull(), "no_candidate").otherwise(F.coalesce("_success", F.lit("failed")))
    return joined.withColumns({"outcome": outcome, "attempts": F.coalesce("attempts", F.lit(0))}).drop("_success")


def first_observations(observations: DataFrame) -> DataFrame:
    return first_per(observations, ["target", "url"], ["ordinal"])
