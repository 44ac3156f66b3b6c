"""From observed responses to candidates, families and protection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import urls as U
from ..functions.text import is_blank
from ..options import CandidateOptions
from .ordered import first_per, top_per
from .pinning import pin

OBSERVATION_COLUMNS = {
    "request_id": "bigint", "ts": "timestamp", "seq": "bigint", "page_url": "string",
    "page_title": "string", "url": "string", "mime_type": "string", "resource_type": "string",
    "content_length": "bigint", "cookie": "string", "request": "string",
}


def complete(df: DataFrame) -> DataFrame:
    """Add the observation columns a source does not carry, as typed NULLs."""
    missing = {
        name: F.lit(None).cast(kind) for name, kind in OBSERVATION_COLUMNS.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def classify_observations(observations: DataFrame) -> DataFrame:
    """Add host, path, noise flag and kind.

    The URL is taken apart once and the parts are reused. An opaque streaming
    protocol rewrites the row to its page (C8), or drops it when the page is
    not known.
    """
    parts = pin(
        complete(observations),
        {
            "host": U.url_host("url"),
            "path": U.url_path("url"),
            "_query": U.url_query("url"),
            "_mime": K.bare_mime(F.col("mime_type")),
            "_web": U.is_web_url("url"),
        },
    )
    parts = pin(
        parts,
        {
            "is_noise": K.noise_of_parts(F.col("host"), F.col("path")),
            "is_opaque": F.col("_mime").isin(*K.OPAQUE_MIMES),
            "_ext": K.path_extension(F.col("path"), F.col("_query")),
            "_by_mime": K.kind_of_bare_mime(F.col("_mime")),
        },
    )
    parts = pin(parts, {"_by_path": K.kind_of_path(F.col("path"), F.col("_ext"))})
    seen = F.when(
        F.col("_web") & ~F.col("is_noise"), K.reconcile(F.col("_by_path"), F.col("_by_mime"))
    ).otherwise(F.lit(K.UNKNOWN))
    stamped = K.kind_from_resource(F.col("resource_type"), F.col("mime_type"))
    parts = pin(parts, {"_seen": seen})
    kinds = pin(
        parts,
        {
            "kind": F.when(F.col("is_opaque"), F.lit(K.PAGE))
            .when(F.col("_seen") != K.UNKNOWN, F.col("_seen"))
            .otherwise(stamped)
        },
    )
    return kinds.drop("_query", "_mime", "_web", "_ext", "_by_mime", "_by_path", "_seen")


def filter_candidates(classified: DataFrame, options: CandidateOptions = CandidateOptions()) -> DataFrame:
    """Drop noise, unknown kinds and whatever the options exclude. Segments stay."""
    keep = (F.col("kind") != K.UNKNOWN) & ~(F.col("is_opaque") & F.col("page_url").isNull())
    if options.filter_noise:
        keep = keep & ~F.col("is_noise")
    if options.strict_scheme:
        keep = keep & U.is_web_url("url")
    if not options.include_subtitles:
        keep = keep & (F.col("kind") != K.SUBTITLE)
    if not options.include_audio:
        keep = keep & (F.col("kind") != K.AUDIO)
    if options.min_progressive_bytes > 0:
        size = F.coalesce(F.col("content_length"), F.lit(0))
        keep = keep & ~((F.col("kind") == K.VIDEO) & (size > 0) & (size < options.min_progressive_bytes))
    return classified.filter(keep)


def observed_candidates(accepted: DataFrame) -> DataFrame:
    """Rows that feed the candidate registry, with opaque rows moved to their page."""
    opaque = F.col("is_opaque")
    rows = accepted.filter(F.col("kind") != K.SEGMENT)
    rows = rows.withColumns(
        {
            "url": F.when(opaque, F.col("page_url")).otherwise(F.col("url")),
            "mime_type": F.when(~opaque, F.col("mime_type")),
            "content_length": F.when(~opaque, F.col("content_length")),
        }
    )
    return rows.withColumn("candidate_key", U.candidate_key("url"))


def candidates(accepted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1: one row per candidate key (and per visit, when ``by`` names its columns).

    Every output is a mergeable aggregate, so partial aggregation folds a hot
    key inside each task before anything is shuffled.
    """
    rows = observed_candidates(accepted)
    order = F.struct("ts", "seq")
    plain = ~F.col("is_opaque")
    has_cookie = F.coalesce(F.col("cookie"), F.lit("")) != ""
    first = F.struct("url", "kind", "content_length", "page_title", "page_url")
    best = F.struct("cookie", "request")
    grouped = rows.groupBy(*by, "candidate_key").agg(
        F.count("*").alias("hit_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min_by(first, order).alias("_first"),
        F.min_by("mime_type", F.when(F.col("mime_type").isNotNull(), order)).alias("mime_type"),
        F.min_by("page_url", F.when(plain & F.col("page_url").isNotNull(), order)).alias("_page_url"),
        F.min_by("page_title", F.when(plain & ~is_blank(F.col("page_title")), order)).alias("_title"),
        F.max("content_length").alias("_largest"),
        F.max_by(best, F.struct(has_cookie, "ts", "seq")).alias("_best"),
    )
    first_title = F.col("_first.page_title")
    return grouped.select(
        *by,
        "candidate_key",
        F.col("_first.url").alias("url"),
        U.stable_id(U.normalize_url(F.col("_first.url"))).alias("candidate_id"),
        F.col("_first.kind").alias("kind"),
        "hit_count",
        "first_seen",
        "last_seen",
        "mime_type",
        # A first observation without a size keeps the size unknown.
        F.when(F.col("_first.content_length").isNotNull(), F.col("_largest")).alias("content_length"),
        F.coalesce(F.col("_first.page_url"), F.col("_page_url")).alias("page_url"),
        F.when(~is_blank(first_title), first_title).otherwise(F.col("_title")).alias("page_title"),
        F.col("_best.cookie").alias("cookie"),
        F.col("_best.request").alias("request"),
    )


def segment_families(accepted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2: segments per host and directory."""
    rows = accepted.filter(F.col("kind") == K.SEGMENT)
    rows = rows.withColumn("family", U.family_from_parts(F.col("host"), F.col("path")))
    return rows.groupBy(*by, "family").agg(
        F.count("*").alias("segment_count"),
        F.sum(F.coalesce(F.col("content_length"), F.lit(0))).alias("total_bytes"),
        F.max("ts").alias("last_seen"),
        F.min_by("url", F.struct("ts", "seq")).alias("sample_url"),
    )


def mark_protected(candidates_df: DataFrame, protected_packages: DataFrame) -> DataFrame:
    """A protected manifest marks every candidate beside it, in whatever order they came.

    No broadcast hint: the list of protected packages grows with the traffic,
    so Spark decides from its size.
    """
    packages = (
        protected_packages.withColumn("_family", U.family_key("manifest_url"))
        .groupBy("_family")
        .agg(F.min_by("system", F.coalesce(F.col("system"), F.lit("~"))).alias("_system"), F.lit(True).alias("_hit"))
    )
    joined = candidates_df.withColumn("_family", U.family_key("url")).join(packages, "_family", "left")
    return joined.withColumns(
        {
            "is_protected": F.coalesce(F.col("_hit"), F.lit(False)),
            "protection_system": F.when(F.col("_hit"), F.coalesce(F.col("_system"), F.lit("DRM"))),
        }
    ).drop("_family", "_system", "_hit")


def snapshot(candidates_df: DataFrame) -> DataFrame:
    """Streams first, then by size, then by first seen."""
    return candidates_df.orderBy(
        F.when(K.is_streaming(F.col("kind")), 0).otherwise(1),
        F.coalesce(F.col("content_length"), F.lit(0)).desc(),
        "first_seen",
        "candidate_key",
    )


def rank_families(families: DataFrame) -> DataFrame:
    """T4: largest families first."""
    return families.orderBy(F.col("segment_count").desc(), "family")


def add_manual(candidates_df: DataFrame, manual: DataFrame) -> DataFrame:
    """C11: typed URLs bypass the noise filter and replace whatever holds their key.

    ``manual`` has ``url`` and ``ts``, and may have ``seq`` and ``kind``; the
    latest entry of a key wins.
    """
    given = F.col("kind") if "kind" in manual.columns else F.lit(None).cast("string")
    rows = manual.withColumns({"candidate_key": U.candidate_key("url"), "_given": given})
    kind = F.coalesce(F.col("_given"), K.classify(F.col("url"), F.lit(None).cast("string")))
    rows = rows.withColumn(
        "kind", F.when(kind.isin(K.UNKNOWN, K.SEGMENT), F.lit(K.PAGE)).otherwise(kind)
    )
    latest = [F.col("ts").desc(), *([F.col("seq").desc()] if "seq" in manual.columns else [])]
    rows = first_per(rows, ["candidate_key"], latest)
    entries = rows.select(
        "candidate_key",
        "url",
        U.stable_id(U.normalize_url("url")).alias("candidate_id"),
        "kind",
        F.lit(1).cast("bigint").alias("hit_count"),
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
    )
    kept = candidates_df.join(entries.select("candidate_key"), "candidate_key", "left_anti")
    return kept.unionByName(entries, allowMissingColumns=True)


def union_observations(network: DataFrame, dom: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Observations from the wire, from page elements and from people, in one table."""
    result = network.withColumn("origin", F.lit("network")).unionByName(
        dom.withColumn("origin", F.lit("dom")), allowMissingColumns=True
    )
    if manual is not None:
        result = result.unionByName(manual.withColumn("origin", F.lit("manual")), allowMissingColumns=True)
    return result


def trace(observations: DataFrame, needle: str) -> DataFrame:
    """C17: why the responses that contain a text were or were not taken."""
    rows = classify_observations(observations.filter(F.col("url").contains(needle)))
    return rows.withColumns(
        {
            "by_mime": K.kind_by_mime(F.col("mime_type")),
            "by_path": K.kind_by_path(F.col("url")),
            "by_resource": K.kind_from_resource(F.col("resource_type"), F.col("mime_type")),
        }
    )


def first_k_candidates(candidates_df: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """T5: the first downloadable candidates of each target, in snapshot order."""
    order = [
        F.when(K.is_streaming(F.col("kind")), 0).otherwise(1),
        F.coalesce(F.col("content_length"), F.lit(0)).desc(),
        F.col("first_seen"),
        F.col("candidate_key"),
    ]
    return top_per(candidates_df.filter(K.is_downloadable(F.col("kind"))), by, order, k, "candidate_rank")


def fallback_targets(candidates_df: DataFrame) -> DataFrame:
    """What to hand an extractor: the page first, then the URL, each once."""
    is_page: Column = F.col("kind") == K.PAGE
    targets = F.when(is_page, F.array("url")).otherwise(F.array("page_url", "url"))
    distinct = F.array_distinct(F.filter(targets, lambda t: t.isNotNull()))
    return candidates_df.select("*", F.posexplode(distinct).alias("target_no", "target_url"))


def candidate_state(accepted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A1 as values that can be merged later: each choice is kept with the place (``ts, seq``) that decides it."""
    rows = observed_candidates(accepted)
    order = F.struct("ts", "seq")
    plain = ~F.col("is_opaque")
    has_cookie = F.coalesce(F.col("cookie"), F.lit("")) != ""
    first = F.struct("url", "kind", "content_length", "page_title", "page_url")
    single = rows.select(
        *by, "candidate_key", F.lit(1).cast("bigint").alias("hit_count"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"),
        order.alias("first_at"), first.alias("first"),
        F.when(F.col("mime_type").isNotNull(), order).alias("mime_at"), "mime_type",
        F.when(plain & F.col("page_url").isNotNull(), order).alias("page_at"), F.col("page_url").alias("page"),
        F.when(plain & ~is_blank(F.col("page_title")), order).alias("title_at"), F.col("page_title").alias("title"),
        F.col("content_length").alias("largest"),
        F.struct(has_cookie.alias("has_cookie"), "ts", "seq").alias("best_at"), F.struct("cookie", "request").alias("best"),
    )
    return merge_candidate_states(single, by)


def merge_candidate_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One state per key from any number of them, in any order."""
    return states.groupBy(*by, "candidate_key").agg(
        F.sum("hit_count").alias("hit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_at").alias("first_at"), F.min_by("first", "first_at").alias("first"),
        F.min("mime_at").alias("mime_at"), F.min_by("mime_type", "mime_at").alias("mime_type"),
        F.min("page_at").alias("page_at"), F.min_by("page", "page_at").alias("page"),
        F.min("title_at").alias("title_at"), F.min_by("title", "title_at").alias("title"),
        F.max("largest").alias("largest"),
        F.max("best_at").alias("best_at"), F.max_by("best", "best_at").alias("best"),
    )


def candidates_of_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of :func:`candidates` from merged states; further columns stay."""
    title = F.col("first.page_title")
    own = {*by, "candidate_key", "hit_count", "first_seen", "last_seen", "first_at", "first", "mime_at", "mime_type", "page_at", "page", "title_at", "title", "largest", "best_at", "best"}
    return states.select(
        *by, "candidate_key", F.col("first.url").alias("url"), U.stable_id(U.normalize_url(F.col("first.url"))).alias("candidate_id"), F.col("first.kind").alias("kind"),
        "hit_count", "first_seen", "last_seen", "mime_type",
        F.when(F.col("first.content_length").isNotNull(), F.col("largest")).alias("content_length"),
        F.coalesce(F.col("first.page_url"), F.col("page")).alias("page_url"),
        F.when(~is_blank(title), title).otherwise(F.col("title")).alias("page_title"),
        F.col("best.cookie").alias("cookie"), F.col("best.request").alias("request"),
        *[c for c in states.columns if c not in own],
    )
