"""The operators put together: traffic to candidates, corpus to variants, runs to verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import dash, detection, events, extractor, hls, registry, variants
from ..operators.written import written
from ..options import CandidateOptions


def candidates_from_events(
    net_events: DataFrame, pages: DataFrame, options: CandidateOptions = CandidateOptions(), by: Sequence[str] = ("visit_id",)
) -> tuple[DataFrame, DataFrame]:
    """Parsed network events to (candidates, segment families)."""
    seen = events.correlate_requests(net_events, pages)
    accepted = registry.filter_candidates(registry.classify_observations(seen), options)
    return registry.candidates(accepted, by), registry.segment_families(accepted, by)


def variants_from_corpus(manifests: DataFrame, dumps: DataFrame | None = None) -> DataFrame:
    """Manifest texts, and extractor dumps, to the variants of every source.

    Playlists are written once with their role: streams, renditions, heads and durations all start from that table.
    """
    lists = written(hls.split_playlists(manifests.filter(F.col("kind") == K.HLS)).select("manifest_id", "url", "body", "playlist_role"))
    masters = lists.filter(F.col("playlist_role") == "master")
    tracks = hls.hls_resolve(hls.hls_master_variants(masters), hls.hls_renditions(masters))
    # Sections follow each other in the order streams, audio, subtitles.
    tracks = tracks.withColumn("ordinal", F.col("section").cast("bigint") * (1 << 40) + F.col("ordinal"))
    parsed = dash.parse_manifests(manifests.filter(F.col("kind") == K.DASH), layouts=False)
    reps = dash.dash_resolve(dash.dash_representations(parsed))
    place = (F.col("period_no").cast("bigint") * (1 << 20) + F.col("set_no")) * (1 << 20) + F.col("rep_no")
    reps = reps.withColumn("ordinal", place.cast("bigint"))
    alone = hls.media_variants(lists.filter(F.col("playlist_role") == "media"))
    result = variants.conform(tracks).unionByName(variants.conform(alone)).unionByName(variants.conform(reps))
    if dumps is not None:
        found = extractor.extractor_variants(extractor.read_extractor_dumps(dumps))
        result = result.unionByName(variants.conform(found))
    return result


def parts_of_variants(chosen: DataFrame, manifests: DataFrame) -> DataFrame:
    """The parts of HLS variants: ``source_id, variant_id, playlist_uri, ordinal, is_init, uri, range, ...``.

    ``chosen`` are variants (``source_id, variant_id, url, delivery``), ``manifests`` the corpus with their playlists. A
    variant whose playlist is itself a master is followed to the best stream of that master. A playlist that was captured
    more than once counts once; variants without a captured playlist give no parts.

    Playlists are written once with their role, as masters and media playlists would each put all texts together again.
    """
    # url -> one body; an address may serve many variants.
    lists = manifests.filter(F.col("kind") == K.HLS).groupBy("url").agg(F.max("body").alias("body"))
    lists = written(hls.split_playlists(lists.withColumn("manifest_id", F.col("url"))))
    best = hls.best_of_masters(hls.hls_master_variants(lists.filter(F.col("playlist_role") == "master")))
    wanted = chosen.filter(F.col("delivery") == "hls_segments").select("source_id", "variant_id", F.col("url").alias("_variant_url"))
    wanted = wanted.join(best, F.col("_variant_url") == F.col("_master_url"), "left")
    wanted = wanted.select("source_id", "variant_id", F.coalesce("nested_uri", "_variant_url").alias("playlist_uri"))
    media = lists.filter(F.col("playlist_role") == "media").join(wanted.select("playlist_uri").distinct(), F.col("url") == F.col("playlist_uri"), "left_semi")
    parts = hls.hls_parts(media)
    return wanted.join(parts, F.col("playlist_uri") == F.col("manifest_id")).drop("manifest_id")


def protected_packages(manifests: DataFrame) -> DataFrame:
    """Manifests of the corpus that DRM systems protect, as ``manifest_url, system``."""
    lists = hls.split_playlists(manifests.filter(F.col("kind") == K.HLS))
    session = hls.hls_session_keys(lists.filter(F.col("playlist_role") == "master"))
    media = hls.playlist_keys(hls.hls_segments(lists.filter(F.col("playlist_role") == "media")))
    keys = session.select("manifest_id", "ordinal", "system").unionByName(media.select("manifest_id", "ordinal", "system"))
    by_keys = hls.playlist_protection(keys)
    by_scheme = dash.manifest_protection(
        dash.dash_protections(dash.parse_manifests(manifests.filter(F.col("kind") == K.DASH)))
    )
    flagged = by_keys.unionByName(by_scheme).filter("is_protected")
    return manifests.select("manifest_id", F.col("url").alias("manifest_url")).join(flagged, "manifest_id").select(
        "manifest_url", "system"
    )


def resolve_candidates(
    candidates: DataFrame, manifests: DataFrame, probes: DataFrame, dumps: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Candidates to (how each was resolved, the variants that may be planned).

    A probe may move a file to the manifests (J15); what is left are direct files (G9). Where a candidate's own resolver
    found nothing, an extractor dump of its page or address stands in (J14). Packages that DRM systems protect are
    marked (J3) and none of their variants is handed on.
    """
    routed = variants.reclassify_by_probe(candidates, probes).withColumn("kind", F.col("resolve_kind"))
    marked = registry.mark_protected(routed, protected_packages(manifests))
    bodies = manifests.groupBy(F.col("url").alias("_url")).agg(F.max("body").alias("body"))
    wanted = marked.filter(F.col("kind").isin(K.HLS, K.DASH)).join(bodies, F.col("url") == F.col("_url"))
    listed = variants_from_corpus(wanted.select(F.col("candidate_id").alias("manifest_id"), "url", "kind", "body"))
    direct = variants.conform(variants.progressive_variants(marked, probes))
    native = listed.unionByName(direct)
    found = extractor.read_extractor_dumps(dumps)
    offered = extractor.extractor_variants(found)
    counted = offered.groupBy("page_url", "source_id").agg(F.count("*").alias("variant_count"))
    own = native.groupBy("source_id").agg(F.count("*").alias("variant_count"))
    resolved = variants.resolve_with_fallback(own, counted, marked)
    open_ = resolved.filter(~F.coalesce("is_protected", F.lit(False)))
    by_self = open_.filter(F.col("resolved_by") == "native").select("candidate_id")
    by_page = open_.filter(F.col("resolved_by").isin("extractor_page", "extractor_url")).select(
        F.col("candidate_id").alias("_candidate"), "source_id", F.when(F.col("resolved_by") == "extractor_page", F.col("page_url")).otherwise(F.col("url")).alias("page_url")
    )
    external = offered.join(by_page, ["page_url", "source_id"]).withColumn("source_id", F.col("_candidate"))
    chosen = native.join(by_self, native["source_id"] == by_self["candidate_id"], "left_semi").unionByName(variants.conform(external))
    return resolved, chosen


def detection_run(
    targets: DataFrame, observations: DataFrame, visits: DataFrame, only: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Targets and what was seen on them to (verdicts, pass rate)."""
    verdicts = detection.judge(detection.select_targets(targets, only), observations, visits)
    return verdicts, detection.pass_rate(verdicts)
