"""Ranking, pairing and planning over variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from ..functions import urls as U
from .extractor import with_labels
from .ordered import Carry, by_count, first_per, row_numbers, running, top_per
from .pinning import pin
from .written import written

VARIANT_COLUMNS = {
    "source_id": "string", "ordinal": "bigint", "variant_id": "string", "url": "string", "track": "string",
    "delivery": "string", "width": "int", "height": "int", "bandwidth": "bigint", "frame_rate": "double",
    "codecs": "string", "language": "string", "name": "string", "audio_group": "string",
    "duration_seconds": "double", "content_length": "bigint", "container": "string", "is_live": "boolean",
    "external_format_id": "string",
}
SATURATED = 999_999


def conform(variants: DataFrame) -> DataFrame:
    """Bring variants of any origin to one schema."""
    return variants.select(
        *[
            (F.col(c) if c in variants.columns else F.lit(None)).cast(t).alias(c)
            for c, t in VARIANT_COLUMNS.items()
        ]
    ).fillna({"is_live": False})


def quality_score(height: Column, bandwidth: Column) -> Column:
    """Height first; the bit rate counts up to 999,999, so fast tracks of a height tie."""
    rate = F.least(F.coalesce(bandwidth, F.lit(0)), F.lit(SATURATED))
    return F.coalesce(height, F.lit(0)).cast("bigint") * 1_000_000 + rate


def videos_of(variants: DataFrame) -> DataFrame:
    rows = variants.filter(F.col("track").isin("muxed", "video_only"))
    return rows.withColumn("score", quality_score(F.col("height"), F.col("bandwidth")))


def audios_of(variants: DataFrame) -> DataFrame:
    return variants.filter(F.col("track") == "audio_only")


def rank_videos(variants: DataFrame) -> DataFrame:
    """Position of each video in its source's ladder, best first.

    A ladder may be of any length, so it is cut where the score falls into
    another step, and runs of equal scores are cut by document order.
    """
    rows = videos_of(variants).withColumn("_down", -F.col("score"))
    step = F.floor(F.col("_down") / 20_000)
    ties = F.col("score") % 1_000_000
    # Large ties have no rate or a saturated one. A step starts at a full height, so these two scores are its best.
    tied = ties.isin(0, SATURATED)
    chunk = F.struct(
        step.alias("a"),
        F.when(ties == 0, -2).when(ties == SATURATED, -1).otherwise(0).alias("b"),
        F.when(tied, F.floor(F.col("ordinal") / 250_000)).otherwise(0).alias("c"),
    )
    return row_numbers(rows, ["source_id"], ["_down", "ordinal"], chunk, "video_rank").drop("_down")


def rank_audios(variants: DataFrame) -> DataFrame:
    """Audio by bit rate, then document order."""
    rows = audios_of(variants).withColumn("_down", -F.coalesce("bandwidth", F.lit(0)))
    unknown = F.col("_down") == 0
    chunk = F.struct(
        F.floor(F.col("_down") / 8_000).alias("a"),
        unknown.cast("int").alias("b"),
        F.when(unknown, F.floor(F.col("ordinal") / 250_000)).otherwise(0).alias("c"),
    )
    return row_numbers(rows, ["source_id"], ["_down", "ordinal"], chunk, "audio_rank").drop("_down")


def top_n_with_rest(ranked: DataFrame, by: Sequence[str], rank: str, text: str, n: int = 3) -> DataFrame:
    """The first ``n`` texts of each group in order, and how many more there are.

    Only ``n`` rows of a group are ever brought together.
    """
    counts = ranked.groupBy(*by).agg(F.count("*").alias("total"))
    best = ranked.filter(F.col(rank) <= n).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda r: r[text]).alias("_top")
    )
    joined = counts.join(best, list(by), "left")
    rest = F.greatest(F.col("total") - n, F.lit(0))
    shown = F.concat(
        F.array_join("_top", "; "),
        F.when(rest > 0, F.concat(F.lit("; +"), rest.cast("string"))).otherwise(F.lit("")),
    )
    return joined.withColumns({"rest": rest, "summary": shown}).drop("_top")


def best_videos(variants: DataFrame) -> DataFrame:
    return first_per(videos_of(variants), ["source_id"], [F.col("score").desc(), F.col("ordinal")])


def pair_audio(videos: DataFrame, audios: DataFrame) -> DataFrame:
    """The audio each video would be joined with.

    Muxed video takes none. Otherwise the best audio of the video's group, if
    the group has any, else the best of the source. Audio is reduced to one row
    per (source, group) and one per source before it meets the videos, so no
    pairs are formed.
    """
    best_first = [F.coalesce("bandwidth", F.lit(0)).desc(), F.col("ordinal")]
    picked = F.struct("variant_id", "bandwidth", "language", "ordinal")
    in_group = first_per(audios.filter(F.col("audio_group").isNotNull()), ["source_id", "audio_group"], best_first)
    in_group = in_group.select("source_id", "audio_group", picked.alias("_grouped"))
    overall = first_per(audios, ["source_id"], best_first).select("source_id", picked.alias("_overall"))
    joined = videos.join(in_group, ["source_id", "audio_group"], "left").join(overall, "source_id", "left")
    audio = F.when(F.col("track") != "muxed", F.coalesce("_grouped", "_overall"))
    joined = joined.withColumn("_audio", audio)
    return joined.withColumns(
        {
            "audio_id": F.col("_audio.variant_id"),
            "audio_bandwidth": F.col("_audio.bandwidth"),
            "audio_language": F.col("_audio.language"),
            "audio_ordinal": F.col("_audio.ordinal"),
        }
    ).drop("_grouped", "_overall", "_audio")


def describe_sources(variants: DataFrame) -> DataFrame:
    """Tracks per source, duration, live flag and the top of each ladder."""
    counts = variants.groupBy("source_id").agg(
        F.count(F.when(F.col("track").isin("muxed", "video_only"), 1)).alias("videos"),
        F.count(F.when(F.col("track") == "audio_only", 1)).alias("audios"),
        F.count(F.when(F.col("track") == "subtitle", 1)).alias("subtitles"),
        F.max("duration_seconds").alias("duration_seconds"),
        F.max("is_live").alias("is_live"),
    )
    labelled = with_labels(variants)
    described = F.concat(
        F.col("label"), F.lit(" ["), F.col("delivery"),
        F.coalesce(F.concat(F.lit(", "), F.col("language")), F.lit("")), F.lit("]"),
    )
    labelled = labelled.withColumn("described", described)
    by_score = [quality_score(F.col("height"), F.col("bandwidth")).desc(), F.col("ordinal")]
    by_rate = [F.coalesce("bandwidth", F.lit(0)).desc(), F.col("ordinal")]
    video = top_per(labelled.filter(F.col("track").isin("muxed", "video_only")), ["source_id"], by_score, 3, "_rank")
    audio = top_per(labelled.filter(F.col("track") == "audio_only"), ["source_id"], by_rate, 3, "_rank")

    def top(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("source_id").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_rank", "described"))), lambda r: r["described"]), "; "
            ).alias(name)
        )

    joined = counts.join(top(video, "_v"), "source_id", "left").join(top(audio, "_a"), "source_id", "left")

    def with_rest(shown: str, total: str) -> Column:
        rest = F.when(F.col(total) > 3, F.concat(F.lit("; +"), (F.col(total) - 3).cast("string"))).otherwise(F.lit(""))
        return F.concat(F.col(shown), rest)

    return joined.withColumns({"best_videos": with_rest("_v", "videos"), "best_audios": with_rest("_a", "audios")}).drop("_v", "_a")


def unique_names(df: DataFrame, path: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """The first of equal names keeps it, later ones get the free numbers " (2)", " (3)", ...

    Names compare without case. ``existing`` (one column, ``path``) counts as
    taken already, and a number is not free where a row asks for that very name.
    So no two results are equal and none is in ``existing``. A name may be as
    common as it likes: it is numbered in chunks of ``order``, an increasing
    number, and the free numbers are found by counting taken ones in order.
    """
    rows = df.withColumn("_name", F.lower(path))
    rows = row_numbers(rows, ["_name"], [order], by_count(order), "_number")
    # Names and places alone, dealt once: all that counts names below starts from this one exchange.
    narrow = df.select(F.lower(path).alias("_name"), F.col(order).alias("_place")).repartition("_place")
    asked = narrow.select("_name").distinct()
    there = asked if existing is None else asked.unionByName(existing.select(F.lower("path").alias("_name"))).distinct()
    if existing is not None:
        taken = existing.select(F.lower("path").alias("_name"), F.lit(1).alias("_taken")).distinct()
        rows = rows.join(taken, "_name", "left").withColumn("_number", F.col("_number") + F.coalesce("_taken", F.lit(0)))
        late = row_numbers(narrow, ["_name"], ["_place"], by_count("_place"), "_number").join(taken, "_name", "left")
        late = late.select("_name", (F.col("_number") + F.coalesce("_taken", F.lit(0))).alias("_number"))
    else:
        late = row_numbers(narrow, ["_name"], ["_place"], by_count("_place"), "_number")

    # Numbers in use: "stem (n).ext", written as we write it, with what it would be a number of.
    numbered = r"^(.*) \(([1-9][0-9]{0,8})\)((?:\.[^./\\]*)?)$"
    used = there.filter(F.col("_name").rlike(numbered)).select(
        F.concat(F.regexp_extract("_name", numbered, 1), F.regexp_extract("_name", numbered, 3)).alias("_name"),
        F.regexp_extract("_name", numbered, 2).cast("bigint").alias("_n"),
    ).filter(F.col("_n") > 1).join(asked, "_name", "left_semi")
    used = row_numbers(used, ["_name"], ["_n"], by_count("_n"), "_i")
    # n is the i-th number in use, so n - 1 - i numbers before it are free. The j-th newcomer passes those with fewer than j.
    marks = used.select("_name", ((F.col("_n") - 1 - F.col("_i")) * 2 + 1).alias("_at"), F.lit(1).alias("_mark"), F.lit(None).cast("bigint").alias("_j"))
    newcomers = late.filter(F.col("_number") > 1).select("_name", (F.col("_number") - 1).alias("_j"))
    asks = newcomers.select("_name", (F.col("_j") * 2).alias("_at"), F.lit(0).alias("_mark"), "_j")
    passed = running(marks.unionByName(asks), ["_name"], ["_at", "_mark"], by_count("_at"), {"_passed": Carry("sum", F.col("_mark"))})
    free = passed.filter("_mark = 0").select("_name", (F.col("_j") + 1).alias("_number"), (F.col("_j") + 1 + F.col("_passed")).alias("_free"))
    rows = rows.join(free, ["_name", "_number"], "left")

    parts = r"^(.*?)(\.[^./\\]*)?$"
    suffix = F.concat(F.lit(" ("), F.col("_free").cast("string"), F.lit(")"))
    renamed = F.concat(F.regexp_extract(path, parts, 1), suffix, F.regexp_extract(path, parts, 2))
    unique = F.when(F.col("_free").isNull(), F.col(path)).otherwise(renamed)
    return rows.withColumn("unique_path", unique).select(*df.columns, "unique_path")


def latest_probes(probes: DataFrame) -> DataFrame:
    """One probe per URL: the last by ``ts`` where there is one, else the one that says most."""
    order = [F.col("ts").desc_nulls_last()] if "ts" in probes.columns else []
    return first_per(probes, ["url"], [*order, F.col("content_length").desc_nulls_last(), F.col("content_type").desc_nulls_last()])


def progressive_variants(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """A direct file is its own only variant; a probe may add its size.

    ``probes`` has ``url, content_type, content_length``.
    """
    sizes = latest_probes(probes).select("url", F.col("content_length").alias("_probed"))
    rows = candidates.filter(F.col("kind").isin(K.VIDEO, K.AUDIO, K.SUBTITLE)).join(sizes, "url", "left")
    track = F.when(F.col("kind") == K.AUDIO, "audio_only").when(F.col("kind") == K.SUBTITLE, "subtitle").otherwise("muxed")
    extension = F.lower(F.regexp_replace(U.url_extension(U.url_path("url")), r"^\.", ""))
    rows = rows.withColumns({"track": track, "_ext": extension})
    default = F.when(F.col("track") == "audio_only", "m4a").otherwise("mp4")
    return rows.select(
        F.col("candidate_id").alias("source_id"),
        F.lit(0).cast("bigint").alias("ordinal"),
        F.col("candidate_id").alias("variant_id"),
        "url", "track",
        F.lit("progressive").alias("delivery"),
        F.coalesce("_probed", "content_length").alias("content_length"),
        F.coalesce(F.nullif("_ext", F.lit("")), default).alias("container"),
    )


def reclassify_by_probe(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """A file whose probed type is a manifest moves to the manifest branch."""
    types = latest_probes(probes).select("url", K.kind_by_mime(F.col("content_type")).alias("_probed_kind"))
    joined = candidates.join(types, "url", "left")
    is_file = F.col("kind").isin(K.VIDEO, K.AUDIO, K.SUBTITLE)
    moved = is_file & F.col("_probed_kind").isin(K.HLS, K.DASH)
    return joined.withColumn("resolve_kind", F.when(moved, F.col("_probed_kind")).otherwise(F.col("kind"))).drop("_probed_kind")


def resolve_with_fallback(native: DataFrame, extractor: DataFrame, candidates: DataFrame) -> DataFrame:
    """The own resolver if it gave variants, else the extractor on the page, else on the URL.

    ``native`` has ``source_id, variant_count`` by candidate id and ``extractor``
    has ``page_url, source_id, variant_count`` by the address it was given.
    """
    own = native.filter(F.col("variant_count") > 0).groupBy(F.col("source_id").alias("candidate_id")).agg(
        F.max("variant_count").alias("_own")
    )
    # An address that was given twice counts with the answer that found most.
    found = first_per(
        extractor.filter(F.col("variant_count") > 0), ["page_url"], [F.col("variant_count").desc(), F.col("source_id")]
    )
    on_page = found.select(F.col("page_url"), F.struct("source_id", "variant_count").alias("_page"))
    on_url = found.select(F.col("page_url").alias("url"), F.struct("source_id", "variant_count").alias("_url"))
    joined = (
        candidates.join(own, "candidate_id", "left").join(on_page, "page_url", "left").join(on_url, "url", "left")
    )
    is_page = F.col("kind") == K.PAGE
    page = F.when(~is_page, F.col("_page"))
    resolver = (
        F.when(F.col("_own").isNotNull() & ~is_page, "native")
        .when(page.isNotNull(), "extractor_page")
        .when(F.col("_url").isNotNull(), "extractor_url")
        .otherwise("unresolved")
    )
    joined = joined.withColumn("resolved_by", resolver)
    chosen = F.when(F.col("resolved_by") == "extractor_page", F.col("_page")).when(
        F.col("resolved_by") == "extractor_url", F.col("_url")
    )
    native_row = F.col("resolved_by") == "native"
    return joined.withColumns(
        {
            "source_id": F.when(native_row, F.col("candidate_id")).otherwise(chosen["source_id"]),
            "variant_count": F.when(native_row, F.col("_own")).otherwise(chosen["variant_count"]),
        }
    ).drop("_own", "_page", "_url")


# --- plans ------------------------------------------------------------------------------------

def make_plans(
    sources: DataFrame, variants: DataFrame, audio_only: bool = False, directory: str = "downloads",
    existing: DataFrame | None = None,
) -> DataFrame:
    """For each source its best video, the audio paired with it, and a free output name.

    ``sources`` has ``source_id, title, seq``; ``seq`` decides who keeps a name.
    """
    # Videos, audios and their pairs all start from the variants: their manifests are parsed once.
    rows = written(with_labels(conform(variants)))
    videos = pair_audio(best_videos(rows), audios_of(rows))
    audio = audios_of(rows).select(
        "source_id", F.col("variant_id").alias("audio_id"), F.col("ordinal").alias("audio_ordinal"),
        F.col("estimated_bytes").alias("audio_bytes"), F.col("external_format_id").alias("audio_format_id"),
    )
    joined = videos.join(audio, ["source_id", "audio_id", "audio_ordinal"], "left")
    wanted = F.lit(audio_only) | (F.col("track") == "video_only")
    segments = F.col("delivery").isin("hls_segments", "dash_segments")
    container = (
        F.when(F.lit(audio_only), F.when(F.col("container").isin("webm", "opus"), "opus").otherwise("m4a"))
        .when(segments, F.when(F.col("container") == "webm", "webm").otherwise("mp4"))
        .otherwise(F.coalesce(F.nullif(F.trim("container"), F.lit("")), F.lit("mp4")))
    )
    quality = F.lit("audio") if audio_only else X.resolution_label(F.col("width"), F.col("height"))
    joined = joined.join(sources.select("source_id", "title", "seq"), "source_id")
    joined = joined.withColumns(
        {c: F.when(wanted, F.col(c)) for c in ("audio_id", "audio_bytes", "audio_format_id", "audio_bandwidth", "audio_language")}
    )
    selector = (
        F.when(F.col("external_format_id").isNull(), F.lit(None))
        .when(F.lit(audio_only), F.coalesce("audio_format_id", F.lit("bestaudio/best")))
        .when(F.col("audio_format_id").isNull() | (F.col("track") == "muxed"), F.col("external_format_id"))
        .otherwise(F.concat("external_format_id", F.lit("+"), "audio_format_id"))
    )
    stem = pin(joined, {"_stem": X.safe_name(F.col("title")), "_container": container, "_quality": quality})
    path = F.concat(F.lit(f"{directory}/"), "_stem", F.lit(" ["), "_quality", F.lit("]."), "_container")
    plans = stem.select(
        "source_id", "seq", F.col("variant_id").alias("video_id"), "track", "delivery", "height", "bandwidth", "score",
        "duration_seconds", "is_live", "label", "audio_id", "audio_bandwidth", "audio_language",
        F.lit(audio_only).alias("audio_only"),
        (F.col("audio_id").isNotNull() & (F.col("track") == "video_only")).alias("needs_merge"),
        X.plan_bytes(F.col("estimated_bytes"), F.col("audio_bytes")).alias("estimated_bytes"),
        F.col("_container").alias("container"),
        selector.alias("format_selector"),
        path.alias("path"),
    )
    # Names are numbered over the plans several times: the joins behind them are run once, and their plan ends here.
    return unique_names(written(plans), "path", "seq", existing).withColumnRenamed("unique_path", "output_path").drop("path")


def compare_with_best(plans: DataFrame, variants: DataFrame) -> DataFrame:
    """What the source offered beside what was chosen: its best video and the best audio for the chosen one.

    ``plans`` has ``source_id, video_ordinal`` and may have ``audio_ordinal``.
    """
    # Six branches start from these rows: what is behind them is parsed once.
    rows = written(with_labels(conform(variants)))
    chosen = videos_of(rows).select(
        "source_id", F.col("ordinal").alias("video_ordinal"), "track", "delivery", "audio_group", "height", "bandwidth",
        "score", "duration_seconds", "is_live", "label", F.col("estimated_bytes").alias("video_bytes"), "language",
    )
    joined = plans.join(chosen, ["source_id", "video_ordinal"], "left")
    best = best_videos(rows).select("source_id", F.col("score").alias("best_score"), F.col("label").alias("best_label"))
    audio = audios_of(rows).select(
        "source_id", F.col("ordinal").alias("audio_ordinal"), F.coalesce("bandwidth", F.lit(0)).alias("chosen_audio_rate"),
        F.col("label").alias("audio_label"), F.col("estimated_bytes").alias("audio_bytes"),
    )
    joined = joined.join(best, "source_id", "left").join(audio, ["source_id", "audio_ordinal"], "left")
    paired = pair_audio(
        joined.withColumnRenamed("audio_ordinal", "_chosen"), audios_of(rows)
    ).withColumnRenamed("audio_bandwidth", "best_audio_rate")
    paired = paired.drop("audio_ordinal", "audio_id", "audio_language").withColumnRenamed("_chosen", "audio_ordinal")
    any_audio = audios_of(rows).select("source_id").distinct().withColumn("source_has_audio", F.lit(True))
    return paired.join(any_audio, "source_id", "left").fillna({"source_has_audio": False})


def audit_lines(plans: DataFrame, keys: Sequence[str], checks: list[tuple[Column, str, Column]]) -> DataFrame:
    """One row per check that holds, in the order of the list."""
    built = []
    for condition, tag, message in checks:
        level, code = tag.split("/")
        line = F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))
        built.append(F.when(condition, line))
    held = F.filter(F.array(*built), lambda line: line.isNotNull())
    rows = plans.select(*keys, F.posexplode(held).alias("line_no", "line"))
    return rows.select(*keys, "line_no", "line.level", "line.code", "line.message")


def audit_plans(compared: DataFrame) -> DataFrame:
    """What a plan is and what speaks against it, from the rows of ``compare_with_best``.

    Needs ``job_id, audio_only, muxer_available`` of the plan.
    """
    video_only = F.col("track") == "video_only"
    has_audio = F.col("audio_ordinal").isNotNull()
    merge = has_audio & video_only
    pictures = ~F.col("audio_only")
    no_muxer = ~F.col("muxer_available")
    external = F.col("delivery") == "external"
    segments = F.col("delivery").isin("hls_segments", "dash_segments")
    summary = F.concat(
        F.lit("plan: video "), "label", F.lit(" | audio "), F.coalesce("audio_label", F.lit("none")),
        F.when(F.col("audio_only"), " | AUDIO ONLY").otherwise(""), F.when(merge, " | merge tracks").otherwise(""),
    )
    below = F.concat(F.lit("chosen "), "label", F.lit(", best "), "best_label")
    return audit_lines(
        compared, ["job_id"],
        [
            (F.lit(True), "INFO/plan", summary),
            (pictures & video_only & ~has_audio, "WARN/mute", F.lit("the video track has no sound and no audio is paired")),
            (pictures & (F.col("best_score") > F.col("score")), "WARN/below_best_video", below),
            (
                has_audio & (F.coalesce("best_audio_rate", F.lit(0)) > F.col("chosen_audio_rate")), "WARN/below_best_audio",
                F.lit("better audio was on offer"),
            ),
            (no_muxer & external & merge, "WARN/no_muxer_extractor", F.lit("the extractor needs a muxer to merge")),
            (no_muxer & ~external & merge, "WARN/no_muxer_two_files", F.lit("video and audio stay two files")),
            (no_muxer & ~merge & segments, "WARN/no_muxer_raw", F.lit("the output is a raw stream")),
        ],
    )


def choice_warning(compared: DataFrame) -> DataFrame:
    """The one warning a choice deserves, by precedence. Needs ``muxer_available`` and ``free_bytes``.

    Space is judged by the video alone; an unknown size or volume does not warn.
    """
    required = X.required_bytes(F.col("video_bytes"))
    no_muxer = ~F.col("muxer_available")
    video_only = F.col("track") == "video_only"
    warning = (
        F.when((F.col("video_bytes") > 0) & (F.col("free_bytes") < required), "space")
        .when(video_only & ~F.col("source_has_audio"), "mute")
        .when(F.col("is_live"), "live")
        .when(video_only & no_muxer, "two_files")
        .when(F.col("delivery").isin("hls_segments", "dash_segments") & no_muxer, "raw_stream")
    )
    return compared.withColumn("warning", warning)


def subtitle_outputs(plans: DataFrame, subtitles: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A side file per subtitle, named by language, else name; a failed one becomes a job warning.

    ``plans`` has ``job_id, source_id, output_path``; ``subtitles`` has
    ``source_id, ordinal, seq, language, name, container, error``, where ``seq``
    numbers the rows.
    """
    joined = plans.select("job_id", "source_id", "output_path").join(subtitles, "source_id")
    suffix = F.coalesce("language", "name", F.lit("sub"))
    stem = F.regexp_replace("output_path", r"\.[^./\\]*$", "")
    path = F.concat(stem, F.lit("."), X.safe_name(suffix, "sub", 20), F.lit("."), "container")
    warning = F.when(
        F.col("error").isNotNull(), F.concat(F.lit("subtitle '"), suffix, F.lit("' failed: "), "error")
    )
    rows = joined.withColumns({"path": path, "warning": warning})
    named = unique_names(rows, "path", "seq", existing)
    return named.select("job_id", "source_id", "ordinal", F.col("unique_path").alias("subtitle_path"), "warning")
