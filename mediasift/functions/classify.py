"""Media classification (C1-C8, C10, C13-C15) as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Kind codes.
UNKNOWN = "unknown"
VIDEO = "progressive_video"
AUDIO = "progressive_audio"
HLS = "hls_playlist"
DASH = "dash_manifest"
SMOOTH = "smooth_manifest"
SEGMENT = "media_segment"
SUBTITLE = "subtitle"
PAGE = "page_embed"

DOWNLOADABLE_KINDS = (VIDEO, AUDIO, HLS, DASH, SMOOTH, SUBTITLE, PAGE)
STREAMING_KINDS = (HLS, DASH, SMOOTH)

# Extension and MIME tables, noise fragments, codec prefixes, DRM systems.
VIDEO_EXTENSIONS = (
    ".mp4", ".m4v", ".webm", ".mkv", ".mov", ".flv", ".avi", ".ogv", ".3gp", ".mpg", ".mpeg", ".wmv",
)
AUDIO_EXTENSIONS = (".mp3", ".m4a", ".aac", ".opus", ".ogg", ".oga", ".flac", ".wav", ".weba")
SEGMENT_EXTENSIONS = (
    ".ts", ".m4s", ".cmfv", ".cmfa", ".cmft", ".fmp4", ".dash", ".seg", ".aac_seg",
)
SUBTITLE_EXTENSIONS = (".vtt", ".srt", ".ttml", ".dfxp", ".ssa", ".ass")
HLS_EXTENSIONS = (".m3u8", ".m3u")
SMOOTH_EXTENSIONS = (".ism", ".isml")

HLS_MIMES = (
    "application/vnd.apple.mpegurl", "application/x-mpegurl", "audio/mpegurl",
    "audio/x-mpegurl", "application/mpegurl",
)
DASH_MIMES = ("application/dash+xml",)
SMOOTH_MIMES = ("application/vnd.ms-sstr+xml",)
SEGMENT_MIMES = ("video/mp2t", "video/iso.segment", "audio/iso.segment")
SUBTITLE_MIMES = (
    "text/vtt", "application/x-subrip", "application/ttml+xml", "application/ttaf+xml",
)
OPAQUE_MIMES = ("application/vnd.yt-ump", "application/vnd.yt-sabr")

NOISE_HOSTS = (
    "doubleclick.net", "googlesyndication.com", "google-analytics.com", "googletagmanager.com",
    "scorecardresearch.com", "adsystem.com", "adnxs.com", "moatads.com", "imasdk.googleapis.com",
    "amazon-adsystem.com", "criteo.", "taboola.com", "outbrain.com", "quantserve.com",
)
NOISE_PATHS = (
    "/ads/", "/advert", "/preroll", "/midroll", "/beacon", "/pixel", "/tracking", "/s/search/audio/",
)

VIDEO_CODECS = (
    "avc1", "avc3", "hvc1", "hev1", "vp8", "vp9", "vp09", "av01", "dvh1", "dvhe", "mp4v", "theora",
)
AUDIO_CODECS = (
    "mp4a", "ac-3", "ec-3", "opus", "vorbis", "mp3", "alac", "flac", "dtsc", "dtse", "ac-4",
)

DASH_DRM_SYSTEMS = (
    ("edef8ba9-79d6-4ace-a3c8-27dcd51d21ed", "Widevine"),
    ("9a04f079-9840-4286-ab92-e65be0885f95", "PlayReady"),
    ("94ce86fb-07ff-4f43-adb8-93d2fa968ca2", "FairPlay"),
    ("e2719d58-a985-b3c9-781a-b030af78d30e", "ClearKey"),
    ("mp4protection", "CENC"),
)

REFUSAL_STATUS = (401, 403)
RETRYABLE_STATUS = (408, 429, 500, 502, 503, 504)


def _alternation(words) -> str:
    return "|".join(re.escape(w) for w in words)


def bare_mime(mime: Column) -> Column:
    """MIME type without parameters, trimmed and lower-cased; '' for NULL."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(mime, F.lit("")), r"(?s);.*$", "")))


def kind_of_bare_mime(m: Column) -> Column:
    return (
        F.when(m.isin(*HLS_MIMES), F.lit(HLS))
        .when(m.isin(*DASH_MIMES), F.lit(DASH))
        .when(m.isin(*SMOOTH_MIMES), F.lit(SMOOTH))
        .when(m.isin(*SEGMENT_MIMES), F.lit(SEGMENT))
        .when(m.isin(*SUBTITLE_MIMES), F.lit(SUBTITLE))
        .when(m.startswith("video/"), F.lit(VIDEO))
        .when(m.startswith("audio/"), F.lit(AUDIO))
        .otherwise(F.lit(UNKNOWN))
    )


def kind_by_mime(mime: Column) -> Column:
    """C1."""
    return kind_of_bare_mime(bare_mime(mime))


def looks_like_fragment(path: Column) -> Column:
    """C4: the stem of the last path segment is an init or segment marker, or all digits."""
    stem = F.lower(F.regexp_extract(path, r"([^/\\:]*?)(?:\.[^./\\:]*)?$", 1))
    marker = (
        r"^(?:init|initialization|header)$|^init[-_]|[-_]init$|^(?:seg|chunk|frag)[-_]"
        r"|^media-.*\.|^[0-9]+$"
    )
    return (stem != "") & stem.rlike(marker)


def path_extension(path: Column, query: Column) -> Column:
    """Extension of the path, or one hidden in a query value if the path has none."""
    own = urls.url_extension(path)
    return F.when((own == "") & (query != ""), urls.extension_from_query(query)).otherwise(own)


def kind_of_path(path: Column, extension: Column) -> Column:
    """C2. Playlist extensions compare case-sensitively, the others do not."""
    ext = F.lower(extension)
    lower_path = F.lower(path)
    fragment = looks_like_fragment(path)
    return (
        F.when(extension.isin(*HLS_EXTENSIONS), F.lit(HLS))
        .when(extension == ".mpd", F.lit(DASH))
        .when(extension.isin(*SMOOTH_EXTENSIONS), F.lit(SMOOTH))
        .when(lower_path.endswith("/manifest") | lower_path.contains(".ism/manifest"), F.lit(SMOOTH))
        .when(ext.isin(*SEGMENT_EXTENSIONS), F.lit(SEGMENT))
        .when(ext.isin(*SUBTITLE_EXTENSIONS), F.lit(SUBTITLE))
        .when(ext.isin(*VIDEO_EXTENSIONS), F.when(fragment, F.lit(SEGMENT)).otherwise(F.lit(VIDEO)))
        .when(ext.isin(*AUDIO_EXTENSIONS), F.when(fragment, F.lit(SEGMENT)).otherwise(F.lit(AUDIO)))
        .otherwise(F.lit(UNKNOWN))
    )


def kind_by_path(url: Column) -> Column:
    path = urls.url_path(url)
    return kind_of_path(path, path_extension(path, urls.url_query(url)))


def noise_of_parts(host: Column, path: Column) -> Column:
    return host.rlike(f"(?i){_alternation(NOISE_HOSTS)}") | path.rlike(f"(?i){_alternation(NOISE_PATHS)}")


def is_noise(url: Column) -> Column:
    """C7."""
    return noise_of_parts(urls.url_host(url), urls.url_path(url))


def reconcile(by_path: Column, by_mime: Column) -> Column:
    """A specific path wins, except against a segment MIME or audio in a video file."""
    return (
        F.when(by_path == UNKNOWN, by_mime)
        .when(by_mime == SEGMENT, F.lit(SEGMENT))
        .when((by_path == VIDEO) & (by_mime == AUDIO), F.lit(AUDIO))
        .otherwise(by_path)
    )


def classify(url: Column, mime: Column) -> Column:
    """C5 over whole columns. Unknown for noise and for anything but http(s)."""
    return F.when(
        urls.is_web_url(url) & ~is_noise(url), reconcile(kind_by_path(url), kind_by_mime(mime))
    ).otherwise(F.lit(UNKNOWN))


def kind_from_resource(resource_type: Column, mime: Column) -> Column:
    """The browser's own ``Media`` stamp, used when URL and MIME say nothing."""
    is_media = F.lower(F.trim(F.coalesce(resource_type, F.lit("")))) == "media"
    audio = bare_mime(mime).startswith("audio/")
    return F.when(is_media, F.when(audio, F.lit(AUDIO)).otherwise(F.lit(VIDEO))).otherwise(F.lit(UNKNOWN))


def is_opaque(mime: Column) -> Column:
    """C8."""
    return bare_mime(mime).isin(*OPAQUE_MIMES)


def is_downloadable(kind: Column) -> Column:
    return kind.isin(*DOWNLOADABLE_KINDS)


def is_streaming(kind: Column) -> Column:
    return kind.isin(*STREAMING_KINDS)


def _has_codec(codecs: Column, prefixes) -> Column:
    # One codec per comma; blanks and quotes around it do not count.
    return F.coalesce(codecs.rlike(rf'(?i)(?:^|,)[\s"]*(?:{_alternation(prefixes)})'), F.lit(False))


def has_video(codecs: Column) -> Column:
    """C13."""
    return _has_codec(codecs, VIDEO_CODECS)


def has_audio(codecs: Column) -> Column:
    return _has_codec(codecs, AUDIO_CODECS)


def is_audio_only(codecs: Column) -> Column:
    return has_audio(codecs) & ~has_video(codecs)


def hls_drm(method: Column, key_format: Column) -> Column:
    """C14: the system that holds an HLS key, NULL when no DRM system does."""
    m = F.lower(method)
    fmt = F.lower(key_format)
    fair = r"streamingkeydelivery|fairplay"
    is_drm = ~m.isin("none", "aes-128") & (
        fmt.isNull() | fmt.rlike(rf"widevine|playready|{fair}|^urn:uuid:")
    )
    text = F.coalesce(fmt, m)
    name = (
        F.when(text.rlike("widevine|edef8ba9"), "Widevine")
        .when(text.rlike("playready|9a04f079"), "PlayReady")
        .when(text.rlike(fair), "FairPlay")
        .otherwise("DRM")
    )
    return F.when(is_drm, name)


def dash_drm(scheme: Column) -> Column:
    """C14: the system behind a content-protection scheme, NULL when it is not DRM."""
    lowered = F.lower(scheme)
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for marker, name in DASH_DRM_SYSTEMS:
        result = result.when(lowered.contains(marker), F.lit(name))
    return result


def status_class(code: Column) -> Column:
    """C15."""
    return (
        F.when(code.isin(*REFUSAL_STATUS), "refused")
        .when(code.isin(*RETRYABLE_STATUS), "retryable")
        .when(code.between(200, 299), "success")
        .otherwise("other")
    )
