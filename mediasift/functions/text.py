"""Names, labels, clocks and number parsing (X6, X8-X11, X14-X20) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .binding import let
from .classify import HLS, DASH, SMOOTH, VIDEO, AUDIO, SEGMENT, SUBTITLE, PAGE, UNKNOWN

# Device names that may not be file names, and the size limits of the checks.
RESERVED_NAMES = (
    "con", "prn", "aux", "nul",
    "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9",
    "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9",
)
MINIMUM_FREE_BYTES = 256 * 1024 * 1024
SPACE_FACTOR = 2.2
KIND_LABELS = {
    VIDEO: "Video file", AUDIO: "Audio file", HLS: "HLS", DASH: "DASH", SMOOTH: "Smooth Streaming",
    SEGMENT: "Fragment", SUBTITLE: "Subtitle", PAGE: "Page", UNKNOWN: "Unknown",
}

_INVALID_NAME_CHARS = r'[\x00-\x1F\x7F-\x9F":<>|*?\\/]'


# --- guarded number parsing -------------------------------------------------------------------
# try_cast alone accepts '1d' and 'NaN'; the reference's parsers do not, so a pattern decides first.

_DIGITS = r"^[0-9]{1,9}\z"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def _guarded(text: Column, pattern: str, kind: str) -> Column:
    """A cast of what fits the pattern only: a cast that fails builds an exception, which costs more than the pattern."""
    spelled = F.when(text.rlike(pattern), F.btrim(text, F.lit(" \t\n\x0b\f\r")).try_cast(kind))
    # Most are a few digits, which need neither the wider pattern nor the trimming.
    return F.when(text.rlike(_DIGITS), text.try_cast(kind)).otherwise(spelled)


def to_long(text: Column) -> Column:
    return _guarded(text, _INTEGER, "bigint")


def to_int(text: Column) -> Column:
    return _guarded(text, _INTEGER, "int")


def to_double(text: Column) -> Column:
    return _guarded(text, _DECIMAL, "double")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


# --- names ------------------------------------------------------------------------------------

def safe_name(text: Column, fallback: str = "video", max_length: int = 120) -> Column:
    """A name every file system accepts."""
    spaced = F.regexp_replace(F.regexp_replace(text, _INVALID_NAME_CHARS, " "), r"[\s\p{Z}]+", " ")
    trimmed = F.regexp_replace(spaced, r"^[ .]+|[ .]+$", "")
    cut = F.regexp_replace(F.substring(trimmed, 1, max_length), r"[ .]+$", "")
    return let(
        cut,
        lambda name: F.when(name.isNull() | (name == ""), F.lit(fallback))
        .when(F.lower(name).isin(*RESERVED_NAMES), F.concat(name, F.lit("_")))
        .otherwise(name),
    )


def file_stem(name: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\:]*)$", 1), r"\.[^.]*$", "")


def name_from_url(url: Column) -> Column:
    """Decoded stem of the last path segment, else the host."""
    segment = F.regexp_extract(urls.url_path(url), r"([^/]+)/*$", 1)
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(segment, r"\+", "%2B")), segment)
    return let(
        file_stem(decoded),
        lambda stem: F.when(F.trim(stem) != "", safe_name(stem)).otherwise(safe_name(urls.url_host(url))),
    )


# --- labels -----------------------------------------------------------------------------------

def fmt_bytes(value: Column) -> Column:
    """1024-based size with one decimal below ten units."""
    v = value.cast("double")
    result = F.when(value.isNull() | (value < 0), F.lit("-")).when(
        v < 1024, F.concat(value.cast("bigint").cast("string"), F.lit(" B"))
    )
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        scaled = v / F.lit(float(1024 ** power))
        text = F.when(scaled < 10, F.format_string("%.1f", F.round(scaled, 1))).otherwise(
            F.format_string("%.0f", F.round(scaled, 0))
        )
        text = F.concat(text, F.lit(f" {unit}"))
        result = result.otherwise(text) if unit == "TB" else result.when(v < float(1024 ** (power + 1)), text)
    return result


def fmt_rate(bytes_per_second: Column) -> Column:
    return F.when(bytes_per_second <= 0, F.lit("-")).otherwise(
        F.concat(fmt_bytes(F.floor(bytes_per_second)), F.lit("/s"))
    )


def fmt_duration(seconds: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from an hour on."""
    whole = F.floor(seconds)
    hours, minutes, rest = F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), F.lit("-"))
        .when(hours >= 1, F.format_string("%d:%02d:%02d", hours, minutes, rest))
        .otherwise(F.format_string("%d:%02d", minutes, rest))
    )


def fmt_clock(seconds: Column) -> Column:
    """``HH:MM:SS`` within a day."""
    whole = F.floor(seconds)
    return F.format_string(
        "%02d:%02d:%02d", F.floor(whole / 3600) % 24, F.floor((whole % 3600) / 60), whole % 60
    )


def fmt_bitrate(bits_per_second: Column) -> Column:
    bps = bits_per_second.cast("double")
    return (
        F.when(bits_per_second.isNull() | (bits_per_second <= 0), F.lit("-"))
        .when(bps >= 1e6, F.concat(F.format_string("%.1f", F.round(bps / 1e6, 1)), F.lit(" Mbps")))
        .otherwise(F.concat(F.format_string("%.0f", F.round(bps / 1e3, 0)), F.lit(" kbps")))
    )


def resolution_label(width: Column, height: Column) -> Column:
    return (
        F.when(height >= 4320, F.lit("8K"))
        .when(height >= 2160, F.lit("4K"))
        .when(height.isNotNull(), F.concat(height.cast("string"), F.lit("p")))
        .when(width.isNotNull(), F.concat(width.cast("string"), F.lit("px")))
        .otherwise(F.lit("SD"))
    )


def friendly_codec(codecs: Column, track: Column) -> Column:
    """The codec name a person knows, by track type."""
    c = F.lower(codecs)
    audio = (
        F.when(c.contains("opus"), "Opus").when(c.contains("mp4a"), "AAC").when(c.contains("ec-3"), "E-AC3")
        .when(c.contains("ac-3"), "AC3").when(c.contains("mp3"), "MP3").when(c.contains("flac"), "FLAC")
    )
    video = (
        F.when(c.contains("av01"), "AV1").when(c.rlike("vp0?9"), "VP9").when(c.rlike("hvc1|hev1"), "HEVC")
        .when(c.rlike("avc1|h264"), "H.264").when(c.contains("vp8"), "VP8")
    )
    return F.when(track == "audio_only", audio).otherwise(video)


def variant_label(
    track: Column, width: Column, height: Column, frame_rate: Column, bandwidth: Column,
    codecs: Column, language: Column, name: Column, is_live: Column,
) -> Column:
    """The line a person would pick a quality by."""
    head = (
        F.when(track == "audio_only", F.when(is_blank(name), F.lit("Audio")).otherwise(name))
        .when(
            track == "subtitle",
            F.concat(F.lit("Subtitle"), F.coalesce(F.concat(F.lit(" ("), language, F.lit(")")), F.lit(""))),
        )
        .otherwise(resolution_label(width, height))
    )
    pictures = F.when(
        ~track.isin("audio_only", "subtitle") & (frame_rate > 31),
        F.concat(F.format_string("%.0f", F.round(frame_rate, 0)), F.lit("fps")),
    )
    rate = F.when((track != "subtitle") & (bandwidth > 0), fmt_bitrate(bandwidth))
    return F.concat_ws(
        " - ", head, pictures, rate, friendly_codec(codecs, track), F.when(is_live, F.lit("LIVE"))
    )


def label_of(value: Column, labels: dict[str, str], default: str) -> Column:
    """Look a code up in a replaceable label dimension."""
    result = F.when(F.lit(False), F.lit(default))
    for code, label in labels.items():
        result = result.when(value == code, F.lit(label))
    return result.otherwise(F.lit(default))


def kind_label(kind: Column) -> Column:
    return label_of(kind, KIND_LABELS, "Unknown")


def short_url(url: Column) -> Column:
    return F.when(F.length(url) <= 90, url).otherwise(
        F.concat(F.substring(url, 1, 60), F.lit("..."), F.substring(url, -25, 25))
    )


def display_name(kind: Column, title: Column, url: Column) -> Column:
    streaming = kind.isin(HLS, DASH, SMOOTH)
    return F.when(~is_blank(title) & streaming, title).otherwise(name_from_url(url))


# --- arithmetic -------------------------------------------------------------------------------

def estimated_bytes(content_length: Column, bandwidth: Column, seconds: Column) -> Column:
    """Known size, else bit rate times duration, truncated."""
    guess = F.when((bandwidth > 0) & (seconds > 0), F.floor(bandwidth / F.lit(8.0) * seconds))
    return F.coalesce(content_length, guess)


def plan_bytes(video: Column, audio: Column) -> Column:
    return F.when(
        video.isNotNull() | audio.isNotNull(), F.coalesce(video, F.lit(0)) + F.coalesce(audio, F.lit(0))
    )


def required_bytes(estimate: Column) -> Column:
    """2.2 times the estimate, never below 256 MiB, saturating."""
    wanted = F.lit(SPACE_FACTOR) * estimate.cast("double")
    largest = 9223372036854775807
    return (
        F.when(estimate.isNull() | (estimate <= 0), F.lit(MINIMUM_FREE_BYTES).cast("bigint"))
        .when(wanted >= float(largest), F.lit(largest))
        .otherwise(F.greatest(F.lit(MINIMUM_FREE_BYTES).cast("bigint"), F.floor(wanted)))
    )


def progress_fraction(done: Column, total: Column, received: Column, total_bytes: Column) -> Column:
    """X11: by segments when they are counted, else by bytes, else unknown."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.when(total > 0, F.greatest(zero, F.least(one, done.cast("double") / total)))
        .when(total_bytes > 0, F.greatest(zero, F.least(one, received.cast("double") / total_bytes)))
    )


def eta_seconds(received: Column, total_bytes: Column, rate: Column) -> Column:
    return F.when(
        (rate > 1) & (total_bytes > 0), F.greatest(F.lit(0.0), (total_bytes - received) / rate)
    )


def progress_label(done: Column, total: Column, received: Column, total_bytes: Column) -> Column:
    return (
        F.when(total > 0, F.concat(done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" segments")))
        .when(total_bytes > 0, F.concat(fmt_bytes(received), F.lit(" / "), fmt_bytes(total_bytes)))
        .otherwise(fmt_bytes(received))
    )


# --- protocol values --------------------------------------------------------------------------

def asset_length(content_range: Column, content_length: Column) -> Column:
    """Size of the asset: total of the content range first, then the content length."""
    return F.coalesce(to_long(F.regexp_extract(content_range, r"/([^/]*)$", 1)), to_long(content_length))


def range_bounds(header: Column) -> Column:
    """``bytes=a-b`` to a struct of start and end; anything else is the whole resource."""
    body = F.regexp_extract(header, r"(?i)^bytes=(.*)$", 1)
    start = to_long(F.regexp_extract(body, r"^([^-]*)", 1))
    end = to_long(F.regexp_extract(body, r"^[^-]*-(.*)$", 1))
    return F.struct(F.coalesce(start, F.lit(0)).alias("start"), F.when(start.isNotNull(), end).alias("end"))


def range_header(offset: Column, length: Column) -> Column:
    """Offset and length back to a header; NULL unless both are known."""
    return F.concat(
        F.lit("bytes="), offset.cast("string"), F.lit("-"), (offset + length - 1).cast("string")
    )


def frame_rate(text: Column) -> Column:
    """``30`` or ``30000/1001``; a zero denominator gives NULL."""
    above = to_double(F.regexp_extract(text, r"^([^/]*)", 1))
    below = to_double(F.regexp_extract(text, r"^[^/]*/(.*)$", 1))
    return F.when(text.contains("/"), F.try_divide(above, below)).otherwise(above)


def hex_bytes(text: Column) -> Column:
    """Hexadecimal with optional 0x; an odd length is no value at all."""
    digits = F.regexp_replace(F.trim(text), "(?i)^0x", "")
    return F.when(digits.rlike("^(?:[0-9A-Fa-f]{2})+$"), F.unhex(digits))


def resolution(text: Column) -> Column:
    """``WxH`` to a struct of width and height."""
    pattern = "^([^xX]*)[xX]([^xX]*)$"
    return F.struct(
        to_int(F.regexp_extract(text, pattern, 1)).alias("width"),
        to_int(F.regexp_extract(text, pattern, 2)).alias("height"),
    )


def clock_seconds(text: Column) -> Column:
    """``H:MM:SS.ff`` to seconds."""
    pattern = "^([^:]*):([^:]*):([^:]*)$"
    hours = to_int(F.regexp_extract(text, pattern, 1))
    minutes = to_int(F.regexp_extract(text, pattern, 2))
    seconds = to_double(F.regexp_extract(text, pattern, 3))
    return hours * F.lit(3600.0) + minutes * F.lit(60.0) + seconds


_ISO_DURATION = (
    r"^(-)?P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?"
    r"(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]*)?)S)?)?$"
)


def iso_seconds(text: Column) -> Column:
    """ISO-8601 duration to seconds; a year is 365 days and a month 30."""
    t = F.trim(text)

    def part(group: int, seconds: float) -> Column:
        return F.coalesce(to_double(F.regexp_extract(t, _ISO_DURATION, group)), F.lit(0.0)) * F.lit(seconds)

    total = (
        part(2, 365 * 86400.0) + part(3, 30 * 86400.0) + part(4, 86400.0)
        + part(5, 3600.0) + part(6, 60.0) + part(7, 1.0)
    )
    valid = t.rlike(_ISO_DURATION) & t.rlike("[0-9][A-Z]") & ~t.endswith("T")
    spelled = F.when(valid, F.when(t.startswith("-"), -total).otherwise(total))

    def unit(name: str, seconds: float) -> Column:
        given = F.when(text.contains(name), F.regexp_extract(text, f"([0-9.]+){name}", 1).try_cast("double"))
        return F.coalesce(given, F.lit(0.0)) * F.lit(seconds)

    # Most durations are hours, minutes and seconds only; of these only the units that stand there are looked up.
    short = text.rlike(r"^PT(?=[0-9])(?:[0-9]{1,9}H)?(?:[0-9]{1,9}M)?(?:[0-9]{1,9}(?:\.[0-9]{1,9})?S)?\z")
    return F.when(short, unit("H", 3600.0) + unit("M", 60.0) + unit("S", 1.0)).otherwise(F.when(text.isNotNull(), spelled))


def resume_identity(count: Column, first_uri: Column, last_uri: Column, first_range: Column, last_range: Column) -> Column:
    """What may not change between two attempts at the same stream."""
    empty = F.lit("")
    return F.when(count == 0, empty).otherwise(
        F.concat(
            count.cast("string"), F.lit("|"), F.coalesce(first_uri, empty), F.lit("|"),
            F.coalesce(last_uri, empty), F.lit("|"), F.coalesce(first_range, empty), F.lit("|"),
            F.coalesce(last_range, empty),
        )
    )
