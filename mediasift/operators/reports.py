"""Reports as ordered lines (K1, K2).

A report is rows of ``(section, part, item, line_no, line)``; sorting by those
columns is the document. Nothing gathers the rows of a target: each observation
makes its own line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as R
from ..functions import text as X

MARKERS = {"passed": "[ok]", "failed": "[failed]", "error": "[error]"}
EXPECTED = {
    "stream": "an HLS or DASH manifest", "file": "a progressive file",
    "video": "a video: file, manifest, or extracted page", "drm_refusal": "recognise the DRM and refuse",
}


def _lines(rows: DataFrame, section: Column, part: int, item: Column, texts: list[Column]) -> DataFrame:
    exploded = rows.select(section.alias("section"), item.cast("bigint").alias("item"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
    return exploded.filter(F.col("line").isNotNull()).select("section", F.lit(part).alias("part"), "item", "line_no", "line")


def _size(value: Column) -> Column:
    """1024-based size with at most one decimal, '-' when there is none."""
    v = value.cast("double")
    result = F.when(value.isNull() | (value <= 0), F.lit("-"))
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.concat(F.regexp_replace(F.format_string("%.1f", F.round(v / float(1024 ** power), 1)), r"\.0$", ""), F.lit(f" {unit}"))
        result = result.otherwise(text) if unit == "TB" else result.when(v < float(1024 ** (power + 1)), text)
    return result


def render_detection_report(verdicts: DataFrame, observations: DataFrame, title: str) -> DataFrame:
    """K1: header, one section per target in the order of ``target_no``, a table row per observation.

    All addresses and messages are redacted.
    """
    zero = F.lit(0)
    totals = verdicts.agg(F.count(F.when(F.col("outcome") == "passed", 1)).alias("p"), F.count("*").alias("n"))
    header = _lines(
        totals, F.lit(-1).cast("bigint"), 0, zero,
        [F.lit("# Detection check"), F.lit(""), F.lit(title), F.lit(""),
         F.concat(F.lit("**"), F.col("p").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit("** targets passed."))],
    )
    seconds = F.concat(F.lit("- Time: "), F.format_string("%.1f", F.round(F.coalesce("elapsed_s", F.lit(0.0)), 1)), F.lit("s"))
    some = F.col("observed") > 0
    sections = _lines(
        verdicts, F.col("target_no").cast("bigint"), 0, zero,
        [
            F.lit(""),
            F.concat(F.lit("## "), X.label_of(F.col("outcome"), MARKERS, "[error]"), F.lit(" "), F.col("name")),
            F.lit(""),
            F.concat(F.lit("- Page: `"), R.redact_text(F.col("url")), F.lit("`")),
            F.concat(F.lit("- Expected: "), X.label_of(F.col("expectation"), EXPECTED, "any downloadable media")),
            F.concat(F.lit("- Result: "), R.redact_text(F.col("summary"))),
            seconds,
            F.when(some, F.lit("")),
            F.when(some, F.lit("| Kind | Qualities | Size | URL |")),
            F.when(some, F.lit("| --- | --- | --- | --- |")),
        ],
    )
    qualities = (
        F.when(F.col("is_protected"), F.concat(F.lit("DRM: "), F.coalesce("system", F.lit("unknown"))))
        .when(F.col("variant_count") > 0, F.col("variant_count").cast("string"))
        .when(F.col("error").isNotNull(), R.redact_text(F.col("error")))
        .otherwise(F.lit("-"))
    )
    places = verdicts.select(F.col("name").alias("target"), F.col("target_no").alias("_no"))
    seen = observations.join(places, "target")
    row = F.concat(
        F.lit("| "), X.kind_label(F.col("kind")), F.lit(" | "), qualities, F.lit(" | "), _size(F.col("content_length")),
        F.lit(" | `"), R.scrub_url(F.col("url")), F.lit("` |"),
    )
    table = _lines(seen, F.col("_no").cast("bigint"), 1, F.col("ordinal"), [row])
    return header.unionByName(sections).unionByName(table).orderBy("section", "part", "item", "line_no")


def _cell(value: Column) -> Column:
    folded = F.regexp_replace(R.redact_text(value), r"\r\n|[\r\n]", " ")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.regexp_replace(folded, r"\|", r"\\|"))


def _transferred(value: Column) -> Column:
    v = value.cast("double")
    # format_string writes something for NULL too, so both branches ask for a value first.
    megabytes = F.concat(F.format_string("%.1f", F.round(v / 1048576.0, 1)), F.lit(" MB"))
    kilobytes = F.concat(F.format_string("%.1f", F.round(v / 1024.0, 1)), F.lit(" KB"))
    return F.when(value >= 1 << 20, megabytes).when(value.isNotNull(), kilobytes)


def render_attempt_report(outcomes: DataFrame, attempts: DataFrame, title: str) -> DataFrame:
    """K2: header, a table of the best attempt per target, then every attempt by target."""
    zero = F.lit(0)
    ok = F.count(F.when(F.col("outcome").isin("downloaded", "downloading"), 1))
    totals = outcomes.agg(ok.alias("p"), F.count("*").alias("n"))
    header = _lines(
        totals, F.lit(-2).cast("bigint"), 0, zero,
        [F.concat(F.lit("# Download check, "), F.lit(title)), F.lit(""),
         F.concat(F.col("p").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" downloaded")), F.lit(""),
         F.lit("| Target | Result | Via | Bytes | Error |"), F.lit("| --- | --- | --- | --- | --- |")],
    )
    best = F.concat(
        F.lit("| "), "name", F.lit(" | "), "outcome", F.lit(" | "), F.coalesce("best.resolved_by", F.lit("-")), F.lit(" | "),
        F.coalesce(_transferred(F.col("best.bytes")), F.lit("-")), F.lit(" | "), _cell(F.col("best.error")), F.lit(" |"),
    )
    table = _lines(outcomes, F.lit(-1).cast("bigint"), 0, F.col("target_no"), [best])
    tried = outcomes.filter(F.col("attempts") > 0)
    sections = _lines(
        tried, F.col("target_no").cast("bigint"), 0, zero,
        [F.lit(""), F.concat(F.lit("## "), "name"), F.lit(""), F.concat(F.lit("- Page: `"), "url", F.lit("`"))],
    )
    places = outcomes.select(F.col("name").alias("target"), F.col("target_no").alias("_no"))
    line = F.concat(
        F.lit("- "), "outcome", F.lit(", "), "kind", F.lit(" via "), F.coalesce("resolved_by", F.lit("-")), F.lit(", "),
        F.coalesce("quality", F.lit("-")), F.lit(", "), _transferred(F.col("bytes")), F.lit(" in "),
        F.format_string("%.0f", F.round(F.coalesce("elapsed_s", F.lit(0.0)), 0)), F.lit("s, `"), R.scrub_url(F.col("url")), F.lit("`"),
    )
    error = F.when(F.col("error").isNotNull(), F.concat(F.lit("  - error: "), _cell(F.col("error"))))
    items = _lines(attempts.join(places, "target"), F.col("_no").cast("bigint"), 1, F.col("ordinal"), [line, error])
    return header.unionByName(table).unionByName(sections).unionByName(items).orderBy("section", "part", "item", "line_no")
