"""Network events and page media elements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as X
from ..functions import urls as U
from .ordered import first_per
from .pinning import pin

METHODS = (
    "Network.requestWillBeSent", "Network.requestWillBeSentExtraInfo", "Network.responseReceived",
    "Network.loadingFinished", "Network.loadingFailed",
)
EVENT_SCHEMA = "visit_id BIGINT, seq BIGINT, ts TIMESTAMP, method STRING, params STRING"
PARAMS_SCHEMA = (
    "requestId STRING, type STRING, headers MAP<STRING,STRING>,"
    " request STRUCT<url STRING, headers MAP<STRING,STRING>>,"
    " response STRUCT<url STRING, mimeType STRING, headers MAP<STRING,STRING>>"
)
DOM_SCHEMA = (
    "kind STRING, src STRING, tag STRING, duration DOUBLE, width INT, height INT, poster STRING, title STRING, page STRING"
)


def parse_net_events(events: DataFrame) -> DataFrame:
    """Parse the parameters of the five methods; malformed payloads and rows without an id drop out."""
    known = events.filter(F.col("method").isin(*METHODS))
    parsed = pin(known, {"p": F.from_json("params", PARAMS_SCHEMA)}).filter(F.col("p.requestId").isNotNull())
    return parsed.withColumn("request_id", F.col("p.requestId")).drop("params")


def correlate_requests(events: DataFrame, pages: DataFrame | None = None, by: Sequence[str] = ("visit_id",)) -> DataFrame:
    """One observation per response, with the identity its request was sent with.

    The latest request and the latest extra headers of an id are taken over all its rows, so an extra-info that comes
    after the response still counts, in one pass: rows move once and nothing is joined or collected. A response without a
    request is kept. ``pages`` has the ``by`` columns and ``page_url, page_title``.
    """
    key = [*by, "request_id"]
    method = F.col("method")
    rows = events.filter(method.isin(*METHODS[:3])).select(
        *key, "seq", "ts", method,
        F.when(method == METHODS[0], F.struct(F.col("p.request.url").alias("url"), F.col("p.request.headers").alias("headers"))).alias("_request"),
        F.when(method == METHODS[1], F.struct(F.col("p.headers").alias("headers"))).alias("_more"),
        F.when(method == METHODS[2], F.col("p.response")).alias("_response"),
        F.when(method == METHODS[2], F.col("p.type")).alias("resource_type"),
    )
    alike = Window.partitionBy(*key)
    joined = rows.withColumns({
        "_sent": F.max_by("_request", F.when(method == METHODS[0], F.col("seq"))).over(alike),
        "_extra": F.max_by("_more", F.when(method == METHODS[1], F.col("seq"))).over(alike),
    }).filter(method == METHODS[2]).drop("method", "_request", "_more")
    if pages is not None:
        joined = joined.join(pages.select(*by, "page_url", "page_title"), list(by), "left")
    else:
        joined = joined.withColumns({"page_url": F.lit(None).cast("string"), "page_title": F.lit(None).cast("string")})
    answer = H.lower_keys(F.col("_response.headers"))
    rows = pin(
        joined,
        {
            "url": F.coalesce("_response.url", "_sent.url"),
            "mime_type": F.col("_response.mimeType"),
            "_answer": answer,
            "_headers": H.merge_headers(H.lower_keys(F.col("_sent.headers")), H.lower_keys(F.col("_extra.headers"))),
        },
    ).filter(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    length = X.asset_length(
        F.try_element_at("_answer", F.lit("content-range")), F.try_element_at("_answer", F.lit("content-length"))
    )
    rows = pin(rows, {"context": H.request_context(F.col("_headers"), F.col("page_url")), "content_length": length})
    return rows.select(
        *key, "seq", "ts", "page_url", "page_title", "url", "mime_type", "resource_type", "content_length",
        F.col("context.cookie").alias("cookie"), F.to_json("context").alias("request"),
    )


def refresh_requests(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """Give candidates the best identity of later observations of their key: with a cookie, then the latest.

    ``identities`` has ``url, ts, seq, cookie, request``.
    """
    has_cookie = F.coalesce(F.col("cookie"), F.lit("")) != ""
    best = identities.withColumn("candidate_key", U.candidate_key("url")).groupBy("candidate_key").agg(
        F.max_by(F.struct("cookie", "request"), F.struct(has_cookie, "ts", "seq")).alias("_new")
    )
    joined = candidates.join(best, "candidate_key", "left")
    had = F.coalesce(F.col("cookie"), F.lit("")) != ""
    better = F.col("_new").isNotNull() & ((F.coalesce(F.col("_new.cookie"), F.lit("")) != "") | ~had)
    return joined.withColumns(
        {
            "cookie": F.when(better, F.col("_new.cookie")).otherwise(F.col("cookie")),
            "request": F.when(better, F.col("_new.request")).otherwise(F.col("request")),
        }
    ).drop("_new")


def _reports(df: DataFrame) -> DataFrame:
    rows = pin(df, {"r": F.from_json("payload", DOM_SCHEMA)})
    return rows.filter((F.col("r.kind") == "media-element") & ~X.is_blank(F.col("r.src")))


def read_dom_reports(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``page_id, seq, payload`` to (media elements, blob players). Elements without http(s) drop out."""
    rows = _reports(df)
    is_blob = F.lower("r.src").startswith("blob:")
    blobs = rows.filter(is_blob).select("page_id", "seq", F.col("r.src").alias("blob_url"), F.col("r.page").alias("page_url"))
    elements = rows.filter(~is_blob & U.is_web_url("r.src")).select(
        "page_id", "seq", F.col("r.src").alias("url"), F.col("r.tag").alias("tag"), F.col("r.duration").alias("duration"),
        F.col("r.width").alias("width"), F.col("r.height").alias("height"), F.col("r.poster").alias("poster"),
        F.col("r.title").alias("page_title"), F.col("r.page").alias("page_url"),
    )
    return elements, blobs


_OPEN_TAG = r"""(?i)<(?:video|audio|source)\b(?:[^>"']|"[^"]*"|'[^']*')*>|</(?:video|audio)>"""


def html_media_elements(pages: DataFrame) -> DataFrame:
    """S3: ``page_id, url, html`` to media elements, each address once per page at its first place.

    A ``source`` counts inside a ``video`` or ``audio`` element only.
    """
    bare = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = F.regexp_extract_all(bare, F.lit(_OPEN_TAG), F.lit(0))
    named = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, r"^</?(\w+)", 1)).alias("tag"), t.startswith("</").alias("closing"), t.alias("text")))
    found = pin(pages.filter(F.col("html").rlike(r"(?i)<(?:video|audio)\b")), {"_tags": named})
    # The depth at a tag is a running sum over the tags of its page; rows that repeat a page add to it alike.
    before = Window.partitionBy("page_id", "_html").orderBy("position")
    step = F.when(F.col("t.tag") == "source", 0).when(F.col("t.closing"), -1).otherwise(1)
    rows = found.select("page_id", "url", F.xxhash64("html").alias("_html"), F.posexplode("_tags").alias("position", "t"))
    rows = rows.withColumn("_depth", F.sum(step).over(before))
    rows = rows.filter(~F.col("t.closing")).filter((F.col("t.tag") != "source") | (F.col("_depth") > 0))
    src: Column = F.regexp_extract("t.text", r"""(?i)\ssrc\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s>"']+)""", 1)
    other = F.regexp_extract("t.text", r"""(?i)\ssrc\s*=\s*'?([^\s>"']+)""", 1)
    decoded = F.regexp_replace(F.coalesce(F.nullif(src, F.lit("")), other), "&amp;", "&")
    rows = rows.select("page_id", "url", "position", F.col("t.tag").alias("tag"), decoded.alias("_src"))
    rows = rows.select("page_id", F.col("url").alias("page_url"), "position", "tag", U.resolve_url("_src", "url").alias("src"))
    return first_per(rows.filter(F.col("src").isNotNull()), ["page_id", "src"], ["position"])


def blob_only_pages(blobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages whose player plays from a blob and that gave no candidate at all."""
    pages = blobs.groupBy("page_url").agg(F.count("*").alias("blob_players"))
    return pages.join(candidates.select("page_url"), "page_url", "left_anti")
