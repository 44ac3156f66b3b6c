"""Request identity out of captured headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .binding import let

# Headers a replay must not carry, and the agent used when none was captured.
NOT_REPLAYED = (
    "host", "connection", "keep-alive", "content-length", "transfer-encoding", "te", "trailer",
    "upgrade", "accept-encoding", "range", "if-range", "if-none-match", "if-modified-since",
    "if-match", "if-unmodified-since", "cache-control", "pragma", "upgrade-insecure-requests",
    "x-client-data", "proxy-connection",
)
DEFAULT_USER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/131.0.0.0 Safari/537.36"
)
_OWN_FIELDS = ("user-agent", "referer", "origin", "cookie")


def lower_keys(headers: Column) -> Column:
    """Header map with trimmed lower-case names and without empty values; of equal names the last wins."""

    def distinct(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e["key"])
        return F.map_from_entries(
            F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
        )

    entries = F.transform(
        F.filter(F.map_entries(headers), lambda e: e["value"] != ""),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")),
    )
    return let(entries, distinct)


def merge_headers(base: Column, override: Column) -> Column:
    """Two maps with lower-case names; the second wins."""
    empty = F.create_map().cast("map<string,string>")
    return let(
        F.coalesce(override, empty),
        lambda extra: F.map_concat(
            F.map_filter(F.coalesce(base, empty), lambda k, v: ~F.map_contains_key(extra, k)), extra
        ),
    )


def request_context(headers: Column, page_url: Column) -> Column:
    """Struct of user agent, referer, origin, cookie and the other replayable headers.

    Referer and origin fall back to the page. ``headers`` has lower-case names.
    """
    extra = F.map_filter(
        headers, lambda k, v: ~k.startswith(":") & ~k.isin(*NOT_REPLAYED, *_OWN_FIELDS)
    )
    get = lambda name: F.try_element_at(headers, F.lit(name))
    return F.struct(
        F.coalesce(get("user-agent"), F.lit(DEFAULT_USER_AGENT)).alias("user_agent"),
        F.coalesce(get("referer"), urls.normalize_url(page_url)).alias("referer"),
        F.coalesce(get("origin"), urls.url_origin(page_url)).alias("origin"),
        get("cookie").alias("cookie"),
        extra.alias("extra"),
    )


def is_authenticating(name: Column) -> Column:
    """Headers that authenticate: ``authorization`` and any ``x-`` but one."""
    lowered = F.lower(name)
    return (lowered == "authorization") | (lowered.startswith("x-") & (lowered != "x-client-data"))


def authenticating_headers(extra: Column) -> Column:
    return F.map_filter(extra, lambda k, v: is_authenticating(k))
