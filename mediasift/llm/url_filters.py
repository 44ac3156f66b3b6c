"""URL filters with redirect equivalence.

A rule (host, path prefix) judges the URLs it fits; the longest fitting rule wins. URLs that no rule fits take the
decision of their aliases: pages that redirect to each other or name each other as canonical form one component, and a
decision reaches all of it. An explicit allow inside a component outranks any block there.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import resolve_url
from .components import connected_components

# Query parameters that name a visit and not a page (fixed values).
VISIT_PARAMETERS = "utm_[a-z]+|ref|gclid|fbclid|sessionid"

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?\s*([^"'\s>]+)"""
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def page_key(url: Column) -> Column:
    """One name for the spellings of a page: no scheme, fragment, visit parameter, closing slash or default port."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^({VISIT_PARAMETERS})(=|$)")))
    host = F.regexp_replace(url_host(url), r":(80|443)$", "")
    key = F.concat(host, F.regexp_replace(url_path(url), r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(url_host(url) == "", F.concat(F.lit(":"), F.coalesce(url, F.lit("")))).otherwise(key)


def page_links(pages: DataFrame, url_column: str = "url", html_column: str = "html", relative: bool = True) -> DataFrame:
    """``source, target`` URLs of canonical links and refresh redirects that the pages themselves state.

    Addresses are resolved against the page, those that start with neither a scheme nor a slash unless ``relative`` is false.
    Where resolving escapes or folds an address, it is a target as stated as well: pages are named as they are spelled.
    """
    url, html = F.col(url_column), F.coalesce(F.col(html_column), F.lit(""))
    found = pages.select(url.alias("source"), F.explode(F.array(F.regexp_extract(html, CANONICAL, 1), F.regexp_extract(html, REFRESH, 1))).alias("to")).where("to != ''")
    to = F.regexp_replace(F.col("to"), "&amp;", "&")
    source = F.col("source")
    origin = F.regexp_extract(source, rf"^{SCHEME}://[^/?#]*", 0)
    directory = F.regexp_replace(F.regexp_extract(source, rf"^{SCHEME}://[^/?#]*(?:/(?:[^?#]*/)?)?", 0), "([^/])$", "$1/")
    stated = (
        F.when(to.rlike(f"^{SCHEME}:"), to).when(to.startswith("//"), F.concat(F.regexp_extract(source, f"^{SCHEME}:", 0), to))
        .when(to.rlike(r"^[?#]|(^|/)\.\.?([/?#]|$)"), F.lit(None)).when(to.startswith("/"), F.concat(origin, to)).otherwise(F.concat(directory, to))
    )
    if not relative:
        found = found.where(to.rlike(f"^({SCHEME}:|/)"))
    targets = found.select("source", F.explode(F.array_distinct(F.array(resolve_url(to, source), stated))).alias("target"))
    return targets.where("source IS NOT NULL").where(F.col("target").rlike(f"^{SCHEME}://"))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, decision``: the longest rule that fits each distinct (host, path) that any rule fits.

    A URL asks for its host and every parent domain, each with every path length that rules of that host have; it meets rules by
    equality, so rules and URLs may both be large. Equal lengths: an allow goes first, then the rule's text.
    """
    lengths = rules.groupBy(F.col("host").alias("_domain")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "decision").distinct()
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.concat("_domain", F.substring(F.col("path"), F.lit(1), n)))
    asked = urls.select("host", "path").where("host != ''").distinct().select("host", "path", F.explode(domains).alias("_domain"))
    asked = asked.join(lengths, "_domain").select("host", "path", F.explode(heads).alias("rule"))
    best = F.max_by(F.struct("rule", "decision"), F.struct(F.length("rule"), F.col("decision") == "allow", "rule"))
    return asked.join(rules, "rule").groupBy("host", "path").agg(best.alias("_best")).select("host", "path", "_best.rule", "_best.decision")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, component``.

    ``rules``: ``host, path, decision`` (allow or block). ``links``: ``source, target`` URLs that stand for the same
    page; links with an end that is null or has no host are ignored. Without an own rule a URL takes its component's decision, allow before block, else ``default``. URLs that are
    null or have no host fit no rule, and only equal ones are aliases. Repeated rows get the same answer; an empty
    table gives none. Other columns are not read.
    """
    links = links.where((url_host(F.col("source")) != "") & (url_host(F.col("target")) != ""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "key": page_key(F.col("url"))})
    ruled = rows.join(fitting_rules(rows, rules), ["host", "path"], "left")
    nodes = connected_components(links.select(page_key(F.col("source")).alias("a"), page_key(F.col("target")).alias("b")))
    placed = ruled.join(nodes, ruled["key"] == nodes["node"], "left").withColumn("component", F.coalesce("component", "key"))
    # A link may lead to an address that is no page here but that a rule fits.
    ends = links.select(F.explode(F.array("source", "target")).alias("url")).distinct().withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "key": page_key(F.col("url"))})
    ends = ends.join(fitting_rules(ends, rules), ["host", "path"]).join(nodes, F.col("key") == F.col("node")).select("component", "decision")
    decided = placed.where("decision IS NOT NULL").select("component", "decision").unionAll(ends)
    reached = decided.groupBy("component").agg(F.min("decision").alias("reached"))  # 'allow' < 'block'
    return placed.join(reached, "component", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decision", "reached", F.lit(default)).alias("verdict"), "component"
    )
