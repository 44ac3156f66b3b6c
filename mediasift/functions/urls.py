"""URL building blocks (X1-X5, X7) as Catalyst expressions.

``parse_url`` raises on odd input under ANSI, ``try_parse_url`` rejects
characters browsers accept, and neither lower-cases the host, so the parts are
cut with the RFC 3986 component pattern instead. Everything here is a plain
``Column -> Column`` function; the only higher-order functions sit behind a
guard that ordinary URLs never enter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"

# Query parameters that change per request for the same asset.
VOLATILE_PARAMETERS = (
    "range", "rn", "rbuf", "cpn", "ei", "_nc_rid", "bytestart", "byteend",
    "expires", "expire", "token", "hdnts", "signature", "sig", "_",
)

_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"
# An http(s) URL with nothing to change: lower-case host, no port, and no dot segment, which takes a slash and a dot.
_NORMAL = r"^https?://[a-z0-9.\-]+/[!$-;=@-\[\]_a-z~]*+(?:[?#][!#-;=?-\[\]_a-z~]*)?$"
# A reference that only has to be put behind a normal folder, or behind its origin: no scheme, no blanks, nothing to escape or to fold.
_SIMPLE = r"^/?[A-Za-z0-9_][!$-9;=@-Z_a-z~]*+(?:\?[!$-;=?-Z_a-z~]*+)?\z"
_BLANKS = ' \t\n\x0b\f\r"'
_NEEDS_ESCAPE = r"[^\x21-\x7E]|[\"<>\\^`{|}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def url_scheme(url: Column | str) -> Column:
    return _blank_to_null(F.lower(F.regexp_extract(_col(url), rf"^({_SCHEME}):", 1)))


def url_host(url: Column | str) -> Column:
    """Lower-cased host without user info or port; '' when there is none."""
    pattern = rf"^{_SCHEME}://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
    return F.lower(F.regexp_extract(_col(url), pattern, 1))


def url_path(url: Column | str) -> Column:
    """Path of an absolute URL; '/' when it is empty."""
    path = F.regexp_extract(_col(url), rf"^{_SCHEME}://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "^$", "/")


def url_query(url: Column | str) -> Column:
    """Query without the question mark; '' when there is none."""
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def url_origin(url: Column | str) -> Column:
    """``scheme://[user@]host[:port]``, scheme and host in lower case, default ports dropped. A user keeps its case."""
    url = _col(url)
    scheme = F.lower(F.regexp_extract(url, rf"^{_SCHEME}://", 0))
    user = F.regexp_extract(url, rf"^{_SCHEME}://([^/?#]*@)", 1)
    head = F.concat(scheme, user, F.lower(F.regexp_extract(url, rf"^{_SCHEME}://(?:[^/?#]*@)?([^/?#]*)", 1)))
    return F.regexp_replace(head, "^(http://.*):80$|^(https://.*):443$", "$1$2")


def url_without_query(url: Column | str) -> Column:
    return F.concat(url_origin(url), url_path(url))


def fold_dot_segments(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments. Paths without them are returned as they are."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, segment: Column) -> Column:
        parent = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return (
            F.when(segment == ".", acc)
            .when(segment == "..", F.when(F.size(acc) > 0, parent).otherwise(acc))
            .otherwise(F.array_append(acc, segment))
        )

    folded = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    ends_in_dots = path.rlike(r"(^|/)\.\.?$")
    folded = F.when(ends_in_dots & ~folded.endswith("/"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(_DOT_SEGMENT), folded).otherwise(path)


def escape_url(url: Column) -> Column:
    """Percent-encode characters that may not stand in a URL (blank, quotes, non-ASCII)."""
    escaped = F.array_join(
        F.transform(
            F.split(url, ""),
            lambda ch: F.when(
                ch.rlike(f"^(?:{_NEEDS_ESCAPE})$"),
                F.regexp_replace(F.url_encode(ch), r"\+", "%20"),
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(url.rlike(_NEEDS_ESCAPE), escaped).otherwise(url)


def is_normal(url: Column) -> Column:
    """An http(s) URL that ``normalize_url`` returns as it is."""
    return ~url.contains("/.") & url.rlike(_NORMAL)


def is_folder(url: Column) -> Column:
    """A normal http(s) URL that ends in a slash, without query or fragment."""
    return url.rlike(r"^https?://[a-z0-9.\-]+/(?:[!$-.0-;=@-\[\]_a-z~]++/)*+\z") & ~url.contains("/.")


def normalize_url(url: Column | str) -> Column:
    """Absolute URL with lower-cased origin, folded path and escaped characters.

    Most URLs already are in that form; one pattern lets them through as they are.
    """

    def rebuilt(u: Column) -> Column:
        rest = F.regexp_extract(u, r"^[^?#]*([?#].*)?$", 1)
        absolute = F.concat(url_origin(u), let(url_path(u), fold_dot_segments), rest)
        return let(F.when(u.rlike(rf"^{_SCHEME}://"), absolute).otherwise(u), escape_url)

    return let(_col(url), lambda u: F.when(is_normal(u), u).otherwise(rebuilt(u)))


def base_parts(base: Column | str) -> Column:
    """What most references take from their base, for a base that many of them share: its origin, its directory, and whether
    that is a normal folder."""
    found = F.regexp_extract(_col(base), rf"^{_SCHEME}://[^/?#]*(?:/(?:[^?#]*/)?)?", 0)
    directory = F.when((found == "") | found.endswith("/"), found).otherwise(F.regexp_replace(found, "([^/])$", "$1/"))
    return F.struct(
        F.regexp_extract(_col(base), rf"^{_SCHEME}://[^/?#]*", 0).alias("origin"),
        directory.alias("directory"),
        is_folder(directory).alias("is_folder"),
    )


def resolve_url(reference: Column | str, base: Column | str, parts: Column | str | None = None) -> Column:
    """Resolve a reference against an absolute base (X3). Blank references give NULL.

    ``parts`` are the ``base_parts`` of the base, where they are at hand. A plain name or path behind a normal folder is the
    two texts together; only other references go through the lambdas, which Spark interprets.
    """
    base, given = _col(base), _col(reference)
    parts = base_parts(base) if parts is None else _col(parts)
    document = F.regexp_extract(base, r"^[^?#]*", 0)

    def joined(ref: Column) -> Column:
        return (
            F.when(ref == "", F.lit(None).cast("string"))
            .when(ref.rlike(rf"^{_SCHEME}:"), ref)
            .when(ref.startswith("//"), F.concat(url_scheme(base), F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(parts["origin"], ref))
            .when(ref.startswith("?"), F.concat(document, ref))
            .when(ref.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), ref))
            .otherwise(F.concat(parts["directory"], ref))
        )

    simple = given.rlike(_SIMPLE) & ~given.contains("/.") & parts["is_folder"]
    whole = normalize_url(let(F.btrim(given, F.lit(_BLANKS)), joined))
    before = F.when(given.startswith("/"), parts["origin"]).otherwise(parts["directory"])
    return F.when(simple, F.concat(before, given)).otherwise(whole)


def is_web_url(url: Column | str) -> Column:
    return _col(url).rlike(r"(?i)^https?://[^/?#]")


def url_extension(path: Column) -> Column:
    """Extension with its dot from the last path segment; '' when there is none."""
    return F.regexp_extract(path, r"(\.[^./\\:]+)$", 1)


def extension_from_query(query: Column) -> Column:
    """First query value that ends in a short extension, such as ``file=movie.mp4``."""

    def extension(pair: Column) -> Column:
        raw = F.regexp_extract(pair, r"^[^=]+=(.*)$", 1)
        value = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
        return url_extension(F.regexp_replace(value, r"\?.*$", ""))

    found = F.filter(
        F.transform(F.split(query, "&"), extension),
        lambda ext: (ext != "") & (F.length(ext) <= 6),
    )
    first = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
    return F.when(query.rlike(r"\.|%2[eE]"), first).otherwise(F.lit(""))


def candidate_key(url: Column | str) -> Column:
    """Identity of an asset: normalised, no fragment, no volatile parameters, the rest in order.

    Spellings of one address (dot segments, characters that need escaping) have one key. One regular expression drops
    the volatile pairs and ``sort_array`` orders what is left.
    """
    return let(normalize_url(url), _key_of)


def _key_of(url: Column) -> Column:
    names = "|".join(VOLATILE_PARAMETERS)
    kept = F.regexp_replace(
        F.concat(F.lit("&"), url_query(url)), rf"(?i)&(?:{names})(?:=[^&]*)?(?=&|$)", ""
    )
    stable = F.array_join(F.sort_array(F.split(F.substr(kept, F.lit(2)), "&")), "&")
    # A question mark that nothing follows goes again.
    return F.concat(url_without_query(url), F.regexp_replace(stable, "^(?=.)", "?"))


def family_from_parts(host: Column, path: Column) -> Column:
    return F.concat(host, F.regexp_replace(path, r"(?<=.)/[^/]*$", ""))


def family_key(url: Column | str) -> Column:
    """Host plus parent directory: the packages segments and manifests share."""
    return family_from_parts(url_host(url), url_path(url))


def stable_id(value: Column | str) -> Column:
    """First eight bytes of the SHA-256 of the text, in hex."""
    return F.substring(F.sha2(_col(value), 256), 1, 16)


def normalize_seed(text: Column | str) -> Column:
    """Turn typed text into a URL: URL, bare host, or search address."""
    text = F.trim(_col(text))
    encoded = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    encoded = F.regexp_replace(F.regexp_replace(encoded, r"\*", "%2A"), "%7E", "~")
    bare_host = ~text.contains(" ") & text.contains(".")
    return (
        F.when(text.isNull() | (text == ""), F.lit(None))
        .when(text.rlike(r"(?i)^(?:https?://[^/?#\s]|file:/)"), normalize_url(text))
        .when(bare_host, normalize_url(F.concat(F.lit("https://"), text)))
        .otherwise(F.concat(F.lit("https://www.google.com/search?q="), encoded))
    )
