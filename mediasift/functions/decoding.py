"""Texts and host names that built-in functions cannot decode, in Arrow batches.

Built-in functions do what they can; the Arrow functions see NULL for all other rows, so only the bytes and names that
need them are sent to Python. They stay apart from expressions that Spark could fold, as a Python function runs for every
row of its projection.
"""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .manifests import strip_bom

UTF_8 = ("utf-8", "utf8")


@arrow_udf(StringType())
def _decoded(content: pa.Array, charset: pa.Array) -> pa.Array:
    """Bytes by the named charset, U+FFFD for what it cannot decode; a charset nobody knows is taken for UTF-8."""
    known: dict[str, str] = {}
    out = []
    for data, name in zip(content.to_pylist(), charset.to_pylist()):
        if data is None:
            out.append(None)
            continue
        if name not in known:
            try:
                # Only charsets of text: the registry also has codecs between bytes.
                known[name] = name if codecs.lookup(name)._is_text_encoding else "utf-8"
            except (LookupError, ValueError, TypeError):
                known[name] = "utf-8"
        # Half of a surrogate pair may come out of UTF-7 and its like; Arrow cannot hold one.
        out.append(data.decode(known[name], "replace").encode("utf-8", "replace").decode("utf-8"))
    return pa.array(out, pa.string())


@arrow_udf(StringType())
def _ascii_host(host: pa.Array) -> pa.Array:
    def encoded(name: str) -> str:
        try:
            return name.encode("idna").decode("ascii")
        except UnicodeError:  # no valid name: left as it is
            return name

    return pa.array([None if h is None else encoded(h) for h in host.to_pylist()], pa.string())


def decode_text(df: DataFrame, content: str, charset: str, name: str) -> DataFrame:
    """``df`` with the text ``name`` of its bytes, by the declared charset, without a byte order mark.

    The charset may stand in quotes and in any case; NULL, blank and unknown ones are UTF-8. UTF-8 and Latin-1 are decoded
    by Spark, others in Arrow batches. Bytes that do not decode become U+FFFD: no text ends the job.
    """
    declared = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(charset), F.lit("")), r"^[\s\"']+|[\s\"']+$", "")))
    plain = declared.isin("", *UTF_8)
    latin = declared.isin("iso-8859-1", "latin1", "latin-1")
    others = df.withColumn(name, _decoded(F.when(~plain & ~latin, F.col(content)), F.when(~plain & ~latin, declared)))
    text = F.when(plain, F.make_valid_utf8(F.col(content).cast("string"))).when(latin, F.decode(content, "ISO-8859-1")).otherwise(F.col(name))
    return others.withColumn(name, strip_bom(text))


def with_ascii_host(df: DataFrame, host: str, name: str) -> DataFrame:
    """``df`` with the host as it goes over the wire: international names in their ASCII form, others as they are."""
    foreign = F.col(host).rlike(r"[^\x00-\x7F]")
    return df.withColumn(name, _ascii_host(F.when(foreign, F.col(host)))).withColumn(name, F.when(foreign, F.col(name)).otherwise(F.col(host)))
