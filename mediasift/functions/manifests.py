"""Manifest text helpers: lines, attribute lists, tags, byte ranges, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import to_long

# One ``key=value`` of a comma-separated list; commas inside quotes do not count.
_ATTRIBUTE = r"([^=,\"\s][^=,\"]*?)\s*=\s*(\"[^\"]*\"?|[^,]*)"


def strip_bom(text: Column) -> Column:
    return F.when(text.startswith("\ufeff"), F.substr(text, F.lit(2))).otherwise(text)


def trimmed_text(text: Column) -> Column:
    """The text with every line trimmed and empty lines removed."""
    return F.btrim(F.regexp_replace(text, r"\s*[\r\n]\s*", "\n"), F.lit(" \t\n\x0b\f\r"))


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not empty, in order."""
    return F.split(trimmed_text(text), "\n")


def last_tag(block: Column, tag: str, body: str = r"[^\n]*") -> Column:
    """The last ``tag:`` line of a block of lines with its tag; '' when there is none. ``body`` is a pattern that it must fit."""
    if body == r"[^\n]*":
        # Nothing to fit: cut at the tag and at the end of its line, which takes no pattern.
        led, begin = F.concat(F.lit("\n"), block), f"\n{tag}:"
        value = F.substring_index(F.substring_index(led, begin, -1), "\n", 1)
        return F.when(block.contains(f"{tag}:") & led.contains(begin), F.concat(F.lit(f"{tag}:"), value)).otherwise("")
    found = F.regexp_extract(block, rf"(?s)^(?:.*\n)?({tag}:{body})", 1)
    return F.when(block.contains(f"{tag}:"), found).otherwise("")


def tag_value(line: Column, tag: str) -> Column:
    """Text after the tag; NULL when the line is ''."""
    return F.when(line != "", F.substr(line, F.lit(len(tag) + 2)))


def attributes(text: Column) -> Column:
    """Attribute list to two arrays, last attribute first, keys in upper case."""
    return F.struct(
        F.reverse(F.regexp_extract_all(F.upper(text), F.lit(_ATTRIBUTE), F.lit(1))).alias("keys"),
        F.reverse(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(2))).alias("values"),
    )


def attr_map(text: Column) -> Column:
    """Attribute list to a map with upper-case keys; the last value of a key wins."""

    def first_of_each(pairs: Column) -> Column:
        keys = pairs["keys"]
        return F.map_from_entries(
            F.transform(
                F.array_distinct(keys),
                lambda key: F.struct(
                    key, _unquoted(F.get(pairs["values"], (F.array_position(keys, key) - 1).cast("int")))
                ),
            )
        )

    return let(attributes(text), first_of_each)


def _unquoted(value: Column) -> Column:
    return F.btrim(value, F.lit(' \t\n\x0b\f\r"'))


def attr(pairs: Column, key: str) -> Column:
    """Value of an attribute; an empty one counts as absent."""
    position = (F.array_position(pairs["keys"], key) - 1).cast("int")
    value = F.get(pairs["values"], position)
    return F.when(value.rlike(r'[^ \t\n\x0b\f\r"]'), _unquoted(value))


def attr_yes(pairs: Column, key: str) -> Column:
    return F.coalesce(F.upper(attr(pairs, key)) == "YES", F.lit(False))


def byte_range(text: Column) -> Column:
    """``length[@offset]`` to a struct."""
    trimmed = F.btrim(F.trim(text), F.lit('"'))
    plain = F.struct(
        F.substring_index(text, "@", 1).cast("bigint").alias("length"),
        F.when(text.contains("@"), F.substring_index(text, "@", -1)).cast("bigint").alias("offset"),
    )
    spelled = F.struct(
        to_long(F.regexp_extract(trimmed, "^([^@]*)", 1)).alias("length"),
        to_long(F.regexp_extract(trimmed, "^[^@]*@(.*)$", 1)).alias("offset"),
    )
    return F.when(text.rlike(r"^[0-9]{1,18}(?:@[0-9]{1,18})?\z"), plain).otherwise(spelled)


def sequence_iv(sequence: Column) -> Column:
    """A media sequence number as a 128-bit big-endian initialisation vector."""
    return F.unhex(F.lpad(F.hex(sequence), 32, "0"))


_PRINTF = r"^%+(0?)([0-9]+)([duxXo])$"


def _formatted(value: Column, spec: Column) -> Column:
    number = F.coalesce(value, F.lit(0)).cast("bigint")
    plain = number.cast("string")
    kind = F.regexp_extract(spec, _PRINTF, 3)
    width = F.regexp_extract(spec, _PRINTF, 2).try_cast("int")
    fill = F.when(F.regexp_extract(spec, _PRINTF, 1) == "0", F.lit("0")).otherwise(F.lit(" "))
    digits = (
        F.when(kind == "x", F.lower(F.hex(number)))
        .when(kind == "X", F.hex(number))
        .when(kind == "o", F.conv(plain, 10, 8))
        .otherwise(plain)
    )
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, fill))
    return F.when(spec.rlike(_PRINTF), padded).otherwise(plain)


def expand_template(
    template: Column, rep_id: Column, bandwidth: Column, number: Column, time: Column
) -> Column:
    """Fill ``$Number%05d$`` and its kin.

    Between dollar signs every second piece is a token. An empty token is an
    escaped dollar; an unknown one stays visible; an unclosed one is text.
    """

    def filled(pieces: Column) -> Column:
        closed = F.size(pieces) - F.when(F.size(pieces) % 2 == 0, 1).otherwise(0)

        def piece(token: Column, i: Column) -> Column:
            name = F.lower(F.regexp_extract(token, "^([^%]*)", 1))
            spec = F.regexp_extract(token, "^[^%]*(%.*)?$", 1)
            value = (
                F.when(token == "", F.lit("$"))
                .when(name == "representationid", rep_id)
                .when(name == "bandwidth", _formatted(bandwidth, spec))
                .when(name.isin("number", "subnumber"), _formatted(number, spec))
                .when(name == "time", _formatted(time, spec))
                .otherwise(F.concat(F.lit("$"), token, F.lit("$")))
            )
            return (
                F.when(i >= closed, F.concat(F.lit("$"), token)).when(i % 2 == 1, value).otherwise(token)
            )

        return F.array_join(F.transform(pieces, piece), "")

    expanded = let(F.split(template, r"\$", -1), filled)
    # Often the id of the representation is all there is to fill in; that needs no lambda.
    by_id = F.concat(F.substring_index(template, "$", 1), F.coalesce(rep_id, F.lit("")), F.substring_index(template, "$", -1))
    only_id = template.rlike(r"(?i)^[^$]*\$RepresentationID\$[^$]*\z")
    return F.when(~template.contains("$"), template).when(only_id, by_id).otherwise(expanded)


_FIXED = r"((?:[^$]|\$\$|\$(?:RepresentationID|Bandwidth)\$)*+)"
# One number or time, plain or padded with zeros; everything else is the same for all segments of a representation.
_ONE_COUNTER = rf"(?i)^{_FIXED}\$(Number|Time)(?:%0([0-9]{{1,2}})d)?\${_FIXED}$"


def one_counter(template: Column, rep_id: Column, bandwidth: Column) -> Column:
    """A template in which one token changes: what stands before and after it, whether it is the time, and its width.

    NULL for every other template; those take ``expand_template`` for each segment.
    """
    no_count = F.lit(None).cast("bigint")
    group = lambda i: F.regexp_extract(template, _ONE_COUNTER, i)
    parts = F.struct(
        expand_template(group(1), rep_id, bandwidth, no_count, no_count).alias("head"),
        expand_template(group(4), rep_id, bandwidth, no_count, no_count).alias("tail"),
        (F.lower(group(2)) == "time").alias("by_time"),
        F.coalesce(group(3).try_cast("int"), F.lit(0)).alias("width"),
    )
    return F.when(template.rlike(_ONE_COUNTER), parts)


def counted(number: Column, width: Column) -> Column:
    """What a counter token of that width becomes."""
    digits = F.coalesce(number, F.lit(0)).cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
