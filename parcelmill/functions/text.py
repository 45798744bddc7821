"""Text functions as column expressions (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detect(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def replace_first(x: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; ``regexp_replace`` alone replaces every match."""
    return F.regexp_replace(x, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def remove_first(x: Column, pattern: str) -> Column:
    return replace_first(x, pattern, "")


def replace_all(x: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(x, pattern, replacement)


def remove_all(x: Column, pattern: str) -> Column:
    return F.regexp_replace(x, pattern, "")


def trim_ends(x: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def squish(x: Column) -> Column:
    """Trim and collapse inner white space to one blank."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def title_case(x: Column) -> Column:
    """Capitalise each word; a hyphen or slash starts a new word, an apostrophe does not."""
    marked = F.regexp_replace(F.lower(x), r"([^\p{L}\p{N}'._\s])(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def join_text(*parts: Column, sep: str = "") -> Column:
    """Concatenate; missing if any part is missing."""
    pieces: list[Column] = []
    for position, part in enumerate(parts):
        if position and sep:
            pieces.append(F.lit(sep))
        pieces.append(part)
    return F.concat(*pieces)


def comma(x: Column, digits: int = 0) -> Column:
    """Thousands separators, half rounded up."""
    return F.format_number(F.round(x, digits), digits)


def dollar(x: Column, digits: int = 0) -> Column:
    sign = F.when(x < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, comma(F.abs(x), digits))


def parcel_key(x: Column) -> Column:
    """Identifier without dashes and white space."""
    return F.regexp_replace(x, r"[-\s]", "")


def readable_term(x: Column, prefix: str) -> Column:
    """Level name behind a coefficient name such as ``geo_id_Moon.Area``."""
    bare = remove_first(x, f"^{prefix}_")
    return squish(remove_first(replace_all(bare, r"\.", " "), "^X"))
