"""Text expressions: trimming, counting, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and split() treat as white space, as code
# point ranges; as a regular expression; as text.
SPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
SPACE = "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in SPACE_RANGES) + "]"
SPACE_CHARS = "".join(chr(c) for low, high in SPACE_RANGES for c in range(low, high + 1))
CHARS_PER_TOKEN = 4


def strip(c: Column) -> Column:
    """Drop white space at both ends, new lines included (plain trim() takes blanks only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def occurrences(lowered: Column, word: str) -> Column:
    """Non-overlapping occurrences of a lower-case word in lower-cased text."""
    rest = F.replace(lowered, F.lit(word), F.lit(""))
    size = len(word.encode())
    return ((F.octet_length(lowered) - F.octet_length(rest)) / F.lit(size)).cast("bigint")


def tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / F.lit(CHARS_PER_TOKEN))).cast("bigint")


def snake_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
