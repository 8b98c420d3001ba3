"""Hash keys, change hashes and repeatable draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_KEY = "N/A"
KEY_SEPARATOR = "|"
DIGEST_HEX_LENGTH = {"sha256": 64, "md5": 32}


def digest(text: Column, algo: str = "sha256") -> Column:
    if algo == "sha256":
        return F.sha2(text, 256)
    if algo == "md5":
        return F.md5(text)
    raise ValueError(f"unknown hash '{algo}', choose from {sorted(DIGEST_HEX_LENGTH)}")


def _escaped(text: Column) -> Column:
    r"""Text in which the separator and the backslash are marked, so joined parts cannot run together."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit(KEY_SEPARATOR), F.lit("\\" + KEY_SEPARATOR))


def key_text(*parts: Column) -> Column:
    r"""Upper-cased, trimmed key text; a NULL part becomes N/A, so it keeps its place.

    Separators inside a part are escaped, and a part that reads N/A itself becomes \N/A: different keys
    have different texts. Keys without such characters read as they are.
    """

    def clean(part: Column) -> Column:
        text = _escaped(F.upper(F.trim(part.cast("string"))))
        return F.coalesce(F.when(text == NULL_KEY, F.lit("\\" + NULL_KEY)).otherwise(text), F.lit(NULL_KEY))

    return F.concat_ws(KEY_SEPARATOR, *[clean(p) for p in parts])


def hash_key(*parts: Column, algo: str = "sha256", binary: bool = False) -> Column:
    key = digest(key_text(*parts), algo)
    return F.unhex(key) if binary else key


def zero_key(algo: str = "sha256", binary: bool = False) -> Column:
    """The ghost record's key."""
    zeros = F.lit("0" * DIGEST_HEX_LENGTH[algo])
    return F.unhex(zeros) if binary else zeros


def diff_text(*parts: Column) -> Column:
    r"""Attribute text for change detection: case and blanks count, NULL is \N, separators are escaped."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(_escaped(p.cast("string")), F.lit("\\N")) for p in parts])


def hash_diff(*parts: Column, algo: str = "sha256") -> Column:
    return digest(diff_text(*parts), algo)


DRAW_RANGE = 2**32


def draw(seed: int, table: str, column: str, row_id: Column, salt: int = 0) -> Column:
    """A whole number in [0, 2^32) fixed by its arguments, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(f"{seed}:{table}:{column}:{salt}"), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def pick(values: list, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def between_int(low: int, high: int, number: Column) -> Column:
    return number % (high - low + 1) + low


def between_scaled(low: int, high: int, places: int, number: Column) -> Column:
    """A decimal step in [low, high] with the given places, as a double."""
    unit = 10**places
    return (number % ((high - low) * unit + 1) + low * unit).cast("double") / F.lit(float(unit))
