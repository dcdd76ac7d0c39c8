"""Text helpers whose Spark built-in differs in detail from what the feed rules need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a value is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Fixed value: a word is a run of Latin letters, accented ones included, and digits.
WORD_PATTERN = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"

_NUMBER_PREFIX = (
    rf"^[{WHITESPACE}]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"
)


def as_column(c: Column | str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use the value of an expression many times but compute it once per row.

    An expression captured by a lambda would run again for every element, and nested
    uses multiply the size of the tree; a lambda variable does neither.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def trim_ws(c: Column | str) -> Column:
    """Trim every kind of white space; the built-in ``trim`` only takes spaces."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def extract_or_null(c: Column | str, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL, not an empty text, when nothing matches."""
    c = as_column(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units, the unit in which the feed limits are set."""
    return (F.octet_length(F.encode(as_column(c), "UTF-16BE")) / 2).cast("int")


def parse_number(c: Column | str) -> Column:
    """The number a text starts with, NaN when it starts with none."""
    found = F.regexp_extract(as_column(c), _NUMBER_PREFIX, 1)
    return F.coalesce(found.try_cast("double"), F.lit(float("nan")))


def show_number(c: Column | str) -> Column:
    """A double as plain text: no exponent, no trailing ``.0``."""
    c = as_column(c)
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    odd = (F.abs(c) < 1e-3) | (F.abs(c) >= 1e7)
    return (
        F.when(F.isnan(c), F.lit("NaN"))
        .when(whole, c.cast("bigint").cast("string"))
        .when(odd & (F.abs(c) < 1e19), plain)
        .otherwise(c.cast("string"))
    )


def words(c: Column | str) -> Column:
    """All words of a text, in order, in their own case."""
    return F.regexp_extract_all(as_column(c), F.lit(WORD_PATTERN), F.lit(0))


def lower_each(arr: Column) -> Column:
    return F.transform(arr, F.lower)


def tokens(c: Column | str, separator: str) -> Column:
    """Cut a list written in one text. Empty parts go **before** the trim, so a part of
    blanks stays as an empty token and keeps the later ones in their places."""
    parts = F.split(trim_ws(c), separator, -1)
    return F.transform(F.filter(parts, lambda p: p != ""), trim_ws)


def bracketed(names: Column) -> Column:
    """``<a> <b>`` for the non-empty names."""
    kept = F.filter(names, lambda n: n != "")
    return F.array_join(F.transform(kept, lambda n: F.concat(F.lit("<"), n, F.lit(">"))), " ")


def base_name(c: Column | str) -> Column:
    """Last path segment of a URI, NULL without one."""
    return extract_or_null(c, r".*/([^/]+)", 1)


def one_line(c: Column | str) -> Column:
    """Line feeds become spaces, carriage returns go."""
    return F.translate(as_column(c), "\n\r", " ")


def id_part(c: Column | str, parts: int) -> Column:
    """Stable part number of an id, 0 to ``parts - 1``."""
    head = F.conv(F.substring(F.md5(as_column(c).cast("string")), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(parts))


def shuffle_key(c: Column | str, seed: int | str) -> Column:
    """A repeatable random order: the text ranks of this key for one seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(c).cast("string")))
