"""Cleanup of address text, as native column expressions.

Java's \\s knows fewer blanks than the grammar does, so blanks are always given
as the Unicode class with the four separators U+001C to U+001F.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)[\s\x1c-\x1f]"
#: Hangul syllables decompose by arithmetic and cannot stand in an address that parses.
_HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """(from, to, longer): characters whose compatibility form without combining
    marks is one other character or nothing (nothing: beyond the end of ``to``),
    and those for which it is several."""
    single, gone, longer = {}, [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or code in _HANGUL:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            single[c] = plain
        else:
            longer[c] = plain
    return "".join(single) + "".join(gone), "".join(single.values()), longer


def fold(c: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII passes untouched."""
    source, target, longer = _folds()
    table = literal_map(longer)
    one = F.translate(c, source, target)
    some = "[" + "".join(f"\\x{{{ord(k):x}}}" for k in longer) + "]"
    several = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.when(one.rlike(some), several).otherwise(one))


def upper_folded(c: Column) -> Column:
    """Folded, upper case, every dash as ``-`` (the first stage of cleanup)."""
    return F.regexp_replace(F.upper(fold(c)), r"[\x{2010}-\x{2015}\x{2212}]", "-")


_MARKER = r"(?<![^ ])(?:NO|NRO|NUM|N\xb0)\.?(?![^ ])"
_ANY_MARKER = r"(?<![^ ])(?:#|(?:NO|NRO|NUM|N\xb0)\.?)(?![^ ])"


def spaced(folded: Column) -> Column:
    """Separators stand alone and tokens are one blank apart (second stage)."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "([#-])", " $1 "), BLANK + "+", " "))


def tidy(tokens: Column) -> Column:
    """Markers as ``#``, one trailing dot off, glued runs apart, doubled separators once (third stage)."""
    marked = F.regexp_replace(tokens, _MARKER, "#")
    first_word = F.regexp_replace(tokens, r"^(.*?)(?<![^ ])NUMERO\.?(?![^ ])", "$1#")
    c = F.when(tokens.rlike(_ANY_MARKER), marked).otherwise(first_word)
    c = F.regexp_replace(c, r"(?<=[^ ])\.(?![^ ])", "")
    c = F.regexp_replace(F.regexp_replace(c, "([0-9])([A-Z])", "$1 $2"), "([A-Z])([0-9])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(c, "#(?: #)+", "#"), "-(?: -)+", "-")


def clean(c: Column) -> Column:
    """The whole cleanup as one expression."""
    return tidy(spaced(upper_folded(c)))


def is_blank(c: Column) -> Column:
    return c.rlike(r"^" + BLANK + r"*$")


def settled(c: Column) -> Column:
    """The same value, computed where it is written: later filters and projections
    read the result instead of repeating the expression, which grows with each
    stage of the grammar. (The optimizer does not move what depends on the
    partition; the condition always holds.)"""
    return F.when(F.spark_partition_id() >= 0, c)


def unicode_strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def strip_zeros(c: Column) -> Column:
    """Leading zeros off, one digit kept."""
    return F.regexp_replace(c, "^0+(?=[0-9])", "")


def literal_map(table: dict[str, str]) -> Column:
    """A table as one constant, which the optimizer folds; a literal for each entry
    would cost a call to the JVM each whenever a plan is built."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(table), c)


def or_null(c: Column) -> Column:
    """Regular expression groups give empty strings for nothing."""
    return F.nullif(c, F.lit(""))
