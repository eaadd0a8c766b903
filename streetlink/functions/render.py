"""Canonical text of a parsed address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import KINDS, OPAQUE_KIND, VIA_TYPES, alternation
from .text import strip_zeros

_TYPES = alternation(VIA_TYPES)
#: a letter run that is a via type and stands right before digits
_READS_AS_STREET = rf"(?<![A-Z])(?:{_TYPES})(?=[0-9])"


def render_segment(p: Column, side: str) -> Column:
    f = lambda name: p[f"{side}_{name}"]
    return F.concat_ws(" ", f("type"), f("number"), f("letters"), f("suffix"), F.when(f("suffix").isNotNull(), f("suffix_letters")), F.when(f("bis"), "BIS"), f("quadrant"))


def render_plate(plate: Column) -> Column:
    """At least two digits and the letter as it was."""
    digits = strip_zeros(F.regexp_extract(plate, "^([0-9]+)", 1))
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.when(plate.isNotNull(), F.concat(padded, F.regexp_extract(plate, "([A-Z]?)$", 1)))


def render_value(value: Column) -> Column:
    """A complement value as tokens that parse to the same value again."""

    def part(v: Column) -> Column:
        apart = F.regexp_replace(v, "(?<=[0-9])(?=[A-Z])|(?<=[A-Z])(?=[0-9])", " ")
        return F.when(v.rlike(_READS_AS_STREET), F.regexp_replace(apart, rf"(?<![^ ])({_TYPES}) (?=[0-9])", "$1 - ")).otherwise(v)

    return F.array_join(F.transform(F.split(value, "/"), part), " ")


def render_complement(chunks: Column) -> Column:
    """Chunks of unknown kind first: only there does the grammar read them again."""
    known = list(dict.fromkeys(KINDS))
    ordered = F.concat(F.filter(chunks, lambda c: ~c["kind"].isin(known)), F.filter(chunks, lambda c: c["kind"].isin(known)))
    texts = F.transform(ordered, lambda c: F.trim(F.concat_ws(" ", F.when(c["kind"] != OPAQUE_KIND, c["kind"]), render_value(c["value"]))))
    return F.when(F.size(chunks) > 0, F.array_join(texts, " "))


def render(p: Column) -> Column:
    """The canonical form; of an address that does not parse, its own text."""
    has_tail = F.size(p["complement"]) > 0
    text = F.concat_ws(
        " ",
        render_segment(p, "via"),
        F.lit("#"),
        F.when(p["cross_number"].isNotNull(), render_segment(p, "cross")),
        F.when(p["plate"].isNotNull() | has_tail, "-"),
        render_plate(p["plate"]),
        render_complement(p["complement"]),
    )
    return F.when(p["parse_ok"], text).otherwise(p["raw"])


def show_complement(chunks: Column) -> Column:
    """Chunks as ``KIND VALUE, KIND VALUE``; null if there are none."""
    one = lambda c: F.when(c["kind"] == OPAQUE_KIND, c["value"]).otherwise(F.trim(F.concat(c["kind"], F.lit(" "), c["value"])))
    return F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, one), ", "))
