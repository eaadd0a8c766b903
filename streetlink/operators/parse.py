"""Strict parser of address text into a struct column.

The grammar runs in stages, each a projection over the one before, so that an
expression used twice is computed once and everything stays in generated code.
A segment is read by one regular expression whose possessive groups never go
back; its groups come out through one rewrite and one split. An address that the
grammar does not consume whole gets exactly one note and no fields; nothing
raises and nothing is guessed.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, lookup, or_null, settled, spaced, strip_zeros, tidy, upper_folded
from ..vocab import FIELDS, KINDS, MAX_PLATE_DIGITS, MAX_TAIL, OPAQUE_KIND, QUADRANT_LETTERS, QUADRANTS, SEGMENT, TWO_WORD_VIA_TYPES, VIA_TYPES, alternation

_CUT = "\x01"
_TYPE = alternation([*TWO_WORD_VIA_TYPES, *VIA_TYPES])
_QUAD = alternation(QUADRANTS)
_END = "(?= |$)"
_SEGMENT = (
    rf"^(?:({_TYPE}) )?+([0-9]++){_END}(?: ([A-Z]){_END})?+"
    rf"(?: ([0-9]++){_END}(?: (?![NSEOW]$)([A-Z]){_END})?+)?+"
    rf"(?: (BIS){_END})?+(?: ({_QUAD}|[NSEOW]){_END})?+(?: (.*))?$"
)
_KIND = alternation(KINDS)
_ONE = alternation(VIA_TYPES)


def _digit_class() -> str:
    """All characters that count as digits, as ranges of a character class."""
    out, start, before = [], None, None
    for code in range(sys.maxunicode + 1):
        if chr(code).isdigit():
            if start is None:
                start = code
            before = code
        elif start is not None:
            out.append(f"\\x{{{start:x}}}-\\x{{{before:x}}}")
            start = None
    return "[" + "".join(out) + "]"


_DIGIT = _digit_class()
_BAD_DASH = rf"(?:^|(?<![^ ])(?:{_KIND}|-) )-(?![^ ])|(?<![^ ])-(?:$| (?:{_KIND}|-)(?![^ ]))"
_BAD_TOKEN = r"(?<![^ ])(?!-(?![^ ]))([^ ]*[^A-Z0-9 ][^ ]*)"
_MISSING_HASH = rf"^({_ONE}) ([0-9]+) ([0-9]+ - [0-9]+(?: .*)?)$"


def _first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def _segment(groups: str) -> dict[str, Column]:
    g = lambda i: or_null(F.get(F.col(groups), F.lit(i)))
    code = VIA_TYPES | TWO_WORD_VIA_TYPES
    quadrant = g(6)
    return {
        "type": lookup(g(0), code),
        "number": strip_zeros(g(1)),
        "letters": g(2),
        "suffix": strip_zeros(g(3)),
        "suffix_letters": g(4),
        "bis": F.coalesce(g(5) == "BIS", F.lit(False)),
        "quadrant": F.when(F.length(quadrant) == 1, lookup(quadrant, QUADRANT_LETTERS)).otherwise(quadrant),
    }


def _chunks(pieces: Column) -> Column:
    """Sorted (kind, value) chunks of a valid tail."""

    def value(tokens: Column) -> Column:
        v = F.regexp_replace(tokens, r"(?<![^ ])-(?![^ ])", " ")
        v = F.trim(F.regexp_replace(v, " +", " "))
        v = F.regexp_replace(v, r"(?<![^ ])0+(?=[0-9])", "")
        v = F.regexp_replace(F.regexp_replace(v, "([0-9]) (?=[0-9])", "$1/"), "([A-Z]) (?=[A-Z])", "$1/")
        return F.regexp_replace(v, " ", "")

    def chunk(text: Column) -> Column:
        head = _first_token(text)
        digit_led = text.rlike("^[0-9]")
        rest = F.when(digit_led, text).otherwise(F.regexp_replace(text, "^[^ ]+ ?", ""))
        kind = F.when(digit_led, OPAQUE_KIND).otherwise(F.coalesce(lookup(head, KINDS), head))
        return F.struct(kind.alias("kind"), value(rest).alias("value"))

    marked = F.regexp_replace(pieces, rf"(?<![^ ])((?:{_KIND})(?![^ ]))", _CUT + "$1")
    texts = F.filter(F.transform(F.split(marked, _CUT), lambda t: F.trim(t)), lambda t: t != "")
    return F.array_sort(F.transform(texts, chunk))


_NO_CHUNKS = "array<struct<kind:string,value:string>>"


def parse(df: DataFrame, column: str, into: str = "parsed") -> DataFrame:
    """df with a struct column ``into``: raw, parse_ok, notes, the fields of both
    segments, plate, complement, and what later steps need: plate_num,
    plate_letter.

    A null counts as an entry that is not text.
    """
    if df.schema[column].dataType.typeName() not in ("string", "varchar", "char", "void"):
        raise TypeError(f"{column} must hold text, not {df.schema[column].dataType.simpleString()}")
    t = lambda name: f"__{into}_{name}"
    c = lambda name: F.col(t(name))
    own = df.columns

    def stage(df: DataFrame, **cols: Column) -> DataFrame:
        return df.withColumns({t(n): settled(x) for n, x in cols.items()})

    groups = _CUT.join(f"${i}" for i in range(1, 9))
    df = stage(df, raw=F.col(column).cast("string"))
    df = stage(df, folded=spaced(upper_folded(c("raw"))))
    df = stage(df, clean=tidy(c("folded")))
    df = stage(df, hash=F.when(c("clean").contains("#"), c("clean")).when(c("clean").rlike(_MISSING_HASH), F.regexp_replace(c("clean"), _MISSING_HASH, "$1 $2 # $3")))
    df = stage(df, via_text=F.trim(F.substring_index(c("hash"), "#", 1)), rest=F.trim(F.regexp_replace(c("hash"), "^[^#]*#", "")))
    df = stage(
        df,
        cross_text=F.trim(F.substring_index(c("rest"), "-", 1)),
        after=F.when(c("rest").contains("-"), F.trim(F.regexp_replace(c("rest"), "^[^-]*-", ""))).otherwise(""),
    )
    df = stage(
        df,
        via_g=F.split(F.regexp_replace(c("via_text"), _SEGMENT, groups), _CUT),
        cross_g=F.when(c("cross_text") != "", F.split(F.regexp_replace(c("cross_text"), _SEGMENT, groups), _CUT)),
        plate_g=F.regexp_extract(c("after"), r"^([0-9]+(?![^ ])(?: [A-Z](?![^ ]))?)", 1),
    )
    df = stage(df, plate=or_null(F.regexp_replace(c("plate_g"), " ", "")), tail=F.trim(F.substr(c("after"), F.length(c("plate_g")) + 1)))
    df = stage(df, pieces=F.trim(F.regexp_replace(F.regexp_replace(c("tail"), "/+", " "), " +", " ")))

    def segment_note(g: Column) -> Column:
        left = F.get(g, F.lit(7))
        return F.when(F.size(g) < 8, "numero_via_faltante").when(left != "", F.concat(F.lit("token_inesperado:"), _first_token(left)))

    first = _first_token(c("pieces"))
    unexpected = lambda x: F.concat(F.lit("token_inesperado:"), x)
    significant = strip_zeros(F.regexp_extract(c("plate_g"), "^([0-9]+)", 1))
    note = F.coalesce(
        F.when(c("raw").isNull(), "entrada_no_texto"),
        F.when(is_blank(c("raw")), "entrada_vacia"),
        F.when(c("raw").contains(";"), "multiples_direcciones"),
        F.when(c("clean") == "", "entrada_vacia"),
        F.when(c("clean").contains(";"), "multiples_direcciones"),
        F.when(c("hash").isNull(), "falta_separador_hash"),
        segment_note(c("via_g")),
        F.when(c("cross_g").isNotNull(), segment_note(c("cross_g"))),
        F.when(F.length(significant) > MAX_PLATE_DIGITS, "placa_invalida"),
        F.when(c("tail") == "", F.lit(None)).otherwise(F.coalesce(
            F.when(c("tail").contains("#"), "multiples_direcciones"),
            F.when(F.length(c("tail")) > MAX_TAIL, "complemento_demasiado_largo"),
            F.when(c("pieces") == "", F.lit(None)).otherwise(F.coalesce(
                F.when(first.isin(*QUADRANTS), unexpected(first)),
                F.when(c("plate").isNull() & first.rlike("^" + _DIGIT), unexpected(_first_token(c("tail")))),
                F.when(c("pieces").rlike(rf"(?<![^ ])(?:{_ONE}) [0-9]+(?![^ ])"), "multiples_direcciones"),
                F.when(c("pieces").rlike(_BAD_DASH), "token_inesperado:-"),
                F.when(c("pieces").rlike(_BAD_TOKEN), unexpected(F.regexp_extract(c("pieces"), _BAD_TOKEN, 1))),
            )),
        )),
    )
    df = stage(df, note=note)
    ok = c("note").isNull()
    fields = {f"{side}_{n}": x for side in ("via", "cross") for n, x in _segment(t(f"{side}_g")).items()}
    fields = {n: F.when(ok, x) if not n.endswith("_bis") else ok & x for n, x in fields.items()}
    fields["plate"] = F.when(ok, c("plate"))
    fields["complement"] = F.when(ok & (c("pieces") != ""), _chunks(c("pieces"))).otherwise(F.array().cast(_NO_CHUNKS))
    struct = F.struct(
        c("raw").alias("raw"),
        ok.alias("parse_ok"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array(c("note"))).alias("notes"),
        *[fields[n].alias(n) for n in FIELDS],
        F.when(ok, F.regexp_extract(c("plate"), "^([0-9]+)", 1).try_cast("int")).alias("plate_num"),
        F.when(ok, or_null(F.regexp_extract(c("plate"), "([A-Z]?)$", 1))).alias("plate_letter"),
    )
    # through a generator, so that filters, join keys and their lineage above end at
    # the struct; through a projection they would carry the whole grammar with them
    df = df.withColumn(t("struct"), settled(struct))
    out = df.withColumn(t("out"), F.explode(F.array(t("struct"))))
    return out.select(*[F.col(x) for x in own if x != into], F.col(t("out")).alias(into))


__all__ = ["parse", "SEGMENT"]
