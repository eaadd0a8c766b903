"""Signatures, keys and categories of parsed addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, is_blank, strip_zeros
from ..vocab import FIELDS, KINDS, QUADRANTS, SEGMENT, VIA_TYPES, alternation
from .parse import parse

MAX_ADDRESS = 160


def signature(p: Column, side: str) -> Column:
    """All fields of one segment; a struct groups and compares with nulls equal."""
    return F.struct(*[p[f"{side}_{f}"].alias(f) for f in SEGMENT])


def plate_key(p: Column) -> Column:
    """The plate without leading zeros, with its letter."""
    return F.when(p["plate"].isNotNull(), F.concat(strip_zeros(F.regexp_extract(p["plate"], "^([0-9]+)", 1)), F.coalesce(p["plate_letter"], F.lit(""))))


def base_key(p: Column) -> Column:
    """What an address is apart from its complement."""
    return F.struct(signature(p, "via").alias("via"), signature(p, "cross").alias("cross"), plate_key(p).alias("plate"))


def content_key(p: Column, *drop: str) -> Column:
    """All fields as written but some."""
    return F.struct(*[p[f].alias(f) for f in FIELDS if f not in drop])


def classify_pair(a: Column, b: Column) -> Column:
    x, y = a["complement"], b["complement"]
    same_via_cross = signature(a, "via").eqNullSafe(signature(b, "via")) & signature(a, "cross").eqNullSafe(signature(b, "cross"))
    same_base = same_via_cross & plate_key(a).eqNullSafe(plate_key(b))
    return (
        F.when(~(a["parse_ok"] & b["parse_ok"]), "unparseable")
        .when(same_base & (x == y), "same_base_same_complement")
        .when(same_base & ((F.size(x) == 0) | (F.size(y) == 0)), "same_base_one_side_bare")
        .when(same_base, "same_base_complements_differ")
        .when(same_via_cross, "different_plate")
        .otherwise("different_base_other")
    )


def note_family(note: Column) -> Column:
    return F.coalesce(F.substring_index(note, ":", 1), F.lit(""))


def differing_fields(fields: Column) -> Column:
    return F.transform(F.filter(fields, lambda c: ~c["status"].isin("igual", "ausente_en_ambos", "equivalente")), lambda c: c["field"])


_KNOWN = sorted({t for t in VIA_TYPES if len(t) > 1} | set(QUADRANTS) | {"BIS"} | set(KINDS))


def shape_signature(text: Column) -> Column:
    """Digit runs as 9, unknown letter runs as A; known words and punctuation stay.

    Known words are first written in capitals inside marks, so the masks pass
    them by.
    """
    known = rf"(?iu)(?<![\p{{L}}])({alternation(_KNOWN)})(?![\p{{L}}])"
    marked = F.regexp_replace(text, known, "\x02$1\x03")
    parts = F.split(marked, "(?=\x02)|(?<=\x03)")
    masked = F.transform(parts, lambda x: F.when(x.startswith("\x02"), F.upper(F.translate(x, "\x02\x03", ""))).otherwise(F.regexp_replace(F.regexp_replace(x, r"\p{L}+", "A"), r"(?U)\d+", "9")))
    return F.when(text.isNull() | is_blank(text), "").otherwise(F.trim(F.regexp_replace(F.array_join(masked, ""), r"(?U)[\s\x1c-\x1f]+", " ")))


_ADDRESS = r"^([A-Z]{1,9}) ([0-9A-Z ]+?) # ([0-9A-Z ]+?) - ([0-9]{1,6}[A-Z]?)(?: ([0-9A-Z ]+))?$"


def split_address(text: Column) -> Column:
    """Parts of an address by a regular expression of its own, apart from the
    grammar: via_type, via, cross, plate, complement; null if it is not one."""
    one = lambda i: F.regexp_extract(text, _ADDRESS, i)
    parts = F.struct(*[one(i).alias(n) for i, n in enumerate(("via_type", "via", "cross", "plate", "complement"), 1)])
    return F.when((F.length(text) <= MAX_ADDRESS) & text.rlike(_ADDRESS) & ~text.endswith("\n"), parts)


def pair_id(prefix: str, a: Column, b: Column) -> Column:
    """Stable id of an unordered pair; a and b are texts (parts joined by \\x1f)."""
    whole = F.concat(F.lit(prefix + "\x1e"), F.least(a, b), F.lit("\x1e"), F.greatest(a, b))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(whole), 1, 12))


def failure_causes(df: DataFrame, column: str, into: str = "cause") -> DataFrame:
    """df with a label of where an address stops to fit: its segments are parsed
    again by themselves."""
    own = df.columns
    t = F.col(column)
    df = df.withColumn("__clean", clean(t))
    c = F.col("__clean")
    df = df.withColumns({
        "__via": F.trim(F.substring_index(c, "#", 1)),
        "__rest": F.when(c.contains("#"), F.trim(F.regexp_replace(c, "^[^#]*#", ""))),
    })
    df = df.withColumn("__cross", F.trim(F.substring_index("__rest", "-", 1)))
    df = df.withColumns({"__via_alone": F.concat(F.col("__via"), F.lit(" #")), "__cross_alone": F.concat(F.lit("KR 1 # "), F.col("__cross"))})
    for name, source in (("__p", column), ("__pv", "__via_alone"), ("__pc", "__cross_alone")):
        df = parse(df, source, name)
    kind = f"(?:{alternation(VIA_TYPES)})"
    body = lambda x: F.regexp_replace(x, f"^{kind}(?: |$)", "")
    two = r"(?<![^ ])\p{L} \p{L}(?![^ ])"
    note = F.get("__p.notes", F.lit(0))
    no_via, no_cross = ~F.col("__pv.parse_ok"), (F.col("__cross") != "") & ~F.col("__pc.parse_ok")
    cause = (
        F.when(t.isNull() | is_blank(t), "empty_or_non_text")
        .when(t.contains(";"), "multiple_addresses")
        .when(F.col("__p.parse_ok"), "parses_ok")
        .when(F.regexp_count("__clean", F.lit("#")) > 1, "multiple_addresses")
        .when(~c.contains("#"), "no_hash_separator")
        .when(no_via & ~body(F.col("__via")).rlike("^[0-9]"), "via_number_missing")
        .when(no_via & body(F.col("__via")).rlike(two), "via_two_letters")
        .when(no_via, "via_unexpected_token")
        .when(no_cross & body(F.col("__cross")).rlike(two), "cross_two_letters")
        .when(no_cross & ~F.col("__rest").contains("-"), "no_plate_separator")
        .when(no_cross, "cross_unexpected_token")
        .when(note == "complemento_demasiado_largo", "tail_too_long")
        .when(note == "placa_invalida", "plate_too_long")
        .when(note == "multiples_direcciones", "tail_via_type_then_number")
        .when(note.startswith("token_inesperado"), "tail_unexpected_token")
        .otherwise("other")
    )
    return df.withColumn(into, cause).select(*own, into)
