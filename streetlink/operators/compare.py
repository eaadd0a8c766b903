"""Comparison of two parsed addresses: hard vetoes and multiplicative penalties.

A veto makes the score 0 and is never a match, even at threshold 0. Missing on
both sides is agreement, but is told as a warning. All functions take struct
columns made by ``parse`` and give columns; ``match_pairs`` puts them together.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import show_complement
from ..functions.text import settled
from ..vocab import BIS_FIELDS, HARD_FIELDS, KINDS, LABELS, PENALTIES, QUADRANTS, SOFT_FIELDS, THRESHOLD, TOLERANCE
from .parse import parse


class InvalidThreshold(ValueError):
    """The threshold is not a number from 0 to 1."""


class InvalidTolerance(ValueError):
    """The plate tolerance is not a whole number from 0."""


def checked_threshold(value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or not 0 <= value <= 1:
        raise InvalidThreshold(f"umbral inválido: {value!r}")
    return float(value)


def checked_tolerance(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise InvalidTolerance(f"tolerancia de placa inválida: {value!r}")
    return value


class Comparison:
    """One field of two addresses: penalty and veto as columns (None: neither), and
    functions for what only a shown comparison has, so that a score does not build it."""

    def __init__(self, field: str, shown: Callable[[], tuple[Column, Column]], status: Callable[[], Column], penalty: Column | None, veto: Column | None):
        self.field, self.shown, self.status, self.penalty, self.veto = field, shown, status, penalty, veto

    def struct(self) -> Column:
        a, b = self.shown()
        penalty, veto = F.lit(0.0) if self.penalty is None else self.penalty, F.lit(False) if self.veto is None else self.veto
        return F.struct(F.lit(self.field).alias("field"), a.alias("a"), b.alias("b"), self.status().alias("status"), penalty.alias("penalty"), veto.alias("veto"))


def _status(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), "ausente_en_ambos").when(a.isNull() | b.isNull(), "solo_en_uno").when(a == b, "igual").otherwise("difiere")


def _priced(a: Column, b: Column, one_sided: float, conflict: float) -> Column:
    return F.when(a.eqNullSafe(b), 0.0).when(a.isNull() | b.isNull(), one_sided).otherwise(conflict)


def opaque(chunks: Column) -> Column:
    """Whether any chunk says nothing: an unknown kind, no value, or only quadrant words."""
    empty = rf"^(?:(?:{'|'.join(QUADRANTS)})(?:/(?:{'|'.join(QUADRANTS)}))*)?$"
    return F.exists(chunks, lambda c: ~c["kind"].isin(list(KINDS)) | c["value"].rlike(empty))


#: One side of a comparison: a struct made by ``parse``, or its fields each as a column, with
#: ``opaque`` computed and the complement in any form of array that is equal when it is.
Side = Column | dict[str, Column]


def _plate(a: Column, b: Column, tolerance: int, penalties: dict) -> Comparison:
    x, y = a["plate"], b["plate"]
    near = F.abs(a["plate_num"] - b["plate_num"])
    letters = a["plate_letter"].eqNullSafe(b["plate_letter"])
    status = (
        F.when(x.isNull() & y.isNull(), "ausente_en_ambos").when(x.isNull() | y.isNull(), "solo_en_uno").when(x == y, "igual")
        .when(~letters, "difiere").when(near == 0, "equivalente").when(near <= tolerance, "dentro_tolerancia").otherwise("difiere")
    )
    return Comparison("plate", lambda: (x, y), lambda: status, F.when(status == "dentro_tolerancia", penalties["plate_tolerance"]).otherwise(0.0), status.isin("solo_en_uno", "difiere"))


def _complement(a: Column, b: Column, penalties: dict) -> Comparison:
    x, y = a["complement"], b["complement"]
    none_a, none_b = F.size(x) == 0, F.size(y) == 0
    status = F.when(none_a & none_b, "ausente_en_ambos").when(x == y, "igual").when(none_a | none_b, "solo_en_uno").otherwise("difiere")
    odd = lambda p: p["opaque"] if isinstance(p, dict) else opaque(p["complement"])
    price = F.when(odd(a) | odd(b), penalties["one_sided"]).otherwise(penalties["complement_one_sided"])
    return Comparison("complement", lambda: (show_complement(x), show_complement(y)), lambda: status, F.when(status == "solo_en_uno", price).otherwise(0.0), status == "difiere")


def vetoing(a: Column, b: Column, tolerance: int = TOLERANCE, penalties: dict = PENALTIES) -> list[Comparison]:
    """The fields that can veto."""
    hard = [_compared(a, b, f, None, ~a[f].eqNullSafe(b[f])) for f in HARD_FIELDS]
    return [*hard, _plate(a, b, tolerance, penalties), _complement(a, b, penalties)]


def _compared(a: Column, b: Column, f: str, penalty: Column | None, veto: Column | None) -> Comparison:
    return Comparison(f, lambda: (a[f], b[f]), lambda: _status(a[f], b[f]), penalty, veto)


def comparisons(a: Side, b: Side, tolerance: int = TOLERANCE, penalties: dict = PENALTIES) -> list[Comparison]:
    """The 16 fields, in the order in which their penalties multiply."""
    out = vetoing(a, b, tolerance, penalties)
    out += [_compared(a, b, f, _priced(a[f], b[f], penalties["one_sided"], penalties["conflict"]), None) for f in SOFT_FIELDS]
    for f in BIS_FIELDS:
        both = lambda f=f: (F.when(a[f], "BIS"), F.when(b[f], "BIS"))
        out.append(Comparison(f, both, lambda both=both: _status(*both()), F.when(a[f] == b[f], 0.0).otherwise(penalties["one_sided"]), None))
    f = "cross_type"
    return out + [_compared(a, b, f, _priced(a[f], b[f], penalties["cross_type_one_sided"], penalties["cross_type_conflict"]), None)]


def rounded(product: Column) -> Column:
    """Four digits, as a double's exact value rounds. Of all products that the
    penalties can make, half-even decimal rounding misses one."""
    return F.when(product == F.lit(0.29155), 0.2915).otherwise(F.bround(product, 4))


def vetoed(a: Column, b: Column, tolerance: int = TOLERANCE) -> Column:
    either = reduce(lambda x, y: x | y, (c.veto for c in vetoing(a, b, tolerance)))
    return ~(a["parse_ok"] & b["parse_ok"]) | either


def score(a: Column, b: Column, tolerance: int = TOLERANCE, penalties: dict = PENALTIES) -> Column:
    """The score alone; 0 for a veto."""
    all_ = comparisons(a, b, tolerance, penalties)
    veto = ~(a["parse_ok"] & b["parse_ok"]) | reduce(lambda x, y: x | y, (c.veto for c in all_[:5]))
    product = reduce(lambda x, y: x * y, (F.lit(1.0) - c.penalty for c in all_ if c.penalty is not None), F.lit(1.0))
    return F.when(veto, 0.0).otherwise(rounded(product))


def reaches(product: Column, threshold: float) -> Column:
    """Whether the rounded product is at least the threshold; rounding is slow and done only near it."""
    return (product >= threshold + 1e-4) | ((product >= threshold - 1e-4) & (rounded(product) >= threshold))


def warnings(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    told = F.array_compact(F.array(
        F.when(a["plate"].isNull() & b["plate"].isNull(), "sin_placa"),
        F.when(a["cross_number"].isNull() & b["cross_number"].isNull(), "sin_cruce"),
        F.when(opaque(a["complement"]) | opaque(b["complement"]), "complemento_no_estructurado"),
    ))
    return F.when(a["parse_ok"] & b["parse_ok"], told).otherwise(none)


def _reason(a: Column, b: Column, fields: Column, score_: Column, veto: Column, threshold: float) -> Column:
    side = lambda p, name: F.when(~p["parse_ok"], F.concat(F.lit(f"dirección {name} no canónica ("), F.array_join(p["notes"], ", "), F.lit(")")))
    unread = F.concat(F.lit("veto: "), F.concat_ws("; ", side(a, "A"), side(b, "B")))
    label = lambda f: reduce(lambda x, kv: x.when(f == kv[0], kv[1]), list(LABELS.items())[1:], F.when(f == "via_type", LABELS["via_type"])).otherwise(f)
    shown = lambda v: F.coalesce(v, F.lit("None"))
    against = F.transform(F.filter(fields, lambda c: c["veto"]), lambda c: F.when(c["status"] == "solo_en_uno", F.concat(label(c["field"]), F.lit(" presente solo en un lado"))).otherwise(
        F.concat(label(c["field"]), F.lit(" difiere ("), shown(c["a"]), F.lit(" vs "), shown(c["b"]), F.lit(")"))))
    differing = F.filter(fields, lambda c: c["penalty"] > 0)
    names = F.array_join(F.transform(differing, lambda c: c["field"]), ", ")
    told = F.array_join(F.transform(differing, lambda c: F.concat(c["field"], F.when(c["status"] == "solo_en_uno", " solo en un lado").otherwise(" difiere"))), ", ")
    return (
        F.when(~(a["parse_ok"] & b["parse_ok"]), unread)
        .when(veto, F.concat(F.lit("veto: "), F.array_join(against, "; ")))
        .when(F.size(differing) == 0, "coincidencia exacta")
        .when(score_ >= threshold, F.concat(F.lit("coincide; diferencias menores: "), names))
        .otherwise(F.concat(F.lit("puntaje "), F.format_string("%.4f", score_), F.lit(f" < umbral {threshold:g}: "), told))
    )


FIELD_TYPE = "array<struct<field:string,a:string,b:string,status:string,penalty:double,veto:boolean>>"


def match_parsed(df: DataFrame, a: str, b: str, threshold: float = THRESHOLD, tolerance: int = TOLERANCE, detail: bool = True, penalties: dict = PENALTIES) -> DataFrame:
    """df with score and is_match, and with ``detail`` fields, warnings and reason,
    for two struct columns of parsed addresses."""
    threshold, tolerance = checked_threshold(threshold), checked_tolerance(tolerance)
    x, y = F.col(a), F.col(b)
    if not detail:
        df = df.withColumns({"score": settled(score(x, y, tolerance, penalties)), "__veto": vetoed(x, y, tolerance)})
        return df.withColumn("is_match", ~F.col("__veto") & (F.col("score") >= threshold)).drop("__veto")
    both = x["parse_ok"] & y["parse_ok"]
    compared = F.array(*[c.struct() for c in comparisons(x, y, tolerance, penalties)]).cast(FIELD_TYPE)
    df = df.withColumn("fields", F.when(settled(both), compared).otherwise(F.array().cast(FIELD_TYPE)))
    df = df.withColumn("__veto", ~both | F.exists("fields", lambda c: c["veto"]))
    product = F.aggregate("fields", F.lit(1.0), lambda acc, c: acc * (F.lit(1.0) - c["penalty"]))
    df = df.withColumn("score", F.when(F.col("__veto"), 0.0).otherwise(rounded(product)))
    df = df.withColumn("is_match", ~F.col("__veto") & (F.col("score") >= threshold))
    df = df.withColumn("warnings", warnings(x, y)).withColumn("reason", _reason(x, y, F.col("fields"), F.col("score"), F.col("__veto"), threshold))
    return df.drop("__veto")


def match_pairs(df: DataFrame, a: str, b: str, threshold: float = THRESHOLD, tolerance: int = TOLERANCE, detail: bool = True) -> DataFrame:
    """The same for two text columns; parsed addresses come as parsed_a and parsed_b."""
    return match_parsed(parse(parse(df, a, "parsed_a"), b, "parsed_b"), "parsed_a", "parsed_b", threshold, tolerance, detail)


Scorer = Callable[[Column, Column], Column]
