"""Every transform of the synthetic positives over addresses from customers' keys, and its SQL.

The hash that a transform chooses by is a column here, so SQL repeats the choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import settled
from .operators.classify import split_address
from .operators.transforms import TRANSFORMS
from .sources.tables import over
from .vocab import SYNTHETIC_KIND_LONG, SYNTHETIC_KIND_NOVEL, SYNTHETIC_TYPE_LONG, SYNTHETIC_TYPE_NOVEL, SYNTHETIC_TYPE_SHORT

SOURCES = """SELECT id, h, t, v, x, pl, c, concat(t, ' ', v, ' # ', x, ' - ', pl, CASE WHEN c = '' THEN '' ELSE ' ' || c END) AS raw
FROM (SELECT c_custkey AS id, c_custkey * 2654435761 % 1099511627776 AS h,
    CASE c_custkey % 7 WHEN 0 THEN 'KR' WHEN 1 THEN 'CALLE' WHEN 2 THEN 'AV' WHEN 3 THEN 'DG' WHEN 4 THEN 'T' WHEN 5 THEN 'CIRCULAR' ELSE 'PJ' END AS t,
    concat(1 + c_custkey % 90, CASE c_custkey % 8 WHEN 1 THEN ' A' WHEN 5 THEN ' B 3' ELSE '' END) AS v,
    concat(CASE c_custkey % 4 WHEN 1 THEN 'KR ' WHEN 2 THEN 'A ' ELSE '' END, 1 + c_nationkey) AS x, concat(1 + c_custkey % 99, CASE WHEN c_custkey % 9 = 0 THEN 'B' ELSE '' END) AS pl,
    CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'AP 101' WHEN 2 THEN 'TO 2 AP 7' WHEN 3 THEN 'LC 3' WHEN 4 THEN 'ED 4 OF 5' WHEN 5 THEN 'SO 1' WHEN 6 THEN 'BLQ 2 INT 3' WHEN 7 THEN 'CA 9' WHEN 8 THEN 'PQ 8' ELSE '' END AS c
  FROM customer) s"""


def transform_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, SOURCES).select("id", "h", "raw").withColumn("parts", settled(split_address(F.col("raw"))))
    made = F.array(*[F.struct(F.lit(tag).alias("transform"), f(F.col("raw"), F.col("parts"), F.col("h")).alias("text")) for tag, f in TRANSFORMS.items()])
    return rows.select("id", F.explode(made).alias("m")).select("id", "m.transform", "m.text").filter("text is not null")


def _join(t: str = "t", v: str = "v", x: str = "x", pl: str = "pl", c: str = "c") -> str:
    return f"concat({t}, ' ', {v}, ' # ', {x}, ' - ', {pl}, CASE WHEN {c} = '' THEN '' ELSE ' ' || {c} END)"


def _pick(key: str, table: dict[str, list[str]], h: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {forms}[{h} % {len(forms)} + 1]" for k, forms in table.items() if forms)
    return f"CASE {key} {whens} END"


def _retyped(words: Callable[[str], list[str]]) -> str:
    table = {k: [w for w in words(long) if w != k] for k, long in SYNTHETIC_TYPE_LONG.items()}
    via, cross = _pick("t", table, "h"), f"CASE WHEN instr(x, ' ') > 0 THEN {_pick('split_part(x, chr(32), 1)', table, '(h >> 8)')} END"
    via_too = f"({via} IS NOT NULL AND ({cross} IS NULL OR (h >> 16) % 100 < 85))"
    cross_too = f"({cross} IS NOT NULL AND (NOT {via_too} OR (h >> 24) % 2 = 0))"
    text = _join(f"CASE WHEN {via_too} THEN {via} ELSE t END", x=f"CASE WHEN {cross_too} THEN concat({cross}, ' ', split_part(x, ' ', 2)) ELSE x END")
    return f"CASE WHEN {via_too} OR {cross_too} THEN {text} END"


def _rekinded(table: dict[str, list[str]]) -> str:
    new = f"array_to_string(list_transform(string_split(c, ' '), lambda w: coalesce({_pick('w', table, 'h')}, w)), ' ')"
    return f"CASE WHEN {new} <> c THEN {_join(c=new)} END"


def _padded(col: str, h: str) -> str:
    return f"regexp_replace({col}, '([0-9])', CASE WHEN {h} % 2 = 0 THEN '0\\1' ELSE '00\\1' END)"


def _first(old: str, new: str) -> str:
    return f"CASE WHEN instr(raw, '{old}') > 0 THEN concat(substr(raw, 1, instr(raw, '{old}') - 1), '{new}', substr(raw, instr(raw, '{old}') + {len(old)})) END"


def _of(*forms: str) -> str:
    return f"CASE h % {len(forms)} {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(forms))} END"


_GLUE = [f"((h >> {s}) % 10 < 7)" for s in (0, 8, 16)]
_WIDE = "array_to_string(list_transform(string_split(raw, ' '), lambda w, i: CASE WHEN i = 1 THEN w ELSE concat(repeat(' ', [1, 1, 2, 3][(h >> CAST((2 * (i - 1)) % 40 AS BIGINT)) % 4 + 1]), w) END), '')"
_TIED = "concat(array_to_string(string_split(raw, ' ')[1:2 + (h >> 8) % 3], chr(160)), array_to_string(list_transform(string_split(raw, ' ')[3 + (h >> 8) % 3:], lambda w: concat(' ', w)), ''))"
_BLANK = "[' ', '  ', chr(9), chr(160)][h % 4 + 1]"
_SQL = {
    "type_alias_long": _retyped(lambda long: [long]),
    "type_alias_short": _retyped(lambda long: SYNTHETIC_TYPE_SHORT.get(long, [])),
    "novel_type_alias": _retyped(lambda long: SYNTHETIC_TYPE_NOVEL.get(long, [])),
    "complement_alias": _rekinded(SYNTHETIC_KIND_LONG),
    "novel_complement_alias": _rekinded(SYNTHETIC_KIND_NOVEL),
    "zero_padded": _join(v=f"CASE WHEN (h >> 4) % 2 = 0 THEN {_padded('v', '(h >> 5)')} ELSE v END", x=f"CASE WHEN (h >> 8) % 2 = 0 THEN {_padded('x', '(h >> 9)')} ELSE x END", pl=_padded("pl", "h")),
    "glued_tokens": f"""concat(t, CASE WHEN {_GLUE[0]} THEN '' ELSE ' ' END, v, CASE WHEN {_GLUE[1]} OR NOT ({' OR '.join(_GLUE)}) THEN '#' ELSE ' # ' END, x,
      CASE WHEN {_GLUE[2]} THEN '-' ELSE ' - ' END, pl, CASE WHEN c = '' THEN '' ELSE ' ' || c END)""",
    "lowercase": _of("lower(raw)", "array_to_string(list_transform(string_split(raw, ' '), lambda w: concat(w[1], lower(w[2:]))), ' ')"),
    "extra_whitespace": f"CASE WHEN {_WIDE} <> raw THEN {_WIDE} ELSE {_first(' ', '  ')} END",
    "hash_to_no": _of(*[_first("#", w) for w in ("No", "No.", "N°", "Nº", "NO")]),
    "hash_absent": f"CASE WHEN v NOT LIKE '% B 3' THEN {_first(' # ', ' ')} END",
    "punctuation": _of(_first(" ", ". "), _first(" # ", ", # "), "concat(raw, '.')"),
    "unicode_symbols": _of(_first("#", "＃"), _first("#", "№")),
    "unicode_spacing": _of(_TIED, _first(" - ", " \u2013 "), _first(" - ", " \u2014 ")),
    "trailing_whitespace": f"CASE WHEN (h >> 8) % 4 = 0 THEN concat({_BLANK}, raw) ELSE concat(raw, {_BLANK}) END",
    "novel_number_word": _first(" # ", " NUMERO "),
}


def transform_sql() -> str:
    every = " UNION ALL ".join(f"SELECT id, '{tag}' AS transform, {text} AS text FROM s" for tag, text in _SQL.items())
    return f"WITH s AS ({SOURCES}) SELECT * FROM ({every}) WHERE text IS NOT NULL"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"transform_texts": transform_texts}


def oracle_sql() -> dict[str, str]:
    return {"transform_texts": transform_sql()}
