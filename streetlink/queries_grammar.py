"""Registered queries over the whole grammar and their SQL.

``GRAMMAR`` spells addresses from a hard key (road type, numbers, plate, complement)
and a soft key (letters, suffixes, BIS, quadrants of both sides, type of the
crossing road), with every accepted spelling of a type and of a kind; ``REFUSED``
has texts for every note. What they parse to is known from the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.render import render, show_complement
from .operators.classify import note_family
from .operators.compare import match_pairs
from .operators.link import block_base, link, parse_queries
from .operators.parse import parse
from .sources.tables import over
from .synthetic import BASE, QUERIES, block_sql, score_sql
from .vocab import KINDS, OPAQUE_KIND, TWO_WORD_VIA_TYPES, VIA_TYPES

Query = Callable[[SparkSession, str], DataFrame]

#: a complement's value as spelled, as parsed, as rendered
_VALUES = [
    ("0101", "101", "101"), ("1-2", "1/2", "1 2"), ("A", "A", "A"), ("A-1", "A1", "A - 1"), ("5B", "5B", "5B"), ("12 C", "12C", "12C"), ("3/4", "3/4", "3 4"),
    ("1103A-1", "1103A1", "1103 A - 1"), ("B-2", "B2", "B2"), ("000", "0", "0"), ("A Z", "A/Z", "A Z"),
]
#: first kinds; two are words of no known kind, which may only come first
_FIRST = [*KINDS.items(), ("SO", "SO"), ("BO", "BO")]
#: spelled and code of the kinds that may follow
_SECOND = [("AP", "AP"), ("TO", "TO"), ("LT", "LT"), ("of", "OF"), ("BLQ", "BLQ"), ("Int.", "INT"), ("mz", "MZ")]


def _table(rows: list[tuple], name: str, *columns: str) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "CAST(NULL AS STRING)" if v is None else f"'{v}'"
    values = ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(rows))
    return f"(VALUES {values}) AS {name}({name}_i, {', '.join(columns)})"


_TYPES = list((VIA_TYPES | TWO_WORD_VIA_TYPES).items())


def _side(s: str, key: str, number: str) -> str:
    """Columns of one segment; a quadrant is given by its letter where that cannot be read as another."""
    letters = f"CASE {key} % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'N' WHEN 3 THEN 'Z' END"
    suffix = f"CASE WHEN {key} % 3 = 1 THEN CAST(1 + {key} % 12 AS STRING) END"
    bis = f"({key} % 11 IN (2, 5, 7))"
    short = f"({key} % 7 = 5 AND ({key} % 4 > 0 OR {key} % 3 = 1 OR {bis}))"
    quadrant = f"CASE WHEN {key} % 7 = 1 THEN 'NORTE' WHEN {key} % 7 = 2 THEN 'SUR' WHEN {key} % 7 = 3 THEN 'ESTE' WHEN {key} % 7 = 4 THEN 'OESTE' WHEN {short} THEN CASE {key} % 5 WHEN 0 THEN 'NORTE' WHEN 1 THEN 'SUR' WHEN 2 THEN 'ESTE' ELSE 'OESTE' END END"
    said = f"CASE WHEN {short} THEN CASE {key} % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'S' WHEN 2 THEN 'E' WHEN 3 THEN 'O' ELSE 'W' END ELSE {quadrant} END"
    suffix_letters = f"CASE WHEN {key} % 3 = 1 AND {key} % 5 = 2 THEN 'B' WHEN {key} % 3 = 1 AND {key} % 5 = 3 AND ({bis} OR {key} % 7 BETWEEN 1 AND 4) THEN 'E' END"
    spelled = f"concat_ws(' ', {number}, {letters}, CASE WHEN {key} % 3 = 1 THEN concat(CASE WHEN {key} % 8 = 4 THEN '0' ELSE '' END, {suffix}) END, {suffix_letters}, CASE WHEN {bis} THEN 'Bis' END, {said})"
    return f"{letters} AS {s}_letters, {suffix} AS {s}_suffix, {suffix_letters} AS {s}_suffix_letters, {bis} AS {s}_bis, {quadrant} AS {s}_quadrant, {spelled} AS {s}_said"


def grammar(soft: str = "k") -> str:
    """SQL of id, raw, canonical, complement, n_chunks and the fields, for a soft key made of the hard key k."""
    keys = f"SELECT c_custkey AS k, {soft.replace('k', 'c_custkey')} AS s FROM customer"
    keys = f"SELECT k, s, CAST(floor(s / 11) AS BIGINT) + s % 3 AS t, CAST(floor(k / 5) AS BIGINT) AS h FROM ({keys}) a"
    plate = "CASE WHEN k % 19 <> 8 THEN concat(CASE k % 4 WHEN 1 THEN '0' WHEN 2 THEN '000' ELSE '' END, 1 + (k * 7) % 130, CASE WHEN k % 6 = 2 THEN 'J' ELSE '' END) END"
    parts = f"""SELECT *, CAST(1 + k % 150 AS STRING) AS via_number, CAST(1 + h % 90 AS STRING) AS cross_number, {plate} AS plate,
        {_side('via', 's', "concat(CASE WHEN k % 9 = 3 THEN '00' ELSE '' END, 1 + k % 150)")}, {_side('cross', 't', 'CAST(1 + h % 90 AS STRING)')},
        CASE WHEN h % 4 < 3 THEN vc END AS via_type, CASE WHEN t % 5 < 2 THEN xc END AS cross_type, h % 3 >= 1 AS one, h % 3 = 2 AS two, k % 5 = 4 AND k % 19 <> 8 AS bare, k % 13 = 6 AS own
      FROM ({keys}) b JOIN {_table(_TYPES, 'v', 'vs', 'vc')} ON v_i = k % {len(_TYPES)} JOIN {_table(_TYPES, 'x', 'xs', 'xc')} ON x_i = t % {len(_TYPES)}
        JOIN {_table(_FIRST, 'q', 'qs', 'qc')} ON q_i = k % {len(_FIRST)} JOIN {_table(_SECOND, 'r', 'rs', 'rc')} ON r_i = k % {len(_SECOND)}
        JOIN {_table(_VALUES, 'm', 'ms', 'mv', 'mr')} ON m_i = h % {len(_VALUES)} JOIN {_table(_VALUES, 'o', 'os', 'ov', 'orr')} ON o_i = k % {len(_VALUES)}"""
    # a bare first chunk begins with digits, and one of the kinds has no value of its own (PH stands alone)
    chunks = f"""SELECT *, CASE WHEN bare THEN '{OPAQUE_KIND}' ELSE qc END AS k1, CASE WHEN bare THEN '8C' WHEN own THEN '' ELSE mv END AS v1, CASE WHEN bare THEN '8C' WHEN own THEN '' ELSE mr END AS r1,
        CASE WHEN bare THEN '8 C' WHEN own THEN qs ELSE concat(qs, ' ', ms) END AS s1 FROM ({parts}) c"""
    show = lambda k, v: f"CASE WHEN {k} = '{OPAQUE_KIND}' THEN {v} ELSE trim(concat({k}, ' ', {v})) END"
    one, two = show("k1", "v1"), show("rc", "ov")
    told, then = show("k1", "r1"), show("rc", "orr")
    first = "(k1 < rc OR (k1 = rc AND v1 <= ov))"
    # kinds that are not known are rendered before those that are
    lead = f"(k1 IN ('{OPAQUE_KIND}', 'SO', 'BO') OR {first})"
    segment = lambda s: f"{s}_type, {s}_number, {s}_letters, {s}_suffix, {s}_suffix_letters, CASE WHEN {s}_bis THEN 'BIS' END, {s}_quadrant"
    digits = "regexp_replace(plate, '^0+', '')"
    padded = f"CASE WHEN length(regexp_replace({digits}, 'J', '')) < 2 THEN concat('0', {digits}) ELSE {digits} END"
    tail = f"CASE WHEN two THEN CASE WHEN {lead} THEN concat({told}, ' ', {then}) ELSE concat({then}, ' ', {told}) END WHEN one THEN {told} END"
    return f"""SELECT k AS id, via_type, via_number, via_letters, via_suffix, via_suffix_letters, via_bis, via_quadrant, cross_type, cross_number, cross_letters, cross_suffix,
        cross_suffix_letters, cross_bis, cross_quadrant, plate,
        CASE WHEN two THEN CASE WHEN {first} THEN concat({one}, ', ', {two}) ELSE concat({two}, ', ', {one}) END WHEN one THEN {one} END AS complement,
        CAST(CASE WHEN two THEN 2 WHEN one THEN 1 ELSE 0 END AS INTEGER) AS n_chunks,
        concat_ws(' ', {segment('via')}, '#', {segment('cross')}, CASE WHEN plate IS NOT NULL OR one THEN '-' END, {padded}, {tail}) AS canonical,
        concat_ws(' ', CASE WHEN via_type IS NOT NULL THEN vs END, via_said, CASE k % 5 WHEN 0 THEN '#' WHEN 1 THEN 'No.' WHEN 2 THEN 'NRO' WHEN 3 THEN '# #' ELSE 'Nº' END,
          CASE WHEN cross_type IS NOT NULL THEN lower(xs) END, cross_said, '-', plate, CASE WHEN one THEN s1 END, CASE WHEN two THEN concat(rs, ' ', os) END) AS raw
      FROM ({chunks}) d"""


GRAMMAR = grammar()
_FIELDS = [f"{s}_{f}" for s in ("via", "cross") for f in ("type", "number", "letters", "suffix", "suffix_letters", "bis", "quadrant")] + ["plate"]

#: text (with a number for @) and its note; the last three are near to others and parse
_REFUSED = [
    (None, "entrada_no_texto"), ("", "entrada_vacia"), ("   ", "entrada_vacia"), (";", "multiples_direcciones"),
    ("KR @ 9 80", "falta_separador_hash"), ("KR 26 G 5 @ - 13", "falta_separador_hash"), ("SIN DIRECCION @", "falta_separador_hash"),
    ("KR # @ - 80", "numero_via_faltante"), ("KR @★ # 9 - 80", "numero_via_faltante"), ("# @ - 80", "numero_via_faltante"), ("KR @ # KR - 80", "numero_via_faltante"), ("XX @ # 9 - 80", "numero_via_faltante"),
    ("KR @ X Y # 9 - 80", "token_inesperado:Y"), ("KR 1 # @ X Y - 80", "token_inesperado:Y"), ("KR @ BIS BIS # 9 - 80", "token_inesperado:BIS"), ("KR @ # 9 # 8 - 80", "token_inesperado:#"),
    ("KR 1 # 9 - 80; CL @ # 3 - 2", "multiples_direcciones"), ("KR 1 # 9 - 80 CL @", "multiples_direcciones"), ("KR 1 # 9 - 80 # @", "multiples_direcciones"),
    ("KR @ # 9 - 1234567", "placa_invalida"), ("KR @ # 9 - 80 " + "A" * 41, "complemento_demasiado_largo"),
    ("KR @ # 9 - 80 NORTE", "token_inesperado:NORTE"), ("KR @ # 9 - 80 SUR AP 1", "token_inesperado:SUR"), ("KR @ # 9 - /50 LT 1", "token_inesperado:/50"),
    ("KR @ # 9 - 80 - 82", "token_inesperado:-"), ("KR @ # 9 - 80 AP - 82", "token_inesperado:-"), ("KR @ # 9 - 80 AP 82 -", "token_inesperado:-"),
    ("KR @ # 9 - 80 X$Y", "token_inesperado:X$Y"), ("KR @ # 9 - 80 AP (2)", "token_inesperado:(2)"),
    ("KR @ # 9 - 80 " + "A" * 40, None), ("KR @ # 9 - 0000123456", None), ("KR @ # 9 - 80 /50 /52", None),
]
REFUSED = f"SELECT c_custkey AS id, replace(raw, '@', CAST(1 + c_custkey % 99 AS STRING)) AS raw, note FROM customer JOIN {_table(_REFUSED, 'n', 'raw', 'note')} ON n_i = c_custkey % {len(_REFUSED)}"


def grammar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse(over(spark, sf_dir, GRAMMAR).select("id", "raw"), "raw", "p")
    return p.select("id", F.col("p.parse_ok").alias("parse_ok"), *[F.col(f"p.{f}").alias(f) for f in _FIELDS], show_complement(F.col("p.complement")).alias("complement"), F.size("p.complement").alias("n_chunks"))


def grammar_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text, and that of the canonical text, which is the same."""
    p = parse(over(spark, sf_dir, GRAMMAR).select("id", "raw"), "raw", "p").select("id", render(F.col("p")).alias("canonical"))
    return parse(p, "canonical", "q").select("id", "canonical", render(F.col("q")).alias("again"))


def grammar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse(over(spark, sf_dir, REFUSED).select("id", "raw"), "raw", "p")
    return p.select("id", F.col("p.parse_ok").alias("parse_ok"), F.get("p.notes", F.lit(0)).alias("note"), F.size("p.notes").alias("n_notes"))


def grammar_note_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse(over(spark, sf_dir, REFUSED).select("id", "raw"), "raw", "p").select(F.explode("p.notes").alias("note"))
    return p.groupBy(note_family(F.col("note")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note").alias("n_notes"))


#: two soft keys for one hard key: the same door, said with other letters, suffixes, BIS, quadrants and crossing types
_OTHER = "(k + 1 + 7 * (k % 5) * (k % 3))"


def grammar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts, compared on the fields of both sides."""
    a, b = over(spark, sf_dir, GRAMMAR).select("id", F.col("raw").alias("x")), over(spark, sf_dir, grammar(_OTHER)).select("id", F.col("raw").alias("y"))
    return match_pairs(a.join(b, "id"), "x", "y", 0.5, detail=False).select("id", "score", "is_match")


def _scores_sql() -> str:
    one = "CAST(1 AS DOUBLE)"
    price = lambda f, alone, other: f"CASE WHEN a.{f} IS NOT DISTINCT FROM b.{f} THEN {one} WHEN a.{f} IS NULL OR b.{f} IS NULL THEN CAST({alone} AS DOUBLE) ELSE CAST({other} AS DOUBLE) END"
    soft = [price(f"{s}_{f}", 0.85, 0.7) for s in ("via", "cross") for f in ("letters", "suffix", "suffix_letters", "quadrant")]
    bis = [f"CASE WHEN a.{s}_bis <> b.{s}_bis THEN CAST(0.85 AS DOUBLE) ELSE {one} END" for s in ("via", "cross")]
    product = " * ".join(f"({f})" for f in [*soft, *bis, price("cross_type", 0.97, 0.7)])
    return f"""SELECT id, score, score >= 0.5 AS is_match FROM (SELECT a.id, round_even({product}, 4) AS score FROM ({GRAMMAR}) a JOIN ({grammar(_OTHER)}) b ON a.id = b.id) c"""


def link_struct_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matches where the order of the base is a struct, which settles ties."""
    rows = over(spark, sf_dir, BASE).select("record_id", "raw", F.struct((F.col("record_id") % 5).alias("file"), F.col("record_id").alias("line")).alias("place"))
    asked = parse_queries(over(spark, sf_dir, QUERIES).select("query_id", "raw"), "query_id", "raw")
    return link(asked, block_base(rows, "record_id", "raw", "place")).filter("rank = 1").select("query_id", "record_id", "score")


def _struct_order_sql() -> str:
    veto, score = score_sql("q", "b")
    return f"""WITH pairs AS (SELECT q.query_id, b.record_id, {score} AS score, (NOT {veto} AND {score} >= 0.9) AS hit FROM ({QUERIES}) q JOIN ({BASE}) b ON {block_sql('q', 'b')} AND NOT q.bad AND NOT b.bad)
      SELECT query_id, record_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id % 5, record_id) AS rank FROM pairs WHERE hit) WHERE rank = 1"""


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (grammar_fields, grammar_canonical, grammar_notes, grammar_note_families, grammar_scores, link_struct_order)}


def oracle_sql() -> dict[str, str]:
    return {
        "grammar_fields": f"SELECT id, true AS parse_ok, {', '.join(_FIELDS)}, complement, n_chunks FROM ({GRAMMAR})",
        "grammar_canonical": f"SELECT id, canonical, canonical AS again FROM ({GRAMMAR})",
        "grammar_notes": f"SELECT id, note IS NULL AS parse_ok, note, CAST(CASE WHEN note IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_notes FROM ({REFUSED})",
        "grammar_note_families": f"SELECT split_part(note, ':', 1) AS family, count(*) AS n, count(DISTINCT note) AS n_notes FROM ({REFUSED}) WHERE note IS NOT NULL GROUP BY 1",
        "grammar_scores": _scores_sql(),
        "link_struct_order": _struct_order_sql(),
    }
