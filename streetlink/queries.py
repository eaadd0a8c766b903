"""The registered queries of the address engine and their SQL.

Addresses are built from integer keys (``synthetic``). The SQL computes what is
expected from the keys; it never parses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_grammar, queries_pairs, queries_transforms
from .functions.render import render, show_complement
from .functions.text import clean
from .operators.classify import note_family
from .operators.compare import match_parsed
from .operators.link import block_base, index_stats, link, link_summary, parse_queries
from .operators.parse import parse
from .sources.tables import over
from .synthetic import BASE, QUERIES, block_sql, score_sql

Query = Callable[[SparkSession, str], DataFrame]


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, BASE).select("record_id", "raw")


def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, QUERIES).select("query_id", "raw")


def parsed_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(base_rows(spark, sf_dir), "raw", "p")


_NOISY = """SELECT c_custkey AS id, CASE c_custkey % 5
  WHEN 0 THEN concat(' cra. ', 1 + c_custkey % 40, 'b nº ', c_nationkey, '-', c_custkey % 99)
  WHEN 1 THEN concat('calle ', c_nationkey, '  ＃ ', 1 + c_custkey % 50, ' – 0', c_custkey % 99, '  apto. 101a')
  WHEN 2 THEN concat('Avenida ', c_nationkey, ' óeste NUMERO ', c_custkey % 30, ' − ', c_custkey % 99)
  WHEN 3 THEN concat('DIAG', c_nationkey, ' NRO. ', c_custkey % 30, ' # # 4 - - 5')
  ELSE concat('tv', 1 + c_custkey % 40, 'a#', c_nationkey, '-', c_custkey % 99, 'lote numero 3') END AS raw FROM customer"""
_TIDY = """SELECT c_custkey AS id, CASE c_custkey % 5
  WHEN 0 THEN concat('CRA ', 1 + c_custkey % 40, ' B # ', c_nationkey, ' - ', c_custkey % 99)
  WHEN 1 THEN concat('CALLE ', c_nationkey, ' # ', 1 + c_custkey % 50, ' - 0', c_custkey % 99, ' APTO 101 A')
  WHEN 2 THEN concat('AVENIDA ', c_nationkey, ' OESTE # ', c_custkey % 30, ' - ', c_custkey % 99)
  WHEN 3 THEN concat('DIAG ', c_nationkey, ' # ', c_custkey % 30, ' # 4 - 5')
  ELSE concat('TV ', 1 + c_custkey % 40, ' A # ', c_nationkey, ' - ', c_custkey % 99, ' LOTE NUMERO 3') END AS cleaned FROM customer"""


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, _NOISY).select("id", clean(F.col("raw")).alias("cleaned"))


def parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed_base(spark, sf_dir)
    return p.select(
        "record_id", F.col("p.parse_ok").alias("parse_ok"), "p.via_type", "p.via_number", "p.via_letters", "p.via_suffix", "p.via_bis", "p.via_quadrant",
        "p.cross_type", "p.cross_number", "p.plate_num", "p.plate_letter",
    )


_PARSE_FIELDS = f"""SELECT record_id, NOT bad AS parse_ok, CASE WHEN NOT bad THEN vt END AS via_type, CASE WHEN NOT bad THEN CAST(vn AS VARCHAR) END AS via_number,
  CASE WHEN NOT bad THEN vl END AS via_letters, CASE WHEN NOT bad THEN CAST(vs AS VARCHAR) END AS via_suffix, (NOT bad) AND vb AS via_bis, CASE WHEN NOT bad THEN vq END AS via_quadrant,
  CASE WHEN NOT bad THEN ct END AS cross_type, CASE WHEN NOT bad THEN CAST(cn AS VARCHAR) END AS cross_number,
  CASE WHEN NOT bad THEN CAST(pl AS INTEGER) END AS plate_num, CASE WHEN NOT bad THEN pc END AS plate_letter FROM ({BASE})"""


def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_base(spark, sf_dir).filter("not p.parse_ok").select("record_id", F.col("p.notes")[0].alias("note"))


def note_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = parsed_base(spark, sf_dir).select(F.explode("p.notes").alias("note"))
    return notes.groupBy(note_family(F.col("note")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


_NO_HASH = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('CL ', 1 + c_custkey % 40, ' ', 1 + c_nationkey, ' - ', 10 + c_custkey % 80)
  WHEN 1 THEN concat('carrera ', 1 + c_custkey % 40, ' ', 1 + c_nationkey, '-', 10 + c_custkey % 80, ' apto 5')
  WHEN 2 THEN concat('KR ', 1 + c_custkey % 40, ' G ', 1 + c_nationkey, ' - ', 10 + c_custkey % 80)
  ELSE concat('KR ', 1 + c_custkey % 40, ' ', 1 + c_nationkey, ' ', 10 + c_custkey % 80) END AS raw FROM customer"""
_WITH_HASH = """SELECT c_custkey AS id, c_custkey % 4 < 2 AS parse_ok, CASE c_custkey % 4 WHEN 0 THEN concat('CL ', 1 + c_custkey % 40, ' # ', 1 + c_nationkey, ' - ', 10 + c_custkey % 80)
  WHEN 1 THEN concat('KR ', 1 + c_custkey % 40, ' # ', 1 + c_nationkey, ' - ', 10 + c_custkey % 80, ' AP 5')
  WHEN 2 THEN concat('KR ', 1 + c_custkey % 40, ' G ', 1 + c_nationkey, ' - ', 10 + c_custkey % 80)
  ELSE concat('KR ', 1 + c_custkey % 40, ' ', 1 + c_nationkey, ' ', 10 + c_custkey % 80) END AS canonical FROM customer"""


def restore_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse(over(spark, sf_dir, _NO_HASH), "raw", "p")
    return p.select("id", F.col("p.parse_ok").alias("parse_ok"), render(F.col("p")).alias("canonical"))


def complement_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed_base(spark, sf_dir).filter("p.parse_ok")
    return p.select("record_id", show_complement(F.col("p.complement")).alias("complement"), F.size("p.complement").alias("n_chunks"))


_CHUNKS = f"""SELECT record_id, CASE WHEN tail <> '' THEN replace(tail, ' TO ', ', TO ') END AS complement,
  CAST(CASE WHEN tail = '' THEN 0 WHEN tail LIKE '% TO %' THEN 2 ELSE 1 END AS INTEGER) AS n_chunks FROM ({BASE}) WHERE NOT bad"""


def render_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_base(spark, sf_dir).select("record_id", render(F.col("p")).alias("canonical"))


def own_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with its own customer's record, both parsed."""
    q = over(spark, sf_dir, QUERIES).select("query_id", F.col("own_id").alias("record_id"), "raw")
    pairs = parse(q, "raw", "a").drop("raw")
    return pairs.join(parse(base_rows(spark, sf_dir), "raw", "b").drop("raw"), "record_id")


def score_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_parsed(own_pairs(spark, sf_dir), "a", "b", detail=False).select("query_id", "record_id", "score", "is_match")


def score_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_parsed(own_pairs(spark, sf_dir), "a", "b", 0.95, 2, detail=False).select("query_id", "record_id", "score", "is_match")


def _own_sql(tolerance: int, threshold: float) -> str:
    veto, score = score_sql("q", "b", tolerance)
    return f"""SELECT q.query_id, b.record_id, {score} AS score, NOT {veto} AND {score} >= {threshold} AS is_match
      FROM ({QUERIES}) q JOIN orders o ON o.o_orderkey = q.query_id JOIN ({BASE}) b ON b.record_id = o.o_custkey"""


def match_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_parsed(own_pairs(spark, sf_dir), "a", "b").select("query_id", "reason")


_REASON = f"""SELECT q.query_id, CASE
    WHEN b.bad THEN concat('veto: dirección A no canónica (', b.note, '); dirección B no canónica (', b.note, ')')
    WHEN q.query_id % 8 = 4 AND b.tail <> '' AND b.opq THEN 'puntaje 0.8500 < umbral 0.9: complement solo en un lado'
    WHEN q.query_id % 8 = 4 AND b.tail <> '' THEN 'coincide; diferencias menores: complement'
    WHEN q.query_id % 8 = 5 AND b.pl IS NOT NULL THEN concat('veto: placa difiere (', q.pl, coalesce(q.pc, ''), ' vs ', CASE WHEN b.record_id % 5 = 1 THEN '0' ELSE '' END, b.pl, coalesce(b.pc, ''), ')')
    WHEN q.query_id % 8 = 6 AND b.vl IS NULL THEN 'puntaje 0.8500 < umbral 0.9: via_letters solo en un lado'
    WHEN q.query_id % 8 = 6 THEN 'puntaje 0.7000 < umbral 0.9: via_letters difiere'
    WHEN q.query_id % 8 = 7 AND b.cn IS NOT NULL THEN 'coincide; diferencias menores: cross_type'
    ELSE 'coincidencia exacta' END AS reason
  FROM ({QUERIES}) q JOIN orders o ON o.o_orderkey = q.query_id JOIN ({BASE}) b ON b.record_id = o.o_custkey"""


def match_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_parsed(own_pairs(spark, sf_dir), "a", "b").select("query_id", F.array_join("warnings", ",").alias("warnings"))


_WARNINGS = f"""SELECT q.query_id, CASE WHEN b.bad THEN '' ELSE concat_ws(',', CASE WHEN b.pl IS NULL THEN 'sin_placa' END, CASE WHEN b.cn IS NULL THEN 'sin_cruce' END,
    CASE WHEN b.opq THEN 'complemento_no_estructurado' END) END AS warnings
  FROM ({QUERIES}) q JOIN orders o ON o.o_orderkey = q.query_id JOIN ({BASE}) b ON b.record_id = o.o_custkey"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parse_queries(query_rows(spark, sf_dir), "query_id", "raw"), block_base(base_rows(spark, sf_dir), "record_id", "raw")


def link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_summary(*_sides(spark, sf_dir)).drop("truncated")


def link_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_summary(*_sides(spark, sf_dir), threshold=0.85, tolerance=2).drop("truncated")


def link_wide_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_summary(*_sides(spark, sf_dir), threshold=0.9, tolerance=50).drop("truncated")


def link_block_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_summary(*_sides(spark, sf_dir), max_block_scan=1)


def link_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*_sides(spark, sf_dir)).filter("rank = 1").select("query_id", "record_id", "score")


def link_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*_sides(spark, sf_dir), threshold=0.7, tolerance=1).filter("rank <= 3").select("query_id", "record_id", "score", "rank")


def _links_sql(threshold: float, tolerance: int = 0, base: str = f"({BASE})") -> str:
    veto, score = score_sql("q", "b", tolerance)
    return f"""q AS ({QUERIES}), base AS (SELECT * FROM {base} WHERE NOT bad),
      pairs AS (SELECT q.query_id, b.record_id, {score} AS score, (NOT {veto} AND {score} >= {threshold}) AS hit
        FROM q JOIN base b ON {block_sql('q', 'b', tolerance)} AND NOT q.bad)"""


def _summary_sql(threshold: float, tolerance: int = 0) -> str:
    return f"""WITH {_links_sql(threshold, tolerance)},
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM pairs WHERE hit),
      found AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN record_id END) AS best_id, max(score) AS best_score, sum(CASE WHEN score = top THEN 1 ELSE 0 END) AS ties FROM ranked GROUP BY query_id),
      seen AS (SELECT query_id, count(*) AS n FROM pairs GROUP BY query_id)
      SELECT q.query_id, NOT q.bad AS parse_ok, CAST(coalesce(seen.n, 0) AS BIGINT) AS n_compared, CAST(coalesce(found.n, 0) AS BIGINT) AS n_candidates, found.best_id, found.best_score,
        coalesce(found.ties, 0) > 1 AS ambiguous, CAST(greatest(coalesce(found.n, 0) - 1, 0) AS BIGINT) AS alternatives, coalesce(found.n, 0) > 1 AS near_ambiguous,
        CASE WHEN q.bad THEN concat('consulta no canónica (', q.note, ')') WHEN found.n IS NULL THEN 'sin candidatos sobre el umbral' ELSE '' END AS reason
      FROM q LEFT JOIN seen ON seen.query_id = q.query_id LEFT JOIN found ON found.query_id = q.query_id"""


_CAPPED = f"""(SELECT *, row_number() OVER (PARTITION BY vt, vn, cn, pl ORDER BY record_id) AS place, count(*) OVER (PARTITION BY vt, vn, cn, pl) AS size FROM ({BASE}) WHERE NOT bad)"""


def _capped_sql() -> str:
    veto, score = score_sql("q", "b")
    return f"""WITH q AS ({QUERIES}), base AS (SELECT * FROM {_CAPPED} WHERE place <= 1),
      pairs AS (SELECT q.query_id, b.record_id, b.size > 1 AS truncated, {score} AS score, (NOT {veto} AND {score} >= 0.9) AS hit FROM q JOIN base b ON {block_sql('q', 'b')} AND NOT q.bad),
      seen AS (SELECT query_id, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits, max(CASE WHEN hit THEN record_id END) AS best_id, max(CASE WHEN hit THEN score END) AS best_score, bool_or(truncated) AS truncated FROM pairs GROUP BY query_id)
      SELECT q.query_id, NOT q.bad AS parse_ok, CAST(coalesce(seen.n, 0) AS BIGINT) AS n_compared, CAST(coalesce(seen.hits, 0) AS BIGINT) AS n_candidates, seen.best_id, seen.best_score,
        false AS ambiguous, CAST(0 AS BIGINT) AS alternatives, false AS near_ambiguous, coalesce(seen.truncated, false) AS truncated,
        CASE WHEN q.bad THEN concat('consulta no canónica (', q.note, ')') WHEN coalesce(seen.hits, 0) = 0 THEN 'sin candidatos sobre el umbral' ELSE '' END AS reason
      FROM q LEFT JOIN seen ON seen.query_id = q.query_id"""


def stats_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_stats(base_rows(spark, sf_dir), "record_id", "raw")


_STATS = f"""WITH b AS ({BASE}), blocks AS (SELECT vt, vn, cn, pl, count(*) AS n FROM b WHERE NOT bad GROUP BY vt, vn, cn, pl)
  SELECT (SELECT count(DISTINCT record_id) FROM b WHERE NOT bad) AS records, count(*) AS blocks, max(n) AS max_block_size, (SELECT count(*) FROM b WHERE bad) AS rejected FROM blocks"""


def queries() -> dict[str, Query]:
    own = {
        "clean_text": clean_text, "parse_fields": parse_fields, "parse_failures": parse_failures, "note_counts": note_counts, "restore_hash": restore_hash,
        "complement_chunks": complement_chunks, "render_canonical": render_canonical, "score_own": score_own, "score_tolerance": score_tolerance,
        "match_reason": match_reason, "match_warnings": match_warnings, "link_exact": link_exact, "link_tolerance": link_tolerance,
        "link_wide_band": link_wide_band, "link_block_cap": link_block_cap, "link_best": link_best, "link_topk": link_topk, "index_stats": stats_of_index,
    }
    return own | queries_grammar.queries() | queries_pairs.queries() | queries_transforms.queries()


def oracle_sql() -> dict[str, str]:
    own = {
        "clean_text": _TIDY,
        "parse_fields": _PARSE_FIELDS,
        "parse_failures": f"SELECT record_id, note FROM ({BASE}) WHERE bad",
        "note_counts": f"SELECT split_part(note, ':', 1) AS family, count(*) AS n FROM ({BASE}) WHERE bad GROUP BY 1",
        "restore_hash": _WITH_HASH,
        "complement_chunks": _CHUNKS,
        "render_canonical": f"SELECT record_id, CASE WHEN bad THEN raw ELSE canonical END AS canonical FROM ({BASE})",
        "score_own": _own_sql(0, 0.9),
        "score_tolerance": _own_sql(2, 0.95),
        "match_reason": _REASON,
        "match_warnings": _WARNINGS,
        "link_exact": _summary_sql(0.9),
        "link_tolerance": _summary_sql(0.85, 2),
        "link_wide_band": _summary_sql(0.9, 50),
        "link_block_cap": _capped_sql(),
        "link_best": f"WITH {_links_sql(0.9)} SELECT query_id, record_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM pairs WHERE hit) WHERE rank = 1",
        "link_topk": f"WITH {_links_sql(0.7, 1)} SELECT query_id, record_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM pairs WHERE hit) WHERE rank <= 3",
        "index_stats": _STATS,
    }
    return own | queries_grammar.oracle_sql() | queries_pairs.oracle_sql() | queries_transforms.oracle_sql()
