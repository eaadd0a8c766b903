"""Addresses built from integer keys, in SQL that Spark and DuckDB both read.

``customer`` gives a base of addresses: each row has the fields it is made of
(vt, vn, ...), the canonical text that they render to, and a spelling with the
slips that real entries have. ``orders`` gives queries: the spelling of its
customer's address, with one field changed for some. The fields are known
without parsing, which makes an SQL check of the parser independent.
"""

from __future__ import annotations

#: k: c_custkey, n: c_nationkey
_FIELDS = """
  SELECT k, n,
    CASE k % 4 WHEN 0 THEN 'CL' WHEN 1 THEN 'KR' WHEN 2 THEN 'AV' ELSE 'DG' END AS vt,
    1 + k % 40 AS vn,
    CASE WHEN k % 7 = 1 THEN 'A' WHEN k % 7 = 2 THEN 'B' END AS vl,
    CASE WHEN k % 9 = 4 THEN 1 + k % 5 END AS vs,
    k % 11 = 5 AS vb,
    CASE WHEN k % 13 = 6 THEN 'NORTE' WHEN k % 13 = 7 THEN 'OESTE' END AS vq,
    CASE WHEN k % 29 = 11 THEN NULL WHEN k % 17 = 3 THEN 'AV' WHEN k % 17 = 4 THEN 'KR' END AS ct,
    CASE WHEN k % 29 = 11 THEN NULL ELSE 1 + n END AS cn,
    CASE WHEN k % 19 = 8 THEN NULL ELSE 1 + (k * 7) % 99 END AS pl,
    CASE WHEN k % 19 <> 8 AND k % 23 = 9 THEN 'A' END AS pc,
    CASE k % 6 WHEN 1 THEN concat('AP ', 100 + k % 30) WHEN 2 THEN concat('AP ', 100 + k % 30, ' TO ', 1 + k % 3)
      WHEN 3 THEN CASE WHEN k % 19 = 8 THEN concat('SO ', 1 + k % 9) ELSE '8C' END WHEN 5 THEN concat('LT ', k % 9) ELSE '' END AS tail,
    CASE k % 6 WHEN 1 THEN concat('APTO 0', 100 + k % 30) WHEN 2 THEN concat('TORRE ', 1 + k % 3, ' AP ', 100 + k % 30)
      WHEN 3 THEN CASE WHEN k % 19 = 8 THEN concat('SO ', 1 + k % 9) ELSE '8 C' END WHEN 5 THEN concat('LOTE 0', k % 9) ELSE '' END AS tail_spelled,
    k % 6 = 3 AS opq,
    k % 31 AS defect
  FROM {keys}"""

_SPELL = """
  SELECT *,
    concat(vt, ' ', vn, coalesce(' ' || vl, ''), coalesce(' ' || vs, ''), CASE WHEN vb THEN ' BIS' ELSE '' END, coalesce(' ' || vq, ''), ' #',
      CASE WHEN cn IS NULL THEN '' ELSE concat(coalesce(' ' || ct, ''), ' ', cn) END,
      CASE WHEN pl IS NULL AND tail = '' THEN '' ELSE ' -' END,
      CASE WHEN pl IS NULL THEN '' ELSE concat(' ', lpad(CAST(pl AS STRING), 2, '0'), coalesce(pc, '')) END,
      CASE WHEN tail = '' THEN '' ELSE concat(' ', tail) END) AS canonical,
    concat(CASE vt WHEN 'CL' THEN CASE k % 3 WHEN 0 THEN 'CL' WHEN 1 THEN 'CALLE' ELSE 'CLL.' END
                   WHEN 'KR' THEN CASE k % 3 WHEN 0 THEN 'KR' WHEN 1 THEN 'CARRERA' ELSE 'CRA.' END
                   WHEN 'AV' THEN CASE k % 3 WHEN 0 THEN 'AV' WHEN 1 THEN 'AVENIDA' ELSE 'AVDA' END
                   ELSE CASE k % 3 WHEN 0 THEN 'DG' WHEN 1 THEN 'DIAGONAL' ELSE 'DIAG.' END END,
      ' ', CASE WHEN k % 8 = 3 THEN '00' ELSE '' END, vn, coalesce(' ' || vl, ''), coalesce(' ' || vs, ''),
      CASE WHEN vb THEN ' BIS' ELSE '' END, coalesce(' ' || vq, ''), ' # ',
      CASE WHEN cn IS NULL THEN '' ELSE concat(coalesce(ct || ' ', ''), cn) END,
      ' - ', CASE WHEN pl IS NULL THEN '' ELSE concat(CASE WHEN k % 5 = 1 THEN '0' ELSE '' END, pl, coalesce(' ' || pc, '')) END,
      ' ', tail_spelled) AS plain
  FROM {fields}"""

_RAW = """
  SELECT k, n, vt, vn, vl, vs, vb, vq, ct, cn, pl, pc, tail, opq, canonical, plain, defect BETWEEN 1 AND 5 AS bad,
    CASE defect WHEN 1 THEN concat(vt, ' ', vn, ' ', vn, ' ', vn)
      WHEN 2 THEN concat(vt, ' # ', vn, ' - 1')
      WHEN 3 THEN concat(plain, '; CL 1 # 2 - 3')
      WHEN 4 THEN concat('CL ', vn, ' # 2 - 3 NORTE')
      WHEN 5 THEN '   '
      ELSE CASE k % 10 WHEN 1 THEN lower(plain) WHEN 2 THEN replace(plain, ' # ', ' No. ') WHEN 3 THEN replace(plain, ' ', '  ')
        WHEN 4 THEN replace(replace(plain, ' # ', '#'), ' - ', '-') WHEN 5 THEN replace(plain, ' - ', ' – ') WHEN 6 THEN replace(plain, ' # ', ' Nº ')
        WHEN 7 THEN replace(plain, 'A', 'Á') ELSE plain END END AS raw,
    CASE defect WHEN 1 THEN 'falta_separador_hash' WHEN 2 THEN 'numero_via_faltante' WHEN 3 THEN 'multiples_direcciones'
      WHEN 4 THEN 'token_inesperado:NORTE' WHEN 5 THEN 'entrada_vacia' END AS note
  FROM {spelled}"""

#: a record of the base: every customer, and every tenth again without its complement
_BASE_KEYS = "(SELECT c_custkey AS k, c_nationkey AS n FROM customer)"


def _address(keys: str) -> str:
    return _RAW.format(spelled=f"({_SPELL.format(fields='(' + _FIELDS.format(keys=keys) + ')')})")


BASE = f"""
SELECT k AS record_id, n, vt, vn, vl, vs, vb, vq, ct, cn, pl, pc, tail, opq, canonical, raw, note, bad FROM ({_address(_BASE_KEYS)}) b
UNION ALL
SELECT 10000000 + k, n, vt, vn, vl, vs, vb, vq, ct, cn, pl, pc, '', false,
  concat(vt, ' ', vn, coalesce(' ' || vl, ''), coalesce(' ' || vs, ''), CASE WHEN vb THEN ' BIS' ELSE '' END, coalesce(' ' || vq, ''), ' #',
    CASE WHEN cn IS NULL THEN '' ELSE concat(coalesce(' ' || ct, ''), ' ', cn) END, CASE WHEN pl IS NULL THEN '' ELSE concat(' - ', lpad(CAST(pl AS STRING), 2, '0'), coalesce(pc, '')) END),
  concat(vt, ' ', vn, coalesce(' ' || vl, ''), coalesce(' ' || vs, ''), CASE WHEN vb THEN ' BIS' ELSE '' END, coalesce(' ' || vq, ''), ' # ',
    CASE WHEN cn IS NULL THEN '' ELSE concat(coalesce(ct || ' ', ''), cn) END, ' - ', CASE WHEN pl IS NULL THEN '' ELSE concat(pl, coalesce(' ' || pc, '')) END), CAST(NULL AS STRING), false
FROM ({_address(_BASE_KEYS)}) c WHERE k % 10 = 0 AND NOT bad"""

#: a query: the order's customer's address, as it is or with one field changed
QUERIES = f"""
SELECT o_orderkey AS query_id, o_custkey AS own_id, vt, vn,
  CASE WHEN o_orderkey % 8 = 6 THEN 'C' ELSE vl END AS vl, vs, vb, vq,
  CASE WHEN o_orderkey % 8 = 7 AND cn IS NOT NULL THEN CASE WHEN ct IS NULL THEN 'CL' END ELSE ct END AS ct, cn,
  CASE WHEN o_orderkey % 8 = 5 THEN pl + 1 ELSE pl END AS pl, pc,
  CASE WHEN o_orderkey % 8 = 4 THEN '' ELSE tail END AS tail, CASE WHEN o_orderkey % 8 = 4 THEN false ELSE opq END AS opq, bad, note,
  CASE WHEN bad OR o_orderkey % 8 < 4 THEN raw ELSE
    concat(vt, ' ', vn, CASE WHEN o_orderkey % 8 = 6 THEN ' C' ELSE coalesce(' ' || vl, '') END, coalesce(' ' || vs, ''), CASE WHEN vb THEN ' BIS' ELSE '' END,
      coalesce(' ' || vq, ''), ' # ',
      CASE WHEN cn IS NULL THEN '' WHEN o_orderkey % 8 = 7 THEN concat(CASE WHEN ct IS NULL THEN 'CL ' ELSE '' END, cn) ELSE concat(coalesce(ct || ' ', ''), cn) END,
      ' - ', CASE WHEN pl IS NULL THEN '' ELSE concat(CASE WHEN o_orderkey % 8 = 5 THEN pl + 1 ELSE pl END, coalesce(' ' || pc, '')) END,
      CASE WHEN o_orderkey % 8 = 4 THEN '' ELSE concat(' ', tail) END) END AS raw
FROM orders JOIN ({_address(_BASE_KEYS)}) a ON a.k = o_custkey"""


def score_sql(a: str, b: str, tolerance: int = 0) -> tuple[str, str]:
    """(veto, score) of two aliased rows, computed from their fields."""
    differ = lambda f: f"{a}.{f} IS DISTINCT FROM {b}.{f}"
    soft = lambda f: f"CASE WHEN {a}.{f} IS NOT DISTINCT FROM {b}.{f} THEN CAST(1 AS DOUBLE) WHEN {a}.{f} IS NULL OR {b}.{f} IS NULL THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END"
    plate = f"({differ('pc')} OR (({a}.pl IS NULL) <> ({b}.pl IS NULL)) OR coalesce(abs({a}.pl - {b}.pl) > {tolerance}, false))"
    veto = f"({a}.bad OR {b}.bad OR {a}.vt <> {b}.vt OR {a}.vn <> {b}.vn OR {differ('cn')} OR {plate} OR ({a}.tail <> {b}.tail AND {a}.tail <> '' AND {b}.tail <> ''))"
    factors = [
        f"CASE WHEN {differ('pl')} THEN CAST(0.96 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END",
        f"CASE WHEN {a}.tail = {b}.tail THEN CAST(1 AS DOUBLE) WHEN {a}.opq OR {b}.opq THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.98 AS DOUBLE) END",
        soft("vl"), soft("vs"), soft("vq"),
        f"CASE WHEN {a}.vb <> {b}.vb THEN CAST(0.85 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END",
        f"CASE WHEN {a}.ct IS NOT DISTINCT FROM {b}.ct THEN CAST(1 AS DOUBLE) WHEN {a}.ct IS NULL OR {b}.ct IS NULL THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END",
    ]
    product = " * ".join(f"({f})" for f in factors)
    return veto, f"CASE WHEN {veto} THEN CAST(0 AS DOUBLE) ELSE round_even({product}, 4) END"


def block_sql(a: str, b: str, tolerance: int = 0) -> str:
    near = f"({a}.pl IS NOT DISTINCT FROM {b}.pl)" if tolerance == 0 else f"(({a}.pl IS NULL AND {b}.pl IS NULL) OR abs({a}.pl - {b}.pl) <= {tolerance})"
    return f"{a}.vt = {b}.vt AND {a}.vn = {b}.vn AND {a}.cn IS NOT DISTINCT FROM {b}.cn AND {near}"
