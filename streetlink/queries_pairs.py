"""Registered queries on pairs, variants, measurements and labels, and their SQL.

``GRID`` gives a dense base from customers' keys, so that groups, neighbours,
swaps and equal addresses all occur.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify, labels, measure, pairs, transforms, variants
from .operators.compare import score
from .operators.link import block_base, link, link_summary, parse_queries
from .operators.parse import parse
from .sources.tables import over
from .synthetic import BASE, QUERIES, score_sql

Query = Callable[[SparkSession, str], DataFrame]

GRID = """
SELECT rid, n, v, vt, vn, vl, vs, vb, vq, ct, cn, pl, pc, tail, opq, bad,
  CASE WHEN bad THEN concat(vt, ' ', vn, ' # ', cn, ' - ', pl, ' NORTE') ELSE
    concat(vt, ' ', vn, ' # ', coalesce(ct || ' ', ''), cn, CASE WHEN pl IS NULL THEN '' ELSE concat(' - ', pl, coalesce(' ' || pc, '')) END, CASE WHEN tail = '' THEN '' ELSE concat(' ', spelled) END) END AS raw
FROM (SELECT c_custkey AS rid, c_nationkey AS n, v, CASE WHEN v = 11 THEN 'KR' ELSE 'CL' END AS vt, 1 + c_custkey % 6 AS vn, CAST(NULL AS STRING) AS vl, CAST(NULL AS BIGINT) AS vs, false AS vb, CAST(NULL AS STRING) AS vq,
    CASE v WHEN 6 THEN 'AV' WHEN 7 THEN 'KR' END AS ct, 3 + CAST(floor(c_custkey / 6) AS BIGINT) % 4 AS cn,
    CASE WHEN v = 8 THEN NULL ELSE 10 + CAST(floor(c_custkey / 24) AS BIGINT) % 3 END AS pl, CASE v WHEN 4 THEN 'A' WHEN 5 THEN 'B' END AS pc,
    CASE v WHEN 1 THEN 'AP 101' WHEN 2 THEN 'AP 202' WHEN 3 THEN 'BLQ 3' WHEN 9 THEN '8C' WHEN 12 THEN 'AP 101 TO 2' ELSE '' END AS tail,
    CASE v WHEN 9 THEN '8 C' WHEN 1 THEN 'AP 101' WHEN 2 THEN 'AP 202' WHEN 3 THEN 'BLQ 3' WHEN 12 THEN 'AP 101 TO 2' ELSE '' END AS spelled, v = 9 AS opq, v = 10 AS bad
  FROM (SELECT c_custkey, c_nationkey, CAST(floor(c_custkey / 72) AS BIGINT) % 13 AS v FROM customer) c) d"""


def grid(spark: SparkSession, sf_dir: str, all_rows: bool = False) -> DataFrame:
    rows = parse(over(spark, sf_dir, GRID).select("rid", "raw"), "raw", "p")
    return rows if all_rows else rows.filter("p.parse_ok")


def _ids(make: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return make(grid(spark, sf_dir)).select("rid_a", "rid_b")


def same_face_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.false_links(grid(spark, sf_dir).select("rid", "p")).select("category", "n", "at_or_above")


_G = f"g AS (SELECT * FROM ({GRID}) WHERE NOT bad)"
_EQ = lambda *fs: " AND ".join(f"a.{f} IS NOT DISTINCT FROM b.{f}" for f in fs)
_VETO, _SCORE = score_sql("a", "b")
_CATEGORY = "CASE WHEN " + _EQ("pl", "pc") + " THEN CASE WHEN a.tail = b.tail THEN 'same_base_same_complement' WHEN a.tail = '' OR b.tail = '' THEN 'same_base_one_side_bare' ELSE 'same_base_complements_differ' END ELSE 'different_plate' END"
_FACES = f"WITH {_G} SELECT {_CATEGORY} AS category, count(*) AS n, count(CASE WHEN {_SCORE} >= 0.9 THEN 1 END) AS at_or_above FROM g a JOIN g b ON {_EQ('vt', 'vn', 'ct', 'cn')} AND a.rid < b.rid GROUP BY 1"


def _pair_sql(on: str) -> str:
    return f"WITH {_G} SELECT a.rid AS rid_a, b.rid AS rid_b FROM g a JOIN g b ON {on}"


_ADJACENT = f"""WITH {_G}, p AS (SELECT *, row_number() OVER (PARTITION BY vt, vn, ct, cn, tail ORDER BY pl, rid) AS place FROM g WHERE pl IS NOT NULL)
  SELECT a.rid AS rid_a, b.rid AS rid_b FROM p a JOIN p b ON {_EQ('vt', 'vn', 'ct', 'cn', 'tail')} AND b.place > a.place AND b.place <= a.place + 11 AND b.pl - a.pl BETWEEN 1 AND 2"""
_SWAP = f"""WITH {_G}, p AS (SELECT *, row_number() OVER (PARTITION BY vn, cn, pl ORDER BY rid) AS place FROM g WHERE vn <> cn)
  SELECT a.rid AS rid_a, b.rid AS rid_b FROM p a JOIN p b ON a.vn = b.cn AND a.cn = b.vn AND {_EQ('pl')} AND a.vn < a.cn AND a.place <= 3 AND b.place <= 3"""


def _first_others_sql(on: str, left: str) -> str:
    return f"""WITH {_G} SELECT rid_a, rid_b FROM (SELECT a.rid AS rid_a, b.rid AS rid_b, row_number() OVER (PARTITION BY a.rid ORDER BY b.rid) AS place FROM g a JOIN g b ON {on} AND a.rid <> b.rid AND {left}) WHERE place <= 6"""


def truncated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.truncated_unparsed(grid(spark, sf_dir, True), "raw", cap=None).select("rid_a", "rid_b")


_TRUNCATED = f"WITH g AS ({GRID}) SELECT a.rid AS rid_a, b.rid AS rid_b FROM g a JOIN g b ON a.bad AND a.vt = b.vt AND a.vn = b.vn AND a.rid <> b.rid"


def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = pairs.strata_pools(grid(spark, sf_dir, True), "raw", seed=1)
    return pairs.with_scores(pools).groupBy("stratum", "subtype").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.9).alias("at_or_above"))


def _near_sql(keys: tuple[str, ...], on: str) -> str:
    """Pairs of a group that are at most 64 places apart in the order of a hash."""
    placed = f"(SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY md5(concat('0:', rid)), rid) AS place FROM g)"
    return f"SELECT a.rid AS rid_a, b.rid AS rid_b FROM {placed} a JOIN {placed} b ON {_EQ(*keys)} AND b.place - a.place BETWEEN 1 AND 64 AND {on}"


def _strata_sql() -> str:
    bare = lambda sql: "SELECT rid_a, rid_b FROM (" + sql + ")"
    base, cut_at = ("vt", "vn", "ct", "cn", "pl", "pc"), "(SELECT *, row_number() OVER (PARTITION BY vt, vn ORDER BY md5(concat('1:', rid)), rid) AS place FROM every_row)"
    pools = [
        ("complement_one_sided", "all", 4000, _near_sql(base, "(a.tail = '') <> (b.tail = '')")),
        ("cross_type_presence", "all", 4000, _near_sql(("vt", "vn", "cn", "pl", "pc", "tail"), "(a.ct IS NULL) <> (b.ct IS NULL)")),
        ("plate_letter", "all", 4000, _near_sql(("vt", "vn", "ct", "cn", "tail", "pl"), "a.pl IS NOT NULL AND a.pc IS DISTINCT FROM b.pc")),
        ("adjacent_or_swap", "adjacent_plate", 2000, bare(_ADJACENT)),
        ("adjacent_or_swap", "via_number_swap", 2000, bare(_SWAP)),
        ("same_base_diff_complement", "all", 4000, _near_sql(base, "a.tail <> '' AND b.tail <> '' AND a.tail <> b.tail")),
        ("opaque_or_degenerate", "missing_plate", 1333, bare(_first_others_sql(_EQ("vt", "vn", "cn"), "a.pl IS NULL"))),
        ("opaque_or_degenerate", "opaque_complement", 1333, bare(_first_others_sql(_EQ(*base), "a.opq"))),
        ("opaque_or_degenerate", "truncated_unparsed", 1333, f"SELECT a.rid AS rid_a, b.rid AS rid_b FROM {cut_at} a JOIN {cut_at} b ON a.bad AND a.vt = b.vt AND a.vn = b.vn AND a.rid <> b.rid AND b.place <= CASE WHEN a.place <= 6 THEN 7 ELSE 6 END"),
    ]
    every = " UNION ALL ".join(f"SELECT DISTINCT '{stratum}' AS stratum, '{subtype}' AS subtype, {cap} AS cap, least(rid_a, rid_b) AS lo, greatest(rid_a, rid_b) AS hi FROM ({sql})" for stratum, subtype, cap, sql in pools)
    return f"""WITH every_row AS ({GRID}), {_G}, drawn AS (SELECT *, row_number() OVER (PARTITION BY stratum, subtype ORDER BY md5(concat_ws(':', '1', lo, hi)), lo, hi) AS r FROM ({every}))
      SELECT stratum, subtype, count(*) AS n, count(CASE WHEN {_SCORE} >= 0.9 THEN 1 END) AS at_or_above FROM drawn JOIN every_row a ON a.rid = lo JOIN every_row b ON b.rid = hi WHERE r <= cap GROUP BY 1, 2"""


def ambiguity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.ambiguity(grid(spark, sf_dir).select("rid", "p"))


_AMBIGUITY = f"""WITH {_G}, c AS (SELECT raw, count(*) AS n FROM g GROUP BY raw HAVING count(*) > 1),
  parts AS (SELECT vt, vn, ct, cn, pl, pc, tail, count(*) AS k FROM g GROUP BY ALL),
  bases AS (SELECT vt, vn, ct, cn, pl, pc, sum(k) AS m, count(*) AS variants, sum(k * (k - 1) // 2) AS same, sum(CASE WHEN tail = '' THEN k ELSE 0 END) AS b FROM parts GROUP BY vt, vn, ct, cn, pl, pc HAVING sum(k) > 1)
  SELECT (SELECT count(*) FROM c) AS groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c) AS rows_in_groups, (SELECT coalesce(max(n), 0) FROM c) AS largest_group,
    (SELECT CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) FROM c) AS equal_pairs, (SELECT count(*) FROM c WHERE n = 2) AS size_2, (SELECT count(*) FROM c WHERE n = 3) AS size_3, (SELECT count(*) FROM c WHERE n = 4) AS size_4, (SELECT count(*) FROM c WHERE n > 4) AS size_5_up,
    count(*) AS bases_with_rows, count(CASE WHEN variants > 1 THEN 1 END) AS bases_with_variants, CAST(coalesce(sum(same), 0) AS BIGINT) AS identical_pairs, CAST(coalesce(sum(b * (m - b)), 0) AS BIGINT) AS bare_pairs FROM bases"""


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.hard_negatives(grid(spark, sf_dir).select("rid", "p"))


_HARD = f"""WITH {_G}
  SELECT 'same_via_same_plate_other_cross' AS kind, count(*) AS n, count(CASE WHEN {_SCORE} >= 0.9 THEN 1 END) AS at_or_above FROM g a JOIN g b ON {_EQ('vt', 'vn', 'pl', 'pc')} AND a.rid < b.rid AND NOT ({_EQ('ct', 'cn')})
  UNION ALL SELECT 'same_cross_same_plate_other_via', count(*), count(CASE WHEN {_SCORE} >= 0.9 THEN 1 END) FROM g a JOIN g b ON {_EQ('ct', 'cn', 'pl', 'pc')} AND a.rid < b.rid AND NOT ({_EQ('vt', 'vn')})"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(variants.positive_variants(grid(spark, sf_dir), "raw", "p"), "variant", "again")


def _mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(variants.negative_mutations(grid(spark, sf_dir), "p"), "mutant", "again")


def positive_variants_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.variant_hits(_variants(spark, sf_dir), "p", "again")


_KINDS = {
    "lowercase": "true", "extra_whitespace": "true", "accent_marks": "true", "glued": "pc IS NOT NULL OR opq", "glued_type": "true", "hash_tight": "true", "hash_no_dot": "true", "hash_ordinal": "true",
    "plate_zero_pad": "pl IS NOT NULL", "alias_long": "true", "alias_dotted": "true", "complement_alias": "tail <> '' AND NOT opq", "complement_zero_pad": "tail <> ''", "complement_reorder": "v = 12",
}
_VARIANTS = f"WITH {_G} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, count(*) AS hit, CAST(0 AS BIGINT) AS unparseable FROM g WHERE {w} HAVING count(*) > 0" for k, w in _KINDS.items())

#: kind -> (where it applies, what comes of it)
_EDITS = {
    "via_number_plus1": ("true", "veto"), "via_number_minus1": ("vn > 1", "veto"), "cross_number_plus1": ("true", "veto"), "cross_number_minus1": ("true", "veto"), "via_type_change": ("true", "veto"),
    **{f"plate_{k}": ("pl IS NOT NULL", "veto") for k in ("plus1", "minus1", "plus2", "minus2")},
    **{f"{s}_{k}_add": ("true", "penalized") for s in ("via", "cross") for k in ("letter", "bis", "quadrant")},
    "complement_value_change": ("tail <> ''", "veto"), "complement_removed": ("tail <> '' AND NOT opq", "passed"), "complement_removed_opaque": ("opq", "penalized"), "complement_added": ("tail = ''", "passed"),
}


def mutation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.mutation_outcomes(_mutants(spark, sf_dir), "p", "again")


def _mutations_sql() -> str:
    one = lambda k, w, out: f"SELECT '{k}' AS kind, '{'match' if out == 'passed' else 'no_match'}' AS expected, count(*) AS n, {', '.join((f'count(*)' if out == o else 'CAST(0 AS BIGINT)') + f' AS {o}' for o in ('veto', 'penalized', 'passed'))}, count(*) AS as_designed FROM g WHERE {w} HAVING count(*) > 0"
    return f"WITH {_G} " + " UNION ALL ".join(one(k, w, out) for k, (w, out) in _EDITS.items())


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _variants(spark, sf_dir).select("p", "again", F.lit(True).alias("y"))
    return good.union(_mutants(spark, sf_dir).filter("expected = 'no_match'").select("p", "again", F.lit(False).alias("y")))


def threshold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.confusion(_labelled(spark, sf_dir), "p", "again", "y")


def _confusion_sql() -> str:
    total = lambda xs: " + ".join(f"(SELECT count(*) FROM g WHERE {w})" for w in xs) or "0"
    positives = total(_KINDS.values())
    negatives = total(w for w, out in _EDITS.values() if out != "passed")
    low = total(w for w, out in _EDITS.values() if out == "penalized")
    near1, near2 = total(["pl IS NOT NULL"] * 2), total(["pl IS NOT NULL"] * 4)
    fp = {(0.70, 0): low, (0.85, 0): low, (0.90, 1): near1, (0.90, 2): near2}
    rows = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, {tol} AS plate_tolerance, {positives} AS tp, {fp.get((t, tol), '0')} AS fp, CAST(0 AS BIGINT) AS fn, {negatives} AS neg" for t, tol in measure.CONFIGS)
    return f"WITH {_G}, c AS ({rows}) SELECT threshold, CAST(plate_tolerance AS INTEGER) AS plate_tolerance, tp, fp, fn, neg - fp AS tn, tp / (tp + fp) AS precision, CAST(1 AS DOUBLE) AS recall, 2 * (tp / (tp + fp)) * 1 / ((tp / (tp + fp)) + 1) AS f1 FROM c"


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import own_pairs

    scored = own_pairs(spark, sf_dir).select(F.pmod("query_id", F.lit(8)).alias("change"), score(F.col("a"), F.col("b")).alias("score"))
    return measure.score_summary(scored, ["change"]).drop("mean_score").join(scored.groupBy("change", pairs.score_bin(F.col("score")).alias("bin")).count().groupBy("change").agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("commonest_bin")), "change")


def _histogram_sql() -> str:
    _, s = score_sql("q", "b")
    return f"""WITH x AS (SELECT q.query_id % 8 AS change, {s} AS score FROM ({QUERIES}) q JOIN orders o ON o.o_orderkey = q.query_id JOIN ({BASE}) b ON b.record_id = o.o_custkey),
      y AS (SELECT *, CASE WHEN score >= 0.95 THEN 4 WHEN score >= 0.9 THEN 3 WHEN score >= 0.85 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END AS bin FROM x),
      z AS (SELECT change, bin, row_number() OVER (PARTITION BY change ORDER BY count(*) DESC, bin) AS place FROM y GROUP BY change, bin)
      SELECT x.change, count(*) AS n, min(score) AS min_score, max(score) AS max_score, count(CASE WHEN score <= 0 THEN 1 END) AS bin_zero, count(CASE WHEN score > 0 AND score < 0.9 THEN 1 END) AS bin_low,
        count(CASE WHEN score >= 0.9 AND score < 1 THEN 1 END) AS bin_high, count(CASE WHEN score >= 1 THEN 1 END) AS bin_one, CAST(max(z.bin) AS INTEGER) AS commonest_bin FROM x JOIN z ON z.change = x.change AND z.place = 1 GROUP BY x.change"""


_SHAPES = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('Cra ', c_custkey % 40, 'X # ', c_nationkey, ' - ', c_custkey % 99, ' zona', c_custkey % 7)
  WHEN 1 THEN concat('km ', c_custkey % 40, '  vía ', c_nationkey, ', apto ', c_custkey % 9) ELSE '   ' END AS raw FROM customer"""


def shape_signature_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = over(spark, sf_dir, _SHAPES).select(classify.shape_signature(F.col("raw")).alias("shape"))
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape").limit(25)


_SHAPES_SQL = "SELECT CASE c_custkey % 3 WHEN 0 THEN 'CRA 9A # 9 - 9 A9' WHEN 1 THEN 'A 9 A 9, APTO 9' ELSE '' END AS shape, count(*) AS n FROM customer GROUP BY 1"

_CAUSES = {
    "KR 5 X Y # 9 - 8": "via_two_letters", "KR 5 4 3 # 9 - 8": "via_unexpected_token", "KR 5 # 9 X Y - 8": "cross_two_letters", "KR 5 # 9 8 7": "no_plate_separator", "KR 5 # 9 8 7 - 1": "cross_unexpected_token",
    "KR 5 # 9 - 12345678": "plate_too_long", "KR 5 # 9 - 8 CL 5": "tail_via_type_then_number", "KR 5 # 9 - 8 " + "A" * 41: "tail_too_long", "KR 5 # 9 # 8 - 1": "multiple_addresses",
    "KR # 9 - 8": "via_number_missing", "CL 5 9 8": "no_hash_separator", "KR 5 # 9 - 8 SUR": "tail_unexpected_token", "KR 5 # 9 - 8": "parses_ok", " ": "empty_or_non_text",
}


def _cases(values) -> str:
    return f"CASE c_custkey % {len(_CAUSES)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, f"SELECT c_custkey AS id, {_cases(_CAUSES)} AS raw FROM customer")
    return classify.failure_causes(rows, "raw").groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, GRID).select("rid", "raw", F.concat("raw", F.lit("\x1f"), F.col("n").cast("string")).alias("x"))
    return rows.select("rid", classify.pair_id("cand", F.col("x"), F.concat(F.lit("CL 1 # 2 - 3\x1f"), F.col("rid").cast("string"))).alias("pair_id"))


_PAIR_IDS = f"""SELECT rid, 'cand-' || substr(sha1('cand' || chr(30) || least(x, y) || chr(30) || greatest(x, y)), 1, 12) AS pair_id FROM
  (SELECT rid, raw || chr(31) || n AS x, 'CL 1 # 2 - 3' || chr(31) || rid AS y FROM ({GRID}))"""


def split_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, GRID).select("rid", classify.split_address(F.col("raw")).alias("s"))
    return rows.select("rid", "s.via_type", "s.via", "s.cross", "s.plate", "s.complement")


_SPLIT = f"""SELECT rid, CASE WHEN ok THEN vt END AS via_type, CASE WHEN ok THEN CAST(vn AS VARCHAR) END AS via, CASE WHEN ok THEN coalesce(ct || ' ', '') || cn END AS "cross", CASE WHEN ok THEN CAST(pl AS VARCHAR) END AS plate,
  CASE WHEN ok THEN CASE WHEN bad THEN 'NORTE' WHEN pc IS NOT NULL THEN pc WHEN opq THEN '8 C' ELSE tail END END AS complement FROM (SELECT *, pl IS NOT NULL AS ok FROM ({GRID}))"""

_LABELS = """SELECT doc_id, 'p' || doc_id AS pair_id, CASE WHEN doc_id % 5 = 4 THEN 'synthetic' ELSE 'candidate' END AS kind, CASE WHEN doc_id % 5 = 4 THEN 'synthetic' ELSE 'g' || (doc_id % 3) END AS grp,
  CASE WHEN doc_id % 5 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'lowercase' ELSE 'novel_type_alias' END END AS transform, CASE WHEN doc_id % 5 = 4 THEN 'yes' END AS builtin,
  concat('CL ', 1 + doc_id % 40, ' # 5 - 10') AS addr_a,
  concat('calle ', 1 + doc_id % 40, CASE WHEN doc_id % 4 = 3 THEN ' A' ELSE '' END, ' # 5 - ', CASE WHEN doc_id % 4 = 1 THEN 11 ELSE 10 END, CASE WHEN doc_id % 4 = 2 THEN ' AP 5' ELSE '' END) AS addr_b,
  CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'maybe' WHEN 2 THEN 'unsure' ELSE CASE WHEN quality = 1 THEN ' YES ' ELSE 'no' END END AS same_door,
  CASE WHEN toxic = 1 THEN 'no' ELSE CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'N/A' ELSE 'perhaps' END END AS same_unit, doc_id % 7 = 0 AS frozen FROM labels"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _LABELS)
    both = parse(parse(rows.select("pair_id", "kind", "grp", "transform", "builtin", "addr_a", "addr_b"), "addr_a", "a"), "addr_b", "b")
    frozen = rows.filter("frozen").select("pair_id", F.lit(0.95).alias("score"))
    return labels.merge_labels(both, rows.select("pair_id", "same_door", "same_unit"), frozen, score(F.col("a"), F.col("b")))


def labels_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_buckets(_merged(spark, sf_dir))


def labels_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_coverage(_merged(spark, sf_dir))


_MERGED = f"""m AS (SELECT *, CASE WHEN frozen THEN 0.95 ELSE CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.98 ELSE 0.85 END END AS score, builtin IS NULL AS human,
    coalesce(builtin, CASE same_door WHEN ' YES ' THEN 'yes' WHEN 'no' THEN 'no' WHEN 'unsure' THEN 'unsure' END) AS label, lower(same_unit) AS unit FROM ({_LABELS}))"""
_LABELS_EVAL = f"""WITH {_MERGED}, u AS (SELECT * FROM m WHERE human AND label = 'yes' AND unit IN ('yes', 'no')), d AS (SELECT * FROM m WHERE label IN ('yes', 'no')),
  r AS (SELECT 'door' AS section, 'overall' AS bucket, label AS y, score FROM d UNION ALL SELECT 'door', grp, label, score FROM d UNION ALL SELECT 'door', 'human', label, score FROM d WHERE human
    UNION ALL SELECT 'transform', transform, label, score FROM d WHERE transform IS NOT NULL UNION ALL SELECT 'split', CASE WHEN transform LIKE 'novel%' THEN 'novel' ELSE 'known_vocab' END, label, score FROM d WHERE transform IS NOT NULL
    UNION ALL SELECT 'unit', 'unit_overall', unit, score FROM u UNION ALL SELECT 'unit', grp, unit, score FROM u),
  c AS (SELECT section, bucket, count(CASE WHEN y = 'yes' AND score >= 0.9 THEN 1 END) AS tp, count(CASE WHEN y <> 'yes' AND score >= 0.9 THEN 1 END) AS fp, count(CASE WHEN y = 'yes' AND score < 0.9 THEN 1 END) AS fn, count(CASE WHEN y <> 'yes' AND score < 0.9 THEN 1 END) AS tn FROM r GROUP BY section, bucket),
  q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c)
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM q"""
_LABELS_COVERAGE = f"""WITH {_MERGED}, h AS (SELECT *, label IN ('yes', 'no') AND label IS NOT NULL AS decided FROM m WHERE human)
  SELECT count(*) AS human_pairs, count(CASE WHEN decided THEN 1 END) AS labeled, count(CASE WHEN label = 'unsure' THEN 1 END) AS unsure, count(CASE WHEN label IS NULL AND same_door = '' THEN 1 END) AS blank, count(CASE WHEN label IS NULL AND same_door = 'maybe' THEN 1 END) AS invalid,
    CASE WHEN count(*) > 0 THEN 100.0 * count(CASE WHEN decided THEN 1 END) / count(*) END AS coverage_pct, count(CASE WHEN decided AND unit = 'perhaps' THEN 1 END) AS unit_invalid,
    count(CASE WHEN label = 'no' AND unit IN ('yes', 'no', 'unsure') THEN 1 END) AS unit_ignored, count(CASE WHEN label = 'yes' AND unit = 'yes' THEN 1 END) AS unit_yes, count(CASE WHEN label = 'yes' AND unit = 'no' THEN 1 END) AS unit_no,
    count(CASE WHEN label = 'yes' AND unit = 'unsure' THEN 1 END) AS unit_unsure, count(CASE WHEN label = 'yes' AND unit = 'n/a' THEN 1 END) AS unit_na FROM h"""


def link_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import base_rows, query_rows

    q, b = parse_queries(query_rows(spark, sf_dir), "query_id", "raw"), block_base(base_rows(spark, sf_dir), "record_id", "raw")
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("own_id"))
    return measure.link_quality(link_summary(q, b), link(q, b), own)


def _link_quality_sql() -> str:
    from .queries import _summary_sql

    veto, s = score_sql("q", "b")
    return f"""WITH summary AS ({_summary_sql(0.9)}), own AS (SELECT q.query_id, o.o_custkey AS own_id, CASE WHEN NOT {veto} AND {s} >= 0.9 THEN {s} END AS own_score
        FROM ({QUERIES}) q JOIN orders o ON o.o_orderkey = q.query_id JOIN ({BASE}) b ON b.record_id = o.o_custkey),
      x AS (SELECT *, best_id IS NOT NULL AND best_id = own_id AS first, ambiguous AND coalesce(own_score = best_score, false) AS tied FROM summary JOIN own USING (query_id))
      SELECT count(*) AS n, count(CASE WHEN first THEN 1 END) AS top1_correct, count(CASE WHEN own_score IS NULL THEN 1 END) AS own_missing, count(CASE WHEN ambiguous THEN 1 END) AS ambiguous, count(CASE WHEN best_id IS NULL THEN 1 END) AS no_best,
        count(CASE WHEN best_id IS NOT NULL AND NOT first AND tied THEN 1 END) AS tie_wrong_first, count(CASE WHEN best_id IS NOT NULL AND NOT first AND NOT tied THEN 1 END) AS false_best, count(CASE WHEN NOT parse_ok THEN 1 END) AS unparseable_queries,
        avg(n_candidates) AS avg_candidates, avg(n_compared) AS avg_compared, max(n_candidates) AS max_candidates, max(n_compared) AS max_compared FROM x"""


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.sample_rows(over(spark, sf_dir, GRID).select("rid", "raw"), "rid", 100, seed=42)


def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = pairs.sampled_group_pairs(grid(spark, sf_dir).select("rid", "p"), measure.face_key(), 2000, seed=42)
    return drawn.select("rid_a", "rid_b", classify.classify_pair(F.col("p_a"), F.col("p_b")).alias("category"))


_HASH_SAMPLE = f"SELECT rid, raw FROM (SELECT rid, raw FROM ({GRID}) ORDER BY md5('42:' || rid), rid LIMIT 100)"
_SAMPLED = f"""WITH {_G}, k AS (SELECT *, count(*) OVER (PARTITION BY vt, vn, ct, cn) AS m, row_number() OVER (PARTITION BY vt, vn, ct, cn ORDER BY md5('42:' || rid), rid) AS place FROM g),
  t AS (SELECT CAST(sum((m - 1) / 2.0) AS DOUBLE) AS total FROM k),
  q AS (SELECT k.*, total, CASE WHEN total <= 2000 THEN m * (m - 1) // 2 ELSE least(m * (m - 1) // 2, greatest(1, CAST(round((m * (m - 1) // 2) * (2000 / total)) AS BIGINT))) END AS quota FROM k, t WHERE m > 1),
  r AS (SELECT *, CASE WHEN total <= 2000 THEN m - 1 ELSE least(m - 1, CAST(ceil(2.0 * quota / m) AS BIGINT) + 1) END AS reach FROM q),
  d AS (SELECT a.rid AS r1, b.rid AS r2, a.quota, row_number() OVER (PARTITION BY a.vt, a.vn, a.ct, a.cn ORDER BY md5('42:' || a.rid || ':' || b.rid), a.rid, b.rid) AS r
    FROM r a JOIN r b ON {_EQ('vt', 'vn', 'ct', 'cn')} AND b.place > a.place AND b.place <= a.place + a.reach),
  p AS (SELECT least(r1, r2) AS lo, greatest(r1, r2) AS hi FROM d WHERE r <= quota)
  SELECT lo AS rid_a, hi AS rid_b, {_CATEGORY} AS category FROM p JOIN g a ON a.rid = lo JOIN g b ON b.rid = hi"""
_NEGATIVES = f"""WITH d AS (SELECT rid, raw, n, row_number() OVER (ORDER BY md5('20260926:' || rid), rid) AS place FROM ({GRID}) WHERE trim(raw) <> ''),
  s AS (SELECT * FROM d WHERE place <= 20 * 30 + 100)
  SELECT rid_a, rid_b, raw_a, raw_b FROM (SELECT a.rid AS rid_a, b.rid AS rid_b, a.raw AS raw_a, b.raw AS raw_b, row_number() OVER (ORDER BY a.place) AS r
    FROM s a JOIN s b ON b.place = a.place + 1 AND a.n IS DISTINCT FROM b.n AND a.raw <> b.raw) WHERE r <= 30"""


def symmetry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = pairs.consecutive_pairs(grid(spark, sf_dir).select("rid", "p"), seed=42).select(F.col("p_a").alias("p"), F.col("p_b").alias("again"))
    changed = _mutants(spark, sf_dir).select("p", "again")
    return measure.symmetry(drawn.union(changed), "p", "again").select("violations")


def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, GRID).select("rid", "raw", "n")
    return pairs.random_negatives(rows, "n", "raw", 30, seed=20260926).select("rid_a", "rid_b", "raw_a", "raw_b")


def transform_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transformed spellings of each kind still match, by kind."""
    rows = transforms.synthetic_positives(over(spark, sf_dir, GRID).filter("not bad").select("raw").distinct(), "raw", seed=20260926)
    both = parse(parse(rows, "addr_a", "a"), "addr_b", "b").withColumn("score", score(F.col("a"), F.col("b")))
    return both.groupBy("transform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.9).alias("hit"))


def evaluation_self_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(F.col("p"), F.col("p"))
    return grid(spark, sf_dir, True).select(s.alias("s"), "p").agg(F.count_if("p.parse_ok").alias("n"), F.count_if(F.col("p.parse_ok") & (F.col("s") != 1)).alias("violations"), F.count_if(~F.col("p.parse_ok") & (F.col("s") != 0)).alias("unparsed_above_zero"))


def coverage_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import base_rows

    return measure.coverage(parse(base_rows(spark, sf_dir), "raw", "p"), "raw")["causes"].select("cause", "n", F.size("examples").alias("n_examples"))


_COVERAGE = f"""SELECT cause, count(*) AS n, CAST(least(count(*), 5) AS INTEGER) AS n_examples FROM (SELECT CASE note WHEN 'falta_separador_hash' THEN 'no_hash_separator' WHEN 'numero_via_faltante' THEN 'via_number_missing' WHEN 'multiples_direcciones' THEN 'multiple_addresses'
  WHEN 'token_inesperado:NORTE' THEN 'tail_unexpected_token' ELSE 'empty_or_non_text' END AS cause FROM ({BASE}) WHERE bad) GROUP BY cause"""


def queries() -> dict[str, Query]:
    return {
        "same_face_pairs": same_face_pairs,
        "adjacent_plates": partial(_ids, pairs.adjacent_plates), "via_cross_swap": partial(_ids, pairs.via_number_swap), "plate_letter_pairs": partial(_ids, pairs.plate_letter), "cross_type_pairs": partial(_ids, pairs.cross_type_presence),
        "complement_one_sided_pairs": partial(_ids, pairs.complement_one_sided), "diff_complement_pairs": partial(_ids, pairs.same_base_diff_complement),
        "missing_plate_pairs": partial(_ids, pairs.missing_plate), "opaque_pairs": partial(_ids, pairs.opaque_complement), "truncated_pairs": truncated_pairs, "strata_counts": strata_counts,
        "ambiguity_groups": ambiguity_groups, "hard_negatives": hard_negatives, "positive_variants_recall": positive_variants_recall, "mutation_outcomes": mutation_outcomes,
        "threshold_confusion": threshold_confusion, "score_histogram": score_histogram, "shape_signature_top": shape_signature_top, "failure_causes": failure_causes, "coverage_causes": coverage_causes,
        "pair_ids": pair_ids, "split_addresses": split_addresses, "labels_eval": labels_eval, "labels_coverage": labels_coverage, "link_quality": link_quality,
        "hash_sample": hash_sample, "sampled_pairs": sampled_pairs, "symmetry_check": symmetry_check, "self_match": evaluation_self_match, "random_negatives": random_negatives, "transform_matches": transform_matches,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "same_face_pairs": _FACES, "adjacent_plates": _ADJACENT, "via_cross_swap": _SWAP,
        "plate_letter_pairs": _pair_sql(f"{_EQ('vt', 'vn', 'ct', 'cn', 'tail')} AND a.pl = b.pl AND a.pc IS DISTINCT FROM b.pc AND a.rid < b.rid"),
        "cross_type_pairs": _pair_sql(f"{_EQ('vt', 'vn', 'cn', 'pl', 'pc', 'tail')} AND (a.ct IS NULL) <> (b.ct IS NULL) AND a.rid < b.rid"),
        "complement_one_sided_pairs": _pair_sql(f"{_EQ('vt', 'vn', 'ct', 'cn', 'pl', 'pc')} AND (a.tail = '') <> (b.tail = '') AND a.rid < b.rid"),
        "diff_complement_pairs": _pair_sql(f"{_EQ('vt', 'vn', 'ct', 'cn', 'pl', 'pc')} AND a.tail <> '' AND b.tail <> '' AND a.tail <> b.tail AND a.rid < b.rid"),
        "missing_plate_pairs": _first_others_sql(_EQ("vt", "vn", "cn"), "a.pl IS NULL"), "opaque_pairs": _first_others_sql(_EQ("vt", "vn", "ct", "cn", "pl", "pc"), "a.opq"), "truncated_pairs": _TRUNCATED, "strata_counts": _strata_sql(),
        "ambiguity_groups": _AMBIGUITY, "hard_negatives": _HARD, "positive_variants_recall": _VARIANTS, "mutation_outcomes": _mutations_sql(), "threshold_confusion": _confusion_sql(),
        "score_histogram": _histogram_sql(), "shape_signature_top": _SHAPES_SQL, "failure_causes": f"SELECT {_cases(_CAUSES.values())} AS cause, count(*) AS n FROM customer GROUP BY 1", "coverage_causes": _COVERAGE,
        "pair_ids": _PAIR_IDS, "split_addresses": _SPLIT, "labels_eval": _LABELS_EVAL, "labels_coverage": _LABELS_COVERAGE, "link_quality": _link_quality_sql(),
        "hash_sample": _HASH_SAMPLE, "sampled_pairs": _SAMPLED, "random_negatives": _NEGATIVES,
        "symmetry_check": "SELECT CAST(0 AS BIGINT) AS violations", "self_match": f"SELECT count(CASE WHEN NOT bad THEN 1 END) AS n, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS unparsed_above_zero FROM ({GRID})",
    }


__all__ = ["Column", "queries", "oracle_sql"]
