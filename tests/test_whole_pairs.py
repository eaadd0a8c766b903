"""Pairs of large groups: all of them, with results that do not need a row for each."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from streetlink import queries_pairs
from streetlink.operators import classify, measure, pairs
from streetlink.operators.compare import score
from streetlink.operators.parse import parse


def test_unparsed_with_all_others(spark):
    texts = ["CL 1 # 2 - 3 NORTE", "CL 1 # 2 - 3", "CL 1 # 9 - 9", "CL 1 # 4 - 5 NORTE", "KR 1 # 2 - 3", "CL 1", "CL 1 # 2 - 3"]
    rows = parse(spark.createDataFrame([*enumerate(texts), (0, "CL 1 # 7 - 7")], "rid bigint, raw string"), "raw", "p")
    got = [(r.rid_a, r.rid_b) for r in pairs.truncated_unparsed(rows, "raw", cap=None).collect()]
    assert sorted(got) == sorted([(0, b) for b in (1, 2, 3, 6)] + [(3, b) for b in (0, 0, 1, 2, 6)])


def test_unparsed_with_all_others_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 5)
    monkeypatch.setattr(pairs, "BLOCK", {"a": 2, "b": 3})
    texts = [(None if i % 17 == 0 else i % 50, f"{'KR' if i % 7 == 0 else 'CL'} 1 # 2 - {i}{' NORTE' if i % 3 == 0 else ''}") for i in range(60)]
    rows = parse(spark.createDataFrame(texts, "rid bigint, raw string"), "raw", "p")
    told = [(r.rid, r.raw.split()[0], r.p) for r in rows.collect() if r.rid is not None]
    want = Counter(repr((x, p, y, q)) for x, g, p in told if not p.parse_ok for y, h, q in told if g == h and x != y)
    got = pairs.truncated_unparsed(rows, "raw", cap=None)
    assert got.columns == ["rid_a", "p_a", "rid_b", "p_b"]
    assert Counter(repr(tuple(r)) for r in got.collect()) == want and len(want) > 500


def test_unparsed_with_all_others_comes_in_few_ids(spark):
    """So that a file of pairs is small: any 5,000 rows that follow each other have few ids."""
    texts = spark.range(3000).selectExpr("id AS rid", "concat('CL 1 # 2 - 3', CASE WHEN id % 3 = 0 THEN ' NORTE' ELSE '' END) AS raw")
    got = pairs.truncated_unparsed(parse(texts, "raw", "p"), "raw", cap=None).select("rid_a", "rid_b")
    near = got.groupBy(F.floor(F.monotonically_increasing_id() / 5000).alias("at")).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(x).alias(x) for x in ("rid_a", "rid_b")]).collect()
    assert sum(r.n for r in near) == 1000 * 2999
    assert max(max(r.rid_a, r.rid_b) for r in near) <= 400


def test_truncated_pairs_have_no_cap(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(pairs, "truncated_unparsed", lambda rows, column, cap: asked.update(cap=cap) or rows.select(F.col("rid").alias("rid_a"), F.col("rid").alias("rid_b")))
    queries_pairs.truncated_pairs(spark, "/root/testdata/sf0.001")
    assert asked == {"cap": None}


KINDS = ["CL 1 # 2 - 10", "calle 1 # 2 - 10", "CL 1 # AV 2 - 10", "CL 1 # 2 - 10 AP 5", "CL 1 # 2 - 10 AP 6", "CL 1 # 3 - 10", "KR 1 # 2 - 10", "CL 1 # 2 - 11", "CL 1 # 2", "CL 1 # 2 - 010", "CL 1 # 2 - 10 8C"]


def _records(spark):
    """Copies, rows of one rid, rows without rid, parcels in common and unknown ones."""
    rows = [(i % 55 if i % 9 else None, KINDS[i * i % len(KINDS)] if i % 2 else KINDS[i % len(KINDS)], None if i % 4 == 0 else i % 5) for i in range(80)]
    return parse(spark.createDataFrame(rows, "rid bigint, raw string, parcel bigint"), "raw", "p").filter("p.parse_ok")


def _told(spark, rows, key):
    """(category, score, n) of the pairs of a group, one by one."""
    told = rows.select("rid", "parcel", "p", F.to_json(F.struct(key.alias("k")), {"ignoreNullFields": "false"}).alias("key"), key.isNotNull().alias("has")).collect()
    couples = [(a.p, b.p) for a, b in combinations(told, 2) if a.has and a.key == b.key and None not in (a.rid, b.rid) and a.rid != b.rid and (None in (a.parcel, b.parcel) or a.parcel != b.parcel)]
    df = spark.createDataFrame(couples, _couple(rows))
    return Counter((r.category, r.score) for r in df.select(classify.classify_pair(F.col("p_a"), F.col("p_b")).alias("category"), score(F.col("p_a"), F.col("p_b")).alias("score")).collect())


def _couple(rows):
    p = rows.schema["p"].dataType.simpleString()
    return f"p_a {p}, p_b {p}"


def _hard(spark, rows):
    want = {}
    for kind, side in (("same_via_same_plate_other_cross", "via"), ("same_cross_same_plate_other_via", "cross")):
        told = _told(spark, rows, F.struct(classify.signature(F.col("p"), side).alias("s"), classify.plate_key(F.col("p")).alias("k")))
        other = [(s, n) for (c, s), n in told.items() if c == "different_base_other"]
        want[kind] = (sum(n for _, n in other), sum(n for s, n in other if s >= 0.9))
    return want


def test_hard_negatives_equal_pairs_one_by_one(spark):
    rows = _records(spark)
    want = _hard(spark, rows)
    assert {r.kind: (r.n, r.at_or_above) for r in measure.hard_negatives(rows.select("rid", "p", "parcel")).collect()} == want
    assert all(n for n, _ in want.values())


def _copies(spark, n):
    """n rows of each of three addresses."""
    rows = parse(spark.createDataFrame([(i, t) for i, t in enumerate(("CL 1 # 2 - 10", "CL 1 # AV 2 - 10", "CL 1 # 2 - 10 AP 5"))], "k bigint, raw string"), "raw", "p")
    return spark.range(n).crossJoin(rows).select((F.col("id") * 3 + F.col("k")).alias("rid"), "p")


def test_hard_negatives_of_copies(spark):
    n = 100_000  # 45 billion pairs, one by one
    got = {r.kind: (r.n, r.at_or_above) for r in measure.hard_negatives(_copies(spark, n)).collect()}
    assert got == {"same_via_same_plate_other_cross": (2 * n * n, 2 * n * n)}


def test_same_face_pairs_equal_pairs_one_by_one(spark):
    rows = _records(spark)
    want = {}
    for (category, s), n in _told(spark, rows, measure.face_key()).items():
        m, high, total = want.get(category, (0, 0, 0.0))
        want[category] = (m + n, high + n * (s >= 0.9), round(total + n * s, 6))
    assert {r.category: (r.n, r.at_or_above, round(r.total_score, 6)) for r in measure.false_links(rows.select("rid", "p", "parcel")).collect()} == want
    assert len(want) == 4


def test_same_face_pairs_of_copies(spark):
    n = 100_000
    got = {r.category: (r.n, r.at_or_above) for r in measure.false_links(_copies(spark, n)).collect()}
    same = n * (n - 1) // 2
    assert got == {"same_base_same_complement": (3 * same, 3 * same), "same_base_one_side_bare": (n * n, n * n)}
