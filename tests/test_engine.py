import itertools
import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from test_parse import random_addresses

from streetlink.cli import compare, find, main, plain_report
from streetlink.operators import labels, pairs
from streetlink.operators.compare import InvalidThreshold, InvalidTolerance, match_pairs, match_parsed, rounded
from streetlink.operators.link import block_base, explain_links, index_stats, link, link_summary, parse_queries, write_base
from streetlink.operators.parse import parse
from streetlink.operators.transforms import TRANSFORMS, synthetic_positives
from streetlink.sources.csv_base import BaseFileError, read_base, read_rows
from streetlink.sources.files import json_lines, label_sheet, read_labels, read_pairs, read_scores, write_text
from streetlink.streaming.queries import stream_links
from streetlink.vocab import PENALTIES

A = "KR 1 # 9 - 80"
SCORES = [
    (A, "kr 1 #9-80", 1.0), (A, "KR 1 # 9 - 080", 1.0), (A, "KR 2 # 9 - 80", 0.0), (A, "KR 1 # - 80", 0.0), (A + " A", A, 0.0), (A, "KR 1 A # 9 - 80", 0.85),
    ("KR 1 A # 9 - 80", "KR 1 B # 9 - 80", 0.70), ("AV 15 OESTE # 9 OESTE - 137", "AV 15 # 9 - 137", 0.7225), ("CL 25 NORTE # AV 6 - 30", "CL 25 NORTE # 6 - 30", 0.97),
    ("CL 25 NORTE # AV 6 - 30", "CL 25 NORTE # KR 6 - 30", 0.70), ("CL 10 # 42 - 02 AP 501 TO 3", "CL 10 # 42 - 02", 0.98), ("CL 10 # 42 - 02 AP 501", "CL 10 # 42 - 02 AP 502", 0.0),
    ("K 49 E # 49 - 50 8 C LT 5", "K 49 E # 49 - 50", 0.85), ("KR 1 # 2 - 3 AP NORTE", "KR 1 # 2 - 3", 0.85), ("KR 41 E # 9 - 80", "KR 41 ESTE # 9 - 80", 0.7225), ("SIN DIRECCION", "SIN DIRECCION", 0.0), (None, A, 0.0),
]


def pair_frame(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")


def test_golden_scores_both_ways(spark):
    both = [(a, b) for a, b, _ in SCORES] + [(b, a) for a, b, _ in SCORES]
    got = [r.score for r in match_pairs(pair_frame(spark, both), "a", "b").orderBy("i").collect()]
    assert got == [s for _, _, s in SCORES] * 2


def test_tolerance_and_veto(spark):
    df = pair_frame(spark, [(A, "KR 1 # 9 - 82"), (A, "KR 2 # 9 - 80")])
    rows = match_pairs(df, "a", "b", 0.0, 2).orderBy("i").collect()
    assert (rows[0].score, rows[0].is_match) == (0.96, True)
    assert (rows[1].score, rows[1].is_match) == (0.0, False)  # a veto is no match even at threshold 0
    fast = match_pairs(df, "a", "b", 0.0, 2, detail=False).orderBy("i").collect()
    assert [(r.score, r.is_match) for r in fast] == [(0.96, True), (0.0, False)]


def test_reason_and_warnings(spark):
    rows = match_pairs(pair_frame(spark, [("KR 1 # 9", "KR 1 # 9 - AP 5"), ("x", A), ("KR 1 # 9 - 80 A", "KR 1 # 9 - 80 B"), ("KR 1 # -", "KR 1 #")]), "a", "b").orderBy("i").collect()
    assert rows[0].reason == "coincide; diferencias menores: complement" and rows[0].warnings == ["sin_placa"]
    assert rows[1].reason == "veto: dirección A no canónica (falta_separador_hash)" and rows[1].fields == []
    assert rows[2].reason == "veto: placa difiere (80A vs 80B)" and len(rows[2].fields) == 16
    assert rows[3].warnings == ["sin_placa", "sin_cruce"] and rows[3].reason == "coincidencia exacta"


def test_rounding_of_every_product(spark):
    soft = [1.0, 1.0 - PENALTIES["one_sided"], 1.0 - PENALTIES["conflict"]]
    products = set()
    for plate, comp, cross in itertools.product((1.0, 1.0 - 0.04), (1.0, 1.0 - 0.02, 1.0 - 0.15), (1.0, 1.0 - 0.03, 1.0 - 0.30)):
        for ones, twos in itertools.product(range(9), range(9)):
            if ones + twos <= 8:
                for bis in range(3):
                    p = plate * comp
                    for f in [soft[1]] * ones + [soft[2]] * twos + [0.85] * bis:
                        p *= f
                    products.add(p * cross)
    df = spark.createDataFrame([(p,) for p in products], "p double").withColumn("r", rounded(F.col("p")))
    assert [(r.p, r.r) for r in df.collect() if r.r != round(r.p, 4)] == []
    assert not any(0.85 < round(p, 4) < 0.9126 for p in products)


def test_settings(spark):
    df = pair_frame(spark, [(A, A)])
    for bad in (True, "x", math.nan, -0.1, 1.1):
        with pytest.raises(InvalidThreshold):
            match_pairs(df, "a", "b", bad)
    for bad in (True, 1.0, -1):
        with pytest.raises(InvalidTolerance):
            match_pairs(df, "a", "b", 0.9, bad)


BASE = [("p77", "KR 1 # 9 - 77"), ("p78", "KR 1 # 9 - 78"), ("p79", "KR 1 # 9 - 79"), ("p80", A), ("p80A", A + " A"), ("p81", "KR 1 # 9 - 81"), ("p82", "KR 1 # 9 - 82"), ("p83", "KR 1 # 9 - 83"), ("other", "KR 1 # 8 - 80"),
        ("bare", "KR 2 # 9"), ("dash", "KR 2 # 9 -"), ("lot", "KR 2 # 9 - LT 5"), ("plated", "KR 2 # 9 - 5"), ("bad", "nada"), ("dup", "KR 5 # 5 - 5 AP 1"), ("dup", "KR 5 # 5 - 5")]


def sides(spark, queries, base=BASE):
    b = spark.createDataFrame([(i, r, a) for i, (r, a) in enumerate(base)], "o int, rid string, addr string")
    q = spark.createDataFrame(list(enumerate(queries)), "qid int, addr string")
    return parse_queries(q, "qid", "addr"), block_base(b, "rid", "addr", "o")


def test_link_tolerance_ties_and_null_plates(spark):
    q, b = sides(spark, [A, A + " A", "KR 2 # 9", "KR 5 # 5 - 5", "nada", "KR 9 # 9 - 9"])
    got = {}
    for r in link(q, b, tolerance=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.record_id, r.score))
    assert got[0] == [("p80", 1.0), ("p78", 0.96), ("p79", 0.96), ("p81", 0.96), ("p82", 0.96)]
    assert got[1] == [("p80A", 1.0)] and got[2] == [("bare", 1.0), ("dash", 1.0), ("lot", 0.98)] and got[3] == [("dup", 1.0)]
    s = {r.query_id: r for r in link_summary(q, b, tolerance=2).collect()}
    assert s[2].ambiguous and s[2].alternatives == 2 and s[2].n_compared == 3 and s[0].n_compared == 6 and not s[0].ambiguous
    assert s[4].reason == "consulta no canónica (falta_separador_hash)" and s[5].reason == "sin candidatos sobre el umbral" and s[5].n_compared == 0
    assert {r.query_id: len(r.fields) for r in explain_links(q, link(q, b).filter("rank = 1")).collect()}[0] == 16


def test_block_cap(spark):
    base = [(f"a{i:02}", A) for i in range(20)] + [(f"b{i:02}", "KR 1 # 9 - 81") for i in range(20)]
    q, b = sides(spark, [A], base)
    s = link_summary(q, b, tolerance=1, max_block_scan=5).first()
    assert (s.n_compared, s.truncated, s.n_candidates) == (10, True, 10)
    with pytest.raises(ValueError):
        link(q, b, max_block_scan=0)


def test_link_equals_brute_force(spark):
    texts = random_addresses(250, seed=11)
    texts = [t.replace(" 1", " 2").replace("3", "2").replace("4", "2") for t in texts]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid int, addr string")
    q = b.filter("rid < 60")
    for tolerance in (0, 1, 100):
        got = link(parse_queries(q, "rid", "addr"), block_base(b, "rid", "addr"), 0.85, tolerance)
        every = parse(q.select(F.col("rid").alias("query_id"), "addr"), "addr", "x").crossJoin(parse(b.select("rid", F.col("addr").alias("t")), "t", "y"))
        want = match_parsed(every, "x", "y", 0.85, tolerance, detail=False).filter("is_match")
        assert sorted((r.query_id, r.record_id, r.score) for r in got.collect()) == sorted((r.query_id, r.rid, r.score) for r in want.collect())


def test_bucketed_base_and_stats(spark, tmp_path):
    q, b = sides(spark, [A])
    spark.sql("drop table if exists blocked_base")
    write_base(b, "blocked_base", 4)
    assert link(q, spark.table("blocked_base")).first().record_id == "p80"
    spark.sql("drop table blocked_base")
    raw = spark.createDataFrame(BASE, "rid string, addr string")
    assert index_stats(raw, "rid", "addr").first().asDict() == {"records": 14, "blocks": 11, "max_block_size": 3, "rejected": 1}


def test_the_first_address_of_a_record_wins_a_tie(spark):
    """Whatever the type of the ordinal: a record's addresses in two files, spread over partitions."""
    rows = [("p", f"KR 1 # 9 - 80 AP {n}" if n else A, ("b" if n % 2 else "a", n)) for n in range(8, -1, -1)] + [("q", "KR 1 # 9 - 80", ("a", 9))]
    for kind, ordinal in (("struct<file:string,line:long>", lambda o: o), ("long", lambda o: (o[0] == "b") * 100 + o[1])):
        base = spark.createDataFrame([(i, t, ordinal(o)) for i, t, o in rows], f"rid string, addr string, o {kind}").repartition(5)
        q = parse_queries(spark.createDataFrame([(1, A)], "id int, addr string"), "id", "addr")
        some = block_base(base.filter("addr like '%AP%'"), "rid", "addr", "o")
        got = link(q, some).collect()
        assert [(r.record_id, r["base"].complement[0].value) for r in got] == [("p", "2")], kind


def test_index_statistics_take_one_parse(spark):
    raw = spark.createDataFrame([*BASE, (None, A), ("p80", "nada"), ("p80", "CL 5 # 6 - 7")], "rid string, addr string")
    stats = index_stats(raw, "rid", "addr")
    assert stats.first().asDict() == {"records": 14, "blocks": 12, "max_block_size": 3, "rejected": 2}
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    assert index_stats(raw.limit(0), "rid", "addr").first().asDict() == {"records": 0, "blocks": 0, "max_block_size": 0, "rejected": 0}


def test_large_groups_give_pairs_within_reach(spark):
    rows = parse(spark.createDataFrame([(i, f"KR 1 # 9 - 80 AP {i}") for i in range(30)] + [(90, "CL 1 # 2 - 3"), (91, "CL 1 # 2 - 3")], "rid int, a string"), "a", "p")
    key = F.col("p.via_type")
    every = {(r.rid_a, r.rid_b) for r in pairs.group_pairs(rows, key).collect()}
    near = [(r.rid_a, r.rid_b) for r in pairs.group_pairs(rows, key, reach=4).collect()]
    assert set(near) < every and len(near) == len(set(near)) == 30 * 4 - 10 + 1 and (90, 91) in near
    assert {(r.rid_a, r.rid_b) for r in pairs.group_pairs(rows, key, reach=64).collect()} == every


def test_shares_and_turns_of_bins():
    for quota in range(0, 70):
        shares = pairs.bin_shares(quota)
        assert sum(shares) == quota and all(abs(s - quota * w / 6) < 1 for s, w in zip(shares, pairs.BIN_WEIGHTS))
    pool = [{"rid_a": i, "rid_b": i + 100, "addr_a": "x", "addr_b": "y", "score": [0.5, 0.8, 0.87, 0.92, 1.0][i % 5]} for i in range(50)]
    first = pairs.in_turn(pool, 12, 1)[:12]
    assert sorted(sum(x["score"] >= e for e in pairs.BIN_EDGES) for x in first) == [0, 0, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4]
    twice = [x | {"rid_a": 1} for x in pool] + [x | {"addr_a": "y", "rid_a": 900 + i} for i, x in enumerate(pool)]
    assert len(pairs.Claims().first(50, twice)) == 2  # one record twice, equal texts never


def test_stream_gives_the_links_of_a_batch(spark, tmp_path):
    spark.createDataFrame([(1, A), (2, "KR 2 # 9")], "qid int, addr string").write.parquet(f"{tmp_path}/q")
    _, b = sides(spark, [])
    stream = spark.readStream.schema("qid int, addr string").parquet(f"{tmp_path}/q")
    run = stream_links(stream, b, "qid", "addr").writeStream.format("memory").queryName("links_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(tuple, spark.table("links_out").collect())) == [(1, "p80", 1.0), (2, "bare", 1.0), (2, "dash", 1.0), (2, "lot", 0.98)]


def test_sampled_pairs_meet_their_quota(spark):
    rows = parse(spark.createDataFrame([(i, f"KR 1 # 9 - {i}") for i in range(1, 301)] + [(i, f"KR 2 # 9 - {i}") for i in range(301, 304)], "rid int, a string"), "a", "p").select("rid", "p")
    key = F.struct(F.col("p.via_number").alias("v"))
    got = pairs.sampled_group_pairs(rows, key, 500, 1).collect()
    assert 499 <= len(got) <= 502 and len({(r.rid_a, r.rid_b) for r in got}) == len(got) and all(r.rid_a < r.rid_b for r in got)
    assert pairs.group_pairs(rows, key).count() == 300 * 299 // 2 + 3


def test_candidates_and_files(spark, tmp_path):
    texts = [f"CL {1 + i % 4} # {3 + i // 4 % 3} - {10 + i // 12 % 3}{' AP 1' if i % 5 == 0 else ' A' if i % 7 == 0 else ''}" for i in range(200)] + ["CL 1 # 3 - 10 NORTE"]
    rows = parse(spark.createDataFrame(list(enumerate(texts)), "rid int, a string"), "a", "p")
    pools = pairs.with_scores(pairs.strata_pools(rows, "a", seed=3))
    scored = [r.asDict() | {"addr_a": r.p_a.raw, "addr_b": r.p_b.raw} for r in pools.collect()]
    chosen = pairs.select_candidates(scored, 12, seed=3)
    assert {c["stratum"] for c in chosen} >= {"complement_one_sided", "plate_letter", "adjacent_or_swap"}
    uses = [x for c in chosen for x in (c["rid_a"], c["rid_b"])]
    assert max(uses.count(u) for u in uses) <= 2 and chosen == pairs.select_candidates(scored, 12, seed=3)
    out = [{"pair_id": f"c{i}", "addr_a": c["addr_a"], "addr_b": c["addr_b"], "stratum": c["stratum"]} for i, c in enumerate(chosen)]
    digests = write_text({"candidates_to_label.jsonl": json_lines(out), "label_sheet.csv": label_sheet(out, 1)}, str(tmp_path))
    assert len(digests) == 2 and read_pairs(spark, str(tmp_path)).count() == len(out)
    sheet = read_labels(spark, f"{tmp_path}/label_sheet.csv")
    assert sheet.count() == len(out) and sheet.filter("same_door is not null").count() == 0
    write_text({"l.jsonl": '{"pair_id": "c0", "same_door": true}\n{"pair_id": "c1", "same_door": "No ", "same_unit": "NA"}\n', "s/matcher_scores_sidecar.jsonl".split("/")[1]: '{"pair_id": "c0", "score": 0.5}\n', "dup.csv": "PAIR_ID,same_door\na,yes\na,no\n"}, str(tmp_path))
    got = {r.pair_id: (r.door, r.unit) for r in read_labels(spark, f"{tmp_path}/l.jsonl").select("pair_id", labels.normal_label(F.col("same_door")).alias("door"), labels.normal_label(F.col("same_unit"), True).alias("unit")).collect()}
    assert got == {"c0": ("yes", None), "c1": ("no", "n/a")}
    assert read_scores(spark, str(tmp_path)).first().score == 0.5
    with pytest.raises(labels.LabelError):
        read_labels(spark, f"{tmp_path}/dup.csv")


def test_transforms_keep_the_numbers(spark):
    df = spark.createDataFrame([(f"{t} {i} # {i + 1} - {i + 2} AP {i}",) for i, t in enumerate(["CL", "KR", "AV", "DG", "TV"] * 8, 1)], "a string")
    rows = synthetic_positives(df, "a", seed=1).collect()
    assert {r.transform for r in rows} == set(TRANSFORMS) | {"combo"}
    assert all(r.addr_a != r.addr_b for r in rows) and len({r.pair_id for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, synthetic_positives(df, "a", seed=1).collect()))


def test_strict_csv():
    ok = lambda s, **k: list(read_rows(s.encode(), "ID", "ADDR", **k))
    assert ok('﻿"ID",ADDR,x\n1,"a,\nb",\n\n 2 ,c,,,\n3\n') == [("1", "a,\nb"), (" 2 ", "c"), ("3", None)]
    for bad in ('ID,ADDR\n1,"open\n2,b\n', 'ID,ADDR\n1,"a"b\n', "ID,ADDR\n1,a,b\n", "ID;ADDR\n1;a\n", ""):
        with pytest.raises(BaseFileError):
            ok(bad)
    with pytest.raises(BaseFileError):
        list(read_rows(b"ID,ADDR\n1,\xff\n", "ID", "ADDR"))
    assert list(read_rows("ID,ADDR\n1,ñ\n".encode("latin-1"), "ID", "ADDR", "latin-1")) == [("1", "ñ")]


def test_cli(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ID,ADDR\n" + "".join(f'{i},"{a}"\n' for i, a in BASE) + ',"KR 1 # 9 - 80"\n')
    out = find(A, str(tmp_path / "b.csv"), "ID", "ADDR", tolerance=2, top=2)
    assert [c["id"] for c in out["candidatos"]] == ["p80", "p78"] and out["n_candidatos"] == 5 and out["registros"] == 14 and out["rechazados"] == 1 and out["mejor"]["puntaje"] == 1.0
    assert read_base(spark, str(tmp_path / "b.csv"), "ID", "ADDR").count() == len(BASE)
    assert out["ids_vacios"] == 1 and len(out) == 17
    lines = plain_report(out).split("\n")
    assert lines[:4] == ["MATCH  candidatos=5  comparados=6  umbral=0.9", "consulta: KR 1 # 9 - 80", "base: 14 registros indexados, 1 rechazados, 1 sin id", "alternativas: 4"]
    assert lines[4].startswith("nota: otras parcelas") and lines[5:] == ["1. p80  puntaje=1.0000  KR 1 # 9 - 80", "2. p78  puntaje=0.9600  KR 1 # 9 - 78", "... y 3 candidatos más"]
    none = plain_report(find("nada", str(tmp_path / "b.csv"), "ID", "ADDR")).split("\n")
    assert none[0] == "SIN_COINCIDENCIA  candidatos=0  comparados=0  umbral=0.9" and none[3].startswith("motivo: consulta no canónica")
    cut = plain_report(find("KR 2 # 9", str(tmp_path / "b.csv"), "ID", "ADDR", max_block_scan=1))
    assert "  TRUNCADO" in cut and "--max-block-scan" in cut
    both = compare(A, "KR 1 # 9 - 080")
    assert both["match"] and json.dumps(both) and list(both)[:3] == ["match", "resultado", "score"]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "streetlink.cli", "compare", A, A, "--umbral", "2"], cwd=root, capture_output=True, text=True, timeout=100)
    assert done.returncode == 2 and "umbral" in done.stderr
