from pyspark.sql import functions as F

from streetlink.plans.runs import as_markdown, as_text, build_pairs, evaluate, score_labels
from streetlink.sources.files import read_labels, read_pairs, read_scores

TEXTS = [f"CL {1 + i % 4} # {3 + i // 4 % 3} - {10 + i // 12 % 3}{' AP 1' if i % 5 == 0 else ' A' if i % 7 == 0 else ''}" for i in range(120)] + ["CL 1 # 3 - 10 NORTE", "nada"]


def test_evaluation(spark):
    base = spark.createDataFrame([(i, t, f"n{i % 90}") for i, t in enumerate(TEXTS)], "rid long, address string, parcel string")
    said = []
    out = evaluate(base, sample=40, max_pairs=500, link_sample=20, timings=True, log=said.append)
    assert sorted(line[0] for line in said) == list("ABCDEFGH")
    assert out["G"]["parse"]["rows"] == 122 and out["G"]["link"]["rows"] == 20 and out["G"]["memory"]["driver_heap_used_mb"] > 0
    assert "== A totals (parse coverage)" in as_text(out) and "== G parse (throughput and memory)" in as_text(out)
    assert out["A"]["totals"][0] == {"total": 122, "parse_ok": 120, "parse_fail": 2}
    assert out["B"]["self_match"]["violations"] == out["B"]["symmetry"]["violations"] == 0
    assert all(r["n"] == r["hit"] for r in out["C"]) and all(r["n"] == r["as_designed"] for r in out["D"])
    assert out["H"]["exact"]["own_missing"] == 0 and out["H"]["exact"]["n"] == 20


def test_pairs_are_built_and_scored(spark, tmp_path):
    rows = [(i, t, f"n{i}", f"m{i % 3}", f"c{i % 5}", None) for i, t in enumerate(TEXTS)]
    records = spark.createDataFrame(rows, "rid long, direccion string, npn string, manzana string, comuna string, barrio string")
    made = build_pairs(records, f"{tmp_path}/out", f"{tmp_path}/private", n_synthetic=34, per_stratum=6, n_sanity=5)
    assert made["counts"]["negatives"] == 5 and made["counts"]["synthetic"] == 34 - made["shortfalls"]["synthetic"] and sum(made["score_bins"].values()) == sum(made["counts"].values())
    pairs = read_pairs(spark, f"{tmp_path}/out")
    labels = read_labels(spark, f"{tmp_path}/out/label_sheet.csv").withColumn("same_door", F.lit("yes"))
    out = score_labels(pairs, labels, read_scores(spark, f"{tmp_path}/private"))
    overall = next(m for m in out["metrics"] if m["bucket"] == "overall")
    assert overall["tp"] + overall["fp"] + overall["fn"] + overall["tn"] == sum(made["counts"].values()) and out["coverage"]["labeled"] == made["counts"]["candidates"]
    assert "| door | overall |" in as_markdown(out)


def test_commands_over_files(spark, tmp_path, capsys):
    from streetlink.cli import main

    rows = [(t, f"n{i}", f"m{i % 3}", f"c{i % 5}", None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "direccion string, numero_predial_nacional string, manzana string, comuna string, barrio string").write.parquet(f"{tmp_path}/base")
    assert main(["build-pairs", f"{tmp_path}/base", f"{tmp_path}/out", f"{tmp_path}/private", "--synthetic", "17", "--per-stratum", "3", "--negatives", "4"]) == 0
    assert '"negatives": 4' in capsys.readouterr().out
    assert main(["score-labels", f"{tmp_path}/out", f"{tmp_path}/out/label_sheet.csv", "--scores", f"{tmp_path}/private", "--out", f"{tmp_path}/report.md"]) == 0
    assert open(f"{tmp_path}/report.md").read().startswith("# Label evaluation")
    assert main(["score-labels", f"{tmp_path}/nowhere", f"{tmp_path}/out/label_sheet.csv"]) == 2


def test_transforms_and_scorer_can_be_given(spark, tmp_path):
    rows = [(i, t, f"n{i}", f"m{i % 3}", f"c{i % 5}", None) for i, t in enumerate(TEXTS)]
    records = spark.createDataFrame(rows, "rid long, direccion string, npn string, manzana string, comuna string, barrio string")
    said = []
    made = build_pairs(records, f"{tmp_path}/out", f"{tmp_path}/private", n_synthetic=10, per_stratum=2, n_sanity=2, scorer=lambda a, b: F.lit(0.92), registry={"loud": lambda text, parts, h: F.concat(text, F.lit("!"))}, log=said.append)
    assert made["score_bins"]["0.90-0.95"] == sum(made["counts"].values()) and len(said) == 3
    assert {r.transform for r in read_pairs(spark, f"{tmp_path}/out").filter("kind = 'synthetic'").collect()} == {"loud"}
