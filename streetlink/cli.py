"""Command line: compare two addresses, link one to a CSV base, evaluate a base, build
pairs to label, score labels.

Exit codes: 0 match or found, 1 none, 2 bad arguments or a bad file.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.render import render
from .operators.compare import InvalidThreshold, InvalidTolerance, checked_threshold, checked_tolerance, match_pairs, match_parsed
from .operators.link import block_base, checked_cap, index_stats, link, link_summary, parse_queries
from .plans import runs
from .sources.csv_base import BaseFileError, read_base_rows
from .sources.files import read_labels, read_pairs, read_parquet_base, read_records, read_scores
from .vocab import FIELDS, THRESHOLD, TOLERANCE


def _session() -> SparkSession:
    return SparkSession.builder.appName("streetlink").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def _side(text: str, p: dict, canonical: str) -> dict:
    fields = {f: ([[c["kind"], c["value"]] for c in p[f]] if f == "complement" else p[f]) for f in FIELDS}
    return {"input": text, "parse_ok": p["parse_ok"], "canonical": canonical, "fields": fields, "notes": p["notes"]}


def compare(a: str, b: str, threshold: float = THRESHOLD, tolerance: int = TOLERANCE) -> dict:
    """The comparison of two texts as one dict, in the order in which it is printed as JSON."""
    df = match_pairs(_session().createDataFrame([(a, b)], "a string, b string"), "a", "b", threshold, tolerance)
    r = df.withColumns({"ca": render(F.col("parsed_a")), "cb": render(F.col("parsed_b"))}).first().asDict(recursive=True)
    return {
        "match": r["is_match"], "resultado": "MATCH" if r["is_match"] else "NO MATCH", "score": r["score"], "threshold": threshold, "plate_tolerance": tolerance, "reason": r["reason"],
        "a": _side(a, r["parsed_a"], r["ca"]), "b": _side(b, r["parsed_b"], r["cb"]), "fields": r["fields"], "warnings": r["warnings"],
    }


def find(query: str, base: str, id_column: str, address_column: str, encoding: str = "utf-8", threshold: float = THRESHOLD, tolerance: int = TOLERANCE, top: int = 5, max_block_scan: int | None = None) -> dict:
    """The links of one address to a CSV base as one dict; candidates up to ``top``."""
    spark = _session()
    every = read_base_rows(spark, base, id_column, address_column, encoding).persist()
    rows = every.filter("not blank_id").drop("blank_id")
    blocked = block_base(rows, "record_id", "address", "ordinal")
    q = parse_queries(spark.createDataFrame([(0, query)], "id int, address string"), "id", "address")
    s = link_summary(q, blocked, threshold, tolerance, max_block_scan).first()
    shown = link(q, blocked, threshold, tolerance, max_block_scan).filter(F.col("rank") <= max(top, 1))
    shown = match_parsed(shown.drop("score").crossJoin(F.broadcast(q.select("query"))), "query", "base", threshold, tolerance).withColumn("canonical", render(F.col("base"))).orderBy("rank").collect()
    own = q.select("query.parse_ok", render(F.col("query")).alias("canonical")).first()
    stats = index_stats(rows, "record_id", "address").first()
    found = [{"id": r.record_id, "puntaje": r.score, "canonica": r.canonical, "avisos": r.warnings} for r in shown]
    return {
        "consulta": query, "canonica": own.canonical, "parse_ok": own.parse_ok, "motivo": s.reason, "umbral": threshold, "tolerancia_placa": tolerance, "n_comparados": s.n_compared, "n_candidatos": s.n_candidates,
        "ambiguo": s.ambiguous, "casi_ambiguo": s.near_ambiguous, "alternativas": s.alternatives, "truncado": s.truncated, "mejor": found[0] if found else None, "candidatos": found[:top],
        "registros": stats.records, "rechazados": stats.rejected, "ids_vacios": every.filter("blank_id").count(),
    }


#: The words of the plain report.
FOUND, NOT_FOUND, AMBIGUOUS, TRUNCATED = "MATCH", "SIN_COINCIDENCIA", "AMBIGUO", "TRUNCADO"
NOTE_NEAR = "nota: otras parcelas también superan el umbral (mismo predio con complemento conocido o variante de tipo de cruce); revise las alternativas antes de vincular"
NOTE_TRUNCATED = "nota: se alcanzó --max-block-scan; el bloque no se comparó completo y puede faltar un candidato mejor"


def plain_report(out: dict) -> str:
    """What ``find`` found, as lines for people."""
    best = out["mejor"]
    marks = [word for word, on in ((AMBIGUOUS, out["ambiguo"]), (TRUNCATED, out["truncado"])) if on]
    head = [FOUND if best else NOT_FOUND, f"candidatos={out['n_candidatos']}", f"comparados={out['n_comparados']}", f"umbral={out['umbral']:g}", *marks]
    base = [f"{out['registros']} registros indexados", f"{out['rechazados']} rechazados"] + ([f"{out['ids_vacios']} sin id"] if out["ids_vacios"] else [])
    shown = [f"{i}. {c['id']}  puntaje={c['puntaje']:.4f}  {c['canonica']}" + (f"  [avisos: {', '.join(c['avisos'])}]" if c["avisos"] else "") for i, c in enumerate(out["candidatos"], 1)]
    hidden = out["n_candidatos"] - len(shown)
    lines = [
        ("  ".join(head), True), (f"consulta: {out['canonica']}", True), ("base: " + ", ".join(base), True), (f"motivo: {out['motivo']}", not out["parse_ok"]),
        (f"alternativas: {out['alternativas']}", best), (NOTE_NEAR, best and out["casi_ambiguo"]), (f"avisos: {', '.join(best['avisos']) if best else ''}", best and best["avisos"]), (NOTE_TRUNCATED, out["truncado"]),
        *((line, True) for line in shown), (f"... y {hidden} candidatos más", hidden > 0),
    ]
    return "\n".join(text for text, on in lines if on)


def _say(text: str) -> None:
    print(text, file=sys.stderr, flush=True)


def _run(args: argparse.Namespace) -> int:
    """The commands that run over a whole base."""
    spark = _session()
    if args.command == "evaluate":
        rows = read_parquet_base(spark, args.base, args.address_column, args.parcel_column).withColumn("rid", F.monotonically_increasing_id())
        out = runs.evaluate(rows, args.sample or None, args.seed, args.max_pairs, args.link_sample, timings=True, log=_say)
        text = json.dumps(out, ensure_ascii=False, indent=2, default=str) + "\n" if args.json else runs.as_text(out)
    elif args.command == "build-pairs":
        rows = read_records(spark, args.base).withColumnRenamed("numero_predial_nacional", "npn").withColumn("rid", F.monotonically_increasing_id())
        text = json.dumps(runs.build_pairs(rows, args.out, args.private, args.seed, args.synthetic, args.per_stratum, args.negatives, log=_say), ensure_ascii=False, indent=2) + "\n"
        args.out = None
    else:
        scores = read_scores(spark, args.scores) if args.scores else None
        out = runs.score_labels(read_pairs(spark, args.pairs), read_labels(spark, args.labels), scores, checked_threshold(args.threshold), checked_tolerance(args.plate_tolerance))
        text = json.dumps(out, ensure_ascii=False, indent=2, default=str) + "\n" if args.json else runs.as_markdown(out)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="streetlink")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compare")
    one.add_argument("a"), one.add_argument("b")
    many = commands.add_parser("link")
    many.add_argument("query")
    for name in ("--base", "--id-column", "--address-column"):
        many.add_argument(name, required=True)
    many.add_argument("--encoding", default="utf-8"), many.add_argument("--top", type=int, default=5), many.add_argument("--max-block-scan", "--max-bloque", type=int)
    judge = commands.add_parser("evaluate")
    judge.add_argument("base"), judge.add_argument("--address-column", default="direccion"), judge.add_argument("--parcel-column", default="numero_predial_nacional")
    for name, default in (("--sample", 20_000), ("--seed", 42), ("--max-pairs", 200_000), ("--link-sample", 5_000)):
        judge.add_argument(name, type=int, default=default)
    build = commands.add_parser("build-pairs")
    build.add_argument("base"), build.add_argument("out"), build.add_argument("private")
    for name, default in (("--seed", 20260926), ("--synthetic", 250), ("--per-stratum", 60), ("--negatives", 30)):
        build.add_argument(name, type=int, default=default)
    marks = commands.add_parser("score-labels")
    marks.add_argument("pairs"), marks.add_argument("labels"), marks.add_argument("--scores")
    for p in (judge, marks):
        p.add_argument("--out")
    judge.add_argument("--json", action="store_true")
    for p in (one, many, marks):
        p.add_argument("--threshold", "--umbral", type=float, default=THRESHOLD), p.add_argument("--plate-tolerance", "--tolerancia-placa", type=int, default=TOLERANCE), p.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    try:
        if args.command not in ("compare", "link"):
            return _run(args)
        threshold, tolerance = checked_threshold(args.threshold), checked_tolerance(args.plate_tolerance)
        if args.command == "compare":
            out = compare(args.a, args.b, threshold, tolerance)
            if args.json:
                print(json.dumps(out, ensure_ascii=False, indent=2))
            else:
                print(f"{out['resultado']} puntaje={out['score']:.4f} umbral={threshold:g}\nA: {out['a']['canonical']}\nB: {out['b']['canonical']}\nmotivo: {out['reason']}" + (f"\navisos: {', '.join(out['warnings'])}" if out["warnings"] else ""))
            return 0 if out["match"] else 1
        out = find(args.query, args.base, args.id_column, args.address_column, args.encoding, threshold, tolerance, args.top, checked_cap(args.max_block_scan))
    except (InvalidThreshold, InvalidTolerance, BaseFileError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # a file that a task could not read
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    if args.json:
        print(json.dumps(out, ensure_ascii=False, indent=2))
    else:
        print(plain_report(out))
    return 0 if out["mejor"] else 1


if __name__ == "__main__":
    sys.exit(main())
