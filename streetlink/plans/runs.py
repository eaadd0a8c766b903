"""Evaluation of a base, building of pairs to label, scoring of labels.

Each table is one aggregate over DataFrames; only aggregates and capped pools
come to the driver, where reports are formatted.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import labels, measure, pairs, transforms, variants
from ..operators.compare import score
from ..operators.link import block_base, index_stats, link, link_summary, parse_queries
from ..operators.parse import parse
from ..sources.files import json_lines, label_sheet, write_text
from ..vocab import THRESHOLD

SIDECAR = "matcher_scores_sidecar.jsonl"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


#: What each table of an evaluation is about.
HEADINGS = {
    "A": "parse coverage", "B": "self-match and symmetry", "C": "other spellings of an address", "D": "addresses that differ in one field", "E": "false links between records",
    "F": "thresholds and plate tolerances", "G": "throughput and memory", "H": "records linked back to the base",
}
Log = Callable[[str], None]


def evaluate(base: DataFrame, sample: int | None = 20_000, seed: int = 42, max_pairs: int = 200_000, link_sample: int = 5_000, timings: bool = False, log: Log | None = None) -> dict:
    """Tables A to H over a base (rid, address, parcel); see HEADINGS.

    ``timings`` adds G, whose figures differ from run to run. ``log`` is called with
    a line before each table.
    """
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        """Parsed once and read by many tables; a lost part is parsed again."""
        held.append(df.persist())
        return held[-1]

    try:
        return _tables(base, sample, seed, max_pairs, link_sample, hold, timings, log or (lambda line: None))
    finally:
        for df in held:
            df.unpersist()


def _tables(base: DataFrame, sample: int | None, seed: int, max_pairs: int, link_sample: int, hold: Callable[[DataFrame], DataFrame], timings: bool, log: Log) -> dict:
    parcel = F.coalesce("parcel", F.col("rid").cast("string")) if "parcel" in base.columns else F.col("rid").cast("string")
    parsed = hold(parse(base.withColumn("own_id", parcel), "address", "p"))
    ok = parsed.filter("p.parse_ok")
    some = ok if sample is None else hold(pairs.sample_rows(parsed, "rid", sample, seed).filter("p.parse_ok"))
    spelled = hold(parse(variants.positive_variants(some.select("address", "p"), "address", "p"), "variant", "again"))
    changed = hold(parse(variants.negative_mutations(some.select("p"), "p"), "mutant", "again"))
    both_ways = changed.select("p", "again").union(pairs.consecutive_pairs(some.select("rid", "p"), seed).select(F.col("p_a").alias("p"), F.col("p_b").alias("again")))
    labelled = spelled.select("p", "again", F.lit(True).alias("y")).union(changed.filter("expected = 'no_match'").select("p", "again", F.lit(False).alias("y")))
    records = ok.select("rid", "p", *(["parcel"] if "parcel" in base.columns else []))
    blocked = hold(block_base(parsed.select("own_id", "address", "rid"), "own_id", "address", "rid"))
    drawn = hold(pairs.sample_rows(ok.select("rid", "own_id", "address", "p"), "rid", link_sample, seed))
    one = variants.positive_variants(drawn, "address", "p").groupBy("rid", "own_id").agg(F.min_by("variant", F.xxhash64(F.lit(seed), "kind")).alias("text"))
    linked = {}
    log(f"H {HEADINGS['H']}")
    for name, q in (("exact", drawn.select("rid", "own_id", F.col("address").alias("text"))), ("variant", one)):
        asked = hold(parse_queries(q, "rid", "text"))
        own = q.select(F.col("rid").alias("query_id"), "own_id")
        linked[name] = _rows(measure.link_quality(hold(link_summary(asked, blocked)), hold(link(asked, blocked)), own))[0]
    tables: dict[str, Callable[[], object]] = {
        "A": lambda: {k: _rows(v) for k, v in measure.coverage(parsed, "address").items()},
        "B": lambda: {"self_match": _rows(some.agg(F.count(F.lit(1)).alias("n"), F.count_if(score(F.col("p"), F.col("p")) != 1).alias("violations")))[0], "symmetry": _rows(measure.symmetry(both_ways, "p", "again"))[0]},
        "C": lambda: _rows(measure.variant_hits(spelled, "p", "again").orderBy("kind")),
        "D": lambda: _rows(measure.mutation_outcomes(changed, "p", "again").orderBy("kind")),
        "E": lambda: {"same_face": _rows(measure.false_links(records, max_pairs, seed)), "ambiguity": _rows(measure.ambiguity(records))[0], "hard_negatives": _rows(measure.hard_negatives(records, max_pairs, seed))},
        "F": lambda: _rows(measure.confusion(labelled, "p", "again", "y").orderBy("plate_tolerance", "threshold")),
        "G": lambda: throughput(base, some, drawn.select("rid", F.col("address").alias("text")), seed),
    }
    out: dict = {"seed": seed}
    for name, table in tables.items():
        if name != "G" or timings:
            log(f"{name} {HEADINGS[name]}")
            out[name] = table()
    return out | {"H": {"index": _rows(index_stats(parsed, "own_id", "address"))[0], **linked}}


def throughput(base: DataFrame, some: DataFrame, asked: DataFrame, seed: int) -> dict:
    """Seconds and rows a second of parsing, comparing, building the blocked base and
    linking, each run to its end without keeping a result, and the memory in use."""
    spark = base.sparkSession
    out: dict = {}

    def timed(name: str, df: DataFrame, rows: int) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        out[name] = {"rows": rows, "seconds": round(took, 3), "rows_per_second": round(rows / took), "microseconds_a_row": round(1e6 * took / max(rows, 1), 1)}

    text = base.select("rid", "address")
    n, asked_n = text.count(), asked.count()
    timed("parse", parse(text, "address", "p"), n)
    couples = pairs.consecutive_pairs(some.select("rid", "p"), seed)
    timed("compare", pairs.with_scores(couples), couples.count())
    blocked = block_base(text, "rid", "address", "rid")
    timed("block_base", blocked, n)
    timed("link", link_summary(parse_queries(asked, "rid", "text"), blocked), asked_n)
    java = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    out["memory"] = {"driver_heap_used_mb": (java.totalMemory() - java.freeMemory()) >> 20, "driver_heap_max_mb": java.maxMemory() >> 20, "executors": executors}
    return out


def as_text(result: dict) -> str:
    """A report as plain text: each table with its columns aligned."""
    out: list[str] = []

    def table(rows: list[dict]) -> None:
        if not rows:
            out.append("(none)")
            return
        cells = [list(rows[0])] + [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]
        widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
        out.extend("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in [cells[0], ["-" * w for w in widths], *cells[1:]])

    def walk(name: str, x: object) -> None:
        if isinstance(x, dict) and any(isinstance(v, (dict, list)) for v in x.values()):
            for k, v in x.items():
                walk(f"{name} {k}".strip(), v)
        elif isinstance(x, (dict, list)):
            heading = HEADINGS.get(name.split(" ")[0])
            out.append(f"\n== {name}" + (f" ({heading})" if heading else ""))
            table(x if isinstance(x, list) else [x])
        else:
            out.append(f"{name}: {x}")

    walk("", result)
    return "\n".join(out) + "\n"


def build_pairs(records: DataFrame, out_dir: str, private_dir: str, seed: int = 20260926, n_synthetic: int = 250, per_stratum: int = 60, n_sanity: int = 30, scorer: Callable[[Column, Column], Column] = score, registry: dict[str, transforms.Transform] | None = None, log: Log | None = None) -> dict:
    """Synthetic positives, candidates to label and random negatives of a base
    (rid, direccion, npn, manzana, comuna, barrio), as files; scores go apart.

    Quotas that cannot be filled are reported as shortfalls. ``registry`` replaces
    the transforms (then without combinations), ``scorer`` the score; ``log`` is
    called with a line before each part.
    """
    log = log or (lambda line: None)
    log("synthetic positives")
    base = records.filter(F.trim("direccion") != "").filter(F.length("direccion") <= 160)
    quota = -(-n_synthetic // (len(registry) if registry else len(transforms.TRANSFORMS) + 1))
    synthetic = _rows(transforms.synthetic_positives(base, "direccion", seed, quota, registry).orderBy("transform", "pair_id").limit(n_synthetic))
    synthetic = [r | {"same_door": True, "tier": "synthetic", "source_direccion": r["addr_a"]} for r in synthetic]
    log("candidates")
    rows = parse(base, "direccion", "p")
    pools = pairs.strata_pools(rows, "direccion", seed).withColumn("score", scorer(F.col("p_a"), F.col("p_b")))
    facts = base.select("rid", "npn", "manzana", "comuna", "barrio")
    side = lambda s: facts.select(*[F.col(c).alias(f"{c}_{s}") for c in facts.columns])
    scored = pools.select("stratum", "subtype", "rid_a", "rid_b", F.col("p_a.raw").alias("addr_a"), F.col("p_b.raw").alias("addr_b"), "score").join(side("a"), "rid_a").join(side("b"), "rid_b")
    scored = scored.withColumn("pair_id", pairs.pair_id("cand", F.concat_ws("\x1f", "addr_a", F.coalesce(F.col("npn_a").cast("string"), F.lit("None"))), F.concat_ws("\x1f", "addr_b", F.coalesce(F.col("npn_b").cast("string"), F.lit("None")))))
    chosen = pairs.select_candidates(_rows(scored), per_stratum, seed)
    keep = ("pair_id", "addr_a", "addr_b", "stratum", "npn_a", "npn_b", "comuna_a", "comuna_b", "barrio_a", "barrio_b")
    candidates = [{k: c[k] for k in keep} | {"same_manzana": c["manzana_a"] is not None and c["manzana_a"] == c["manzana_b"]} for c in chosen]
    log("negatives and scores")
    drawn = pairs.random_negatives(base, "comuna", "direccion", n_sanity, seed).join(side("a"), "rid_a").join(side("b"), "rid_b")
    negatives = [{"pair_id": f"neg-{i:04}", "addr_a": r["direccion_a"], "addr_b": r["direccion_b"], "same_door": False, "tier": "sanity", "npn_a": r["npn_a"], "npn_b": r["npn_b"]} for i, r in enumerate(_rows(drawn.drop("comuna_a", "comuna_b")))]
    every = [(r["pair_id"], r["addr_a"], r["addr_b"]) for r in synthetic + candidates + negatives]
    both = parse(parse(records.sparkSession.createDataFrame(every or [], "pair_id string, a string, b string"), "a", "pa"), "b", "pb")
    scores = {r.pair_id: r.s for r in both.select("pair_id", scorer(F.col("pa"), F.col("pb")).alias("s")).collect()}
    sidecar = [{"pair_id": i, "score": round(scores[i], 6), "decision": "MATCH" if scores[i] >= THRESHOLD else "NO_MATCH"} for i, _, _ in every]
    digests = write_text({"synthetic_positives.jsonl": json_lines(synthetic), "candidates_to_label.jsonl": json_lines(candidates), "random_negatives.jsonl": json_lines(negatives), "label_sheet.csv": label_sheet(candidates, seed)}, out_dir)
    write_text({SIDECAR: json_lines(sidecar)}, private_dir)
    per = {s: sum(c["stratum"] == s for c in candidates) for s in pairs.STRATA}
    manifest = {
        "seed": seed, "counts": {"synthetic": len(synthetic), "candidates": len(candidates), "negatives": len(negatives)}, "strata": per,
        "shortfalls": {"synthetic": n_synthetic - len(synthetic), "sanity": n_sanity - len(negatives), **{s: per_stratum - n for s, n in per.items()}},
        "score_bins": {b: sum(sum(x["score"] >= e for e in pairs.BIN_EDGES) == i for x in sidecar) for i, b in enumerate(pairs.BIN_LABELS)}, "sha256": digests,
    }
    write_text({"MANIFEST.json": json.dumps(manifest, ensure_ascii=False, indent=2) + "\n"}, out_dir)
    return manifest


def score_labels(pair_rows: DataFrame, label_rows: DataFrame, scores: DataFrame | None = None, threshold: float = THRESHOLD, tolerance: int = 0, top: int = 10) -> dict:
    """Metrics by bucket, coverage, the worst pairs and warnings."""
    both = parse(parse(pair_rows, "addr_a", "a"), "addr_b", "b")
    merged = labels.merge_labels(both, label_rows, scores, score(F.col("a"), F.col("b"), tolerance))
    fp, fn = labels.worst(merged, threshold, top)
    show = ["pair_id", "grp", "addr_a", "addr_b", "score"]
    unknown = sorted(r.pair_id for r in labels.unknown_labels(pair_rows, label_rows).collect())
    said = merged.agg(F.count_if(~F.col("human") & F.col("door").isNotNull()).alias("own"), F.count_if(F.col("frozen").isNotNull()).alias("frozen")).first()
    warnings = [w for n, w in ((len(unknown), "label(s) of unknown pairs ignored"), (said.own, "label(s) for pairs with a label of their own ignored"), (said.frozen, "pair(s) with a frozen score")) if n]
    return {"threshold": threshold, "plate_tolerance": tolerance, "coverage": _rows(labels.label_coverage(merged))[0], "unknown_label_ids": unknown, "warnings": warnings, "metrics": _rows(labels.label_buckets(merged, threshold).orderBy("section", "bucket")),
            "false_positives": _rows(fp.select(*show)), "false_negatives": _rows(fn.select(*show))}


def as_markdown(result: dict) -> str:
    ratio = lambda v: "n/a" if v is None else f"{100 * v:.2f}%"
    out = [f"# Label evaluation (threshold {result['threshold']:g}, plate tolerance {result['plate_tolerance']})", "", "| section | bucket | tp | fp | fn | tn | precision | recall | F1 |", "|-|-|-|-|-|-|-|-|-|"]
    out += [f"| {m['section']} | {m['bucket']} | {m['tp']} | {m['fp']} | {m['fn']} | {m['tn']} | {ratio(m['precision'])} | {ratio(m['recall'])} | {ratio(m['f1'])} |" for m in result["metrics"]]
    out += ["", "Coverage: " + ", ".join(f"{k} {v}" for k, v in result["coverage"].items()), *[f"- warning: {w}" for w in result["warnings"]]]
    for title, key in (("False positives", "false_positives"), ("False negatives", "false_negatives")):
        out += ["", f"## {title}", *[f"- `{r['pair_id']}` {r['score']:.4f} {r['addr_a']} / {r['addr_b']}" for r in result[key]]]
    return "\n".join(out) + "\n"
