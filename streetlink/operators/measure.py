"""Measurements over parsed addresses, scored pairs and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import render
from ..functions.text import settled
from ..vocab import KINDS
from .classify import base_key, classify_pair, differing_fields, failure_causes, note_family, plate_key, shape_signature, signature
from .compare import match_parsed, score
from .pairs import sampled_group_pairs, weighed_pairs

HIT = 0.90
CONFIGS = ((0.70, 0), (0.85, 0), (0.90, 0), (0.95, 0), (1.0, 0), (0.90, 1), (0.90, 2))


def rate(numerator: Column, denominator: Column, empty: float | None) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(empty).cast("double"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> list[Column]:
    """precision, recall, f1; ``empty`` where undefined (0.0, or None for null)."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r))
    return [F.coalesce(x, F.lit(empty).cast("double")).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"))]


def coverage(parsed: DataFrame, column: str) -> dict[str, DataFrame]:
    """Parse coverage: totals, notes, families, causes, shapes, plate letters, unknown kinds.

    parsed has the text ``column`` and the struct p. Lists are in order of count
    and then name.
    """
    failed = parsed.filter("not p.parse_ok")
    notes = failed.select(F.explode("p.notes").alias("note"))
    ranked = lambda df, name, n: df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)

    def with_examples(df: DataFrame, name: str, keep: int) -> DataFrame:
        """Counts, and the first few texts of each; the filter on the rank lets every task
        drop all but its own first few before they are sent."""
        w = Window.partitionBy(name).orderBy(column)
        first = df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)
        first = first.groupBy(name).agg(F.sort_array(F.collect_list(column)).alias("examples")).withColumnRenamed(name, "__name")
        counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        return counts.join(first, F.col(name).eqNullSafe(F.col("__name"))).drop("__name")

    kinds = parsed.select(F.explode("p.complement").alias("c")).select("c.kind").filter(~F.col("kind").isin(list(KINDS)))
    return {
        "totals": parsed.agg(F.count(F.lit(1)).alias("total"), F.count_if("p.parse_ok").alias("parse_ok"), F.count_if(~F.col("p.parse_ok")).alias("parse_fail")),
        "notes": ranked(notes, "note", 20),
        "families": ranked(notes.select(note_family(F.col("note")).alias("family")), "family", 20),
        "causes": with_examples(failure_causes(failed.select(column), column), "cause", 5).orderBy(F.desc("n"), "cause"),
        "shapes": with_examples(failed.select(column, shape_signature(F.col(column)).alias("shape")), "shape", 2).orderBy(F.desc("n"), "shape").limit(25),
        "plate_letters": ranked(parsed.select(F.col("p.plate_letter").alias("letter")).filter("letter is not null"), "letter", 12),
        "unknown_kinds": ranked(kinds, "kind", 15),
    }


def score_summary(df: DataFrame, by: list[str], score_col: str = "score") -> DataFrame:
    """count, min, max, mean and four bins of a score by group."""
    s = F.col(score_col)
    return df.groupBy(*by).agg(
        F.count(s).alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"),
        F.count_if(s <= 0).alias("bin_zero"), F.count_if((s > 0) & (s < HIT)).alias("bin_low"), F.count_if((s >= HIT) & (s < 1)).alias("bin_high"), F.count_if(s >= 1).alias("bin_one"),
    )


def top_scores(df: DataFrame, n: int = 8) -> DataFrame:
    return df.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "score").limit(n)


def variant_hits(variants: DataFrame, original: str, again: str) -> DataFrame:
    """Recall by kind over (kind, parsed original, parsed variant)."""
    scored = variants.withColumn("score", score(F.col(original), F.col(again)))
    return scored.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= HIT).alias("hit"), F.count_if((F.col("score") < HIT) & ~F.col(f"{again}.parse_ok")).alias("unparseable"))


def mutation_outcomes(mutants: DataFrame, original: str, again: str) -> DataFrame:
    """By kind: vetoed, penalized, passed, and how many came out as designed."""
    s = F.col("score")
    scored = mutants.withColumn("score", score(F.col(original), F.col(again)))
    return scored.groupBy("kind", "expected").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == 0).alias("veto"), F.count_if((s > 0) & (s < HIT)).alias("penalized"), F.count_if(s >= HIT).alias("passed"),
        F.count_if((s >= HIT) == (F.col("expected") == "match")).alias("as_designed"),
    )


def symmetry(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, and those whose two directions disagree."""
    x, y = F.col(a), F.col(b)
    return pairs.select(score(x, y).alias("ab"), score(y, x).alias("ba")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ab") != F.col("ba")).alias("violations"))


def confusion(pairs: DataFrame, a: str, b: str, label: str, configs=CONFIGS) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 for each (threshold, tolerance).

    Each tolerance is scored once; thresholds are then counted in one aggregate.
    """
    tolerances = sorted({t for _, t in configs})
    scored = pairs.select(F.col(label).alias("y"), *[score(F.col(a), F.col(b), t).alias(f"s{t}") for t in tolerances])
    cells = F.explode(F.array(*[F.struct(F.lit(float(th)).alias("threshold"), F.lit(t).alias("plate_tolerance"), (F.col(f"s{t}") >= th).alias("hit")) for th, t in configs])).alias("c")
    counted = scored.select("y", cells).groupBy("c.threshold", "c.plate_tolerance").agg(
        F.count_if(F.col("y") & F.col("c.hit")).alias("tp"), F.count_if(~F.col("y") & F.col("c.hit")).alias("fp"),
        F.count_if(F.col("y") & ~F.col("c.hit")).alias("fn"), F.count_if(~F.col("y") & ~F.col("c.hit")).alias("tn"),
    )
    return counted.select("*", *precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def face_key(p: str = "p") -> Column:
    return F.struct(signature(F.col(p), "via").alias("v"), signature(F.col(p), "cross").alias("c"))


def false_links(rows: DataFrame, max_pairs: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs on the same face by category, and how many reach the threshold.

    rows: rid, p of addresses that parse, and optionally parcel; pairs of the
    same parcel do not count. Without max_pairs all pairs are taken.
    """
    pairs = _weighed(rows, face_key(), max_pairs, seed)
    scored = pairs.select(settled(classify_pair(F.col("p_a"), F.col("p_b"))).alias("category"), settled(score(F.col("p_a"), F.col("p_b"))).alias("score"), "n")
    return scored.groupBy("category").agg(F.sum("n").alias("n"), _hits(), F.sum(F.col("score") * F.col("n")).alias("total_score")).filter("n > 0")


def _weighed(rows: DataFrame, key: Column, max_pairs: int | None, seed: int) -> DataFrame:
    """Pairs inside groups with their number n: all of them, those of equal fields as one, or a sample one by one."""
    if max_pairs is None:
        return weighed_pairs(rows, key)
    return _apart(sampled_group_pairs(rows, key, max_pairs, seed), rows).select("p_a", "p_b", F.lit(1).cast("long").alias("n"))


def _hits() -> Column:
    return F.coalesce(F.sum(F.when(F.col("score") >= HIT, F.col("n"))), F.lit(0)).alias("at_or_above")


def _apart(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    if "parcel" not in rows.columns:
        return pairs
    parcels = rows.select("rid", "parcel")
    a = parcels.select(F.col("rid").alias("rid_a"), F.col("parcel").alias("parcel_a"))
    b = parcels.select(F.col("rid").alias("rid_b"), F.col("parcel").alias("parcel_b"))
    return pairs.join(a, "rid_a").join(b, "rid_b").filter("parcel_a is null or parcel_b is null or parcel_a <> parcel_b").drop("parcel_a", "parcel_b")


def ambiguity(rows: DataFrame) -> DataFrame:
    """One row: what is ambiguous in the base itself, whatever the scorer does."""
    own = rows.select("rid", render(F.col("p")).alias("canonical"), F.to_json(base_key(F.col("p")), {"ignoreNullFields": "false"}).alias("base"), F.to_json(F.struct("p.complement")).alias("chunks"), (F.size("p.complement") == 0).alias("bare"), (F.col("parcel") if "parcel" in rows.columns else F.col("rid")).alias("parcel"))
    groups = own.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("parcel").alias("d")).filter("n > 1 and d > 1")
    first = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"),
                       F.coalesce(F.expr("sum(d * (d - 1) div 2)"), F.lit(0)).alias("equal_pairs"), F.count_if(F.expr("n = 2")).alias("size_2"), F.count_if(F.expr("n = 3")).alias("size_3"), F.count_if(F.expr("n = 4")).alias("size_4"), F.count_if(F.expr("n > 4")).alias("size_5_up"))
    parts = own.groupBy("base", "chunks").agg(F.count(F.lit(1)).alias("k"), F.max("bare").alias("bare"))
    bases = parts.groupBy("base").agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("variants"), F.expr("sum(k * (k - 1) div 2)").alias("same"), F.sum(F.when(F.col("bare"), F.col("k")).otherwise(0)).alias("b")).filter("m > 1")
    second = bases.agg(F.count(F.lit(1)).alias("bases_with_rows"), F.count_if(F.expr("variants > 1")).alias("bases_with_variants"), F.coalesce(F.sum("same"), F.lit(0)).alias("identical_pairs"), F.coalesce(F.sum(F.expr("b * (m - b)")), F.lit(0)).alias("bare_pairs"))
    return first.crossJoin(second)  # one row each


def hard_negatives(rows: DataFrame, max_pairs: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs of different bases that share via and plate, or cross and plate."""
    out = []
    for label, side in (("same_via_same_plate_other_cross", "via"), ("same_cross_same_plate_other_via", "cross")):
        key = F.struct(signature(F.col("p"), side).alias("s"), plate_key(F.col("p")).alias("k"))
        pairs = _weighed(rows, key, max_pairs if max_pairs is None else max_pairs // 2, seed)
        told = pairs.withColumn("category", settled(classify_pair(F.col("p_a"), F.col("p_b"))))
        pairs = told.filter("category = 'different_base_other'")
        out.append(pairs.select(F.lit(label).alias("kind"), settled(score(F.col("p_a"), F.col("p_b"))).alias("score"), "n"))
    both = reduce(DataFrame.union, out)
    return both.groupBy("kind").agg(F.sum("n").alias("n"), _hits()).filter("n > 0")


def hard_negative_fields(pairs: DataFrame) -> DataFrame:
    """Which fields differ among pairs (p_a, p_b) that reach the threshold."""
    hits = match_parsed(pairs, "p_a", "p_b", HIT).filter("is_match")
    return hits.groupBy(F.array_join(differing_fields(F.col("fields")), ",").alias("fields")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fields").limit(10)


def link_quality(summary: DataFrame, links: DataFrame, own: DataFrame) -> DataFrame:
    """One row over queries with a known own record (own: query_id, own_id):
    how often it is first, missing, tied behind another, or beaten."""
    mine = links.join(own, "query_id").filter("record_id = own_id").select("query_id", F.col("score").alias("own_score"))
    all_ = own.join(summary, "query_id").join(mine, "query_id", "left")
    first = F.col("best_id") == F.col("own_id")
    tied = F.col("ambiguous") & F.coalesce(F.col("own_score") == F.col("best_score"), F.lit(False))
    return all_.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(first).alias("top1_correct"), F.count_if(F.col("own_score").isNull()).alias("own_missing"), F.count_if("ambiguous").alias("ambiguous"),
        F.count_if(F.col("best_id").isNull()).alias("no_best"), F.count_if(~first & tied).alias("tie_wrong_first"), F.count_if(~first & ~tied).alias("false_best"), F.count_if(~F.col("parse_ok")).alias("unparseable_queries"),
        F.avg("n_candidates").alias("avg_candidates"), F.avg("n_compared").alias("avg_compared"), F.max("n_candidates").alias("max_candidates"), F.max("n_compared").alias("max_compared"),
    )
