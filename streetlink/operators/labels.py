"""Evaluation of labelled pairs: labels merged, every bucket counted in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_strip
from ..vocab import THRESHOLD
from .measure import precision_recall_f1

DOOR = ("yes", "no", "unsure")
NOT_APPLICABLE = ("n/a", "na", "n.a.", "n/a.")
_TRUE, _FALSE = ("true",), ("false",)


class LabelError(ValueError):
    """Bad label or pair files."""


def normal_label(c: Column, unit: bool = False) -> Column:
    """yes / no / unsure (and n/a for units); null for blank or invalid."""
    v = F.lower(unicode_strip(c.cast("string")))
    out = F.when(v.isin(*DOOR), v).when(v.isin(*_TRUE), "yes").when(v.isin(*_FALSE), "no")
    return out.when(v.isin(*NOT_APPLICABLE), "n/a") if unit else out


def invalid_label(c: Column, unit: bool = False) -> Column:
    v = F.lower(unicode_strip(c.cast("string")))
    return v.isNotNull() & (v != "") & normal_label(c, unit).isNull()


def merge_labels(pairs: DataFrame, labels: DataFrame, scores: DataFrame | None, live: Column) -> DataFrame:
    """pairs (pair_id, kind, grp, transform, builtin) with their label, unit label and score.

    Pairs that carry a label of their own ignore the file's. A frozen score goes
    before the live one.
    """
    own = labels.select(
        "pair_id", normal_label(F.col("same_door")).alias("door"), invalid_label(F.col("same_door")).alias("door_invalid"),
        normal_label(F.col("same_unit"), True).alias("unit"), invalid_label(F.col("same_unit"), True).alias("unit_invalid"),
    )
    out = pairs.join(own, "pair_id", "left")
    for c in ("door_invalid", "unit_invalid"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    out = out.withColumn("label", F.coalesce("builtin", "door")).withColumn("human", F.col("builtin").isNull())
    if scores is not None:
        out = out.join(scores.select("pair_id", F.col("score").alias("frozen")), "pair_id", "left")
    else:
        out = out.withColumn("frozen", F.lit(None).cast("double"))
    return out.withColumn("score", F.coalesce("frozen", live))


def label_buckets(merged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """section, bucket, tp, fp, fn, tn, precision, recall, f1 (null where undefined).

    Sections: door (overall, human, each group), transform (each), split (known
    and novel spellings), unit (unit_overall, each group).
    """
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 < threshold <= 1:
        raise ValueError(f"threshold must be in (0, 1]: {threshold!r}")
    hit = F.col("score") >= threshold
    row = lambda section, bucket, label: F.struct(F.lit(section).alias("section"), bucket.alias("bucket"), label.alias("label"))
    door = F.col("label")
    scored_unit = F.when(F.col("human") & (door == "yes") & F.col("unit").isin("yes", "no"), F.col("unit"))
    buckets = [
        row("door", F.lit("overall"), door),
        row("door", F.col("grp"), door),
        F.when(F.col("human"), row("door", F.lit("human"), door)),
        F.when(F.col("transform").isNotNull(), row("transform", F.col("transform"), door)),
        F.when(F.col("transform").isNotNull(), row("split", F.when(F.col("transform").startswith("novel_"), "novel").otherwise("known_vocab"), door)),
        F.when(scored_unit.isNotNull(), row("unit", F.lit("unit_overall"), scored_unit)),
        F.when(scored_unit.isNotNull(), row("unit", F.col("grp"), scored_unit)),
    ]
    rows = merged.filter(door.isin("yes", "no")).select(hit.alias("hit"), F.explode(F.array_compact(F.array(*buckets))).alias("b"))
    yes = F.col("b.label") == "yes"
    counted = rows.groupBy("b.section", "b.bucket").agg(F.count_if(yes & F.col("hit")).alias("tp"), F.count_if(~yes & F.col("hit")).alias("fp"), F.count_if(yes & ~F.col("hit")).alias("fn"), F.count_if(~yes & ~F.col("hit")).alias("tn"))
    return counted.select("*", *precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"), None))


def label_coverage(merged: DataFrame) -> DataFrame:
    """One row over the pairs that people label: labelled, unsure, blank, invalid, and the units' counts."""
    h = merged.filter("human")
    door, unit = F.col("label"), F.col("unit")
    decided = door.isin("yes", "no")
    fine = decided & ~F.col("unit_invalid")
    return h.agg(
        F.count(F.lit(1)).alias("human_pairs"), F.count_if(decided).alias("labeled"), F.count_if(door == "unsure").alias("unsure"),
        F.count_if(door.isNull() & ~F.col("door_invalid")).alias("blank"), F.count_if(door.isNull() & F.col("door_invalid")).alias("invalid"),
        F.try_divide(F.lit(100.0) * F.count_if(decided), F.count(F.lit(1))).alias("coverage_pct"),
        F.count_if(decided & F.col("unit_invalid")).alias("unit_invalid"), F.count_if(fine & (door == "no") & unit.isin(*DOOR)).alias("unit_ignored"),
        F.count_if(fine & (door == "yes") & (unit == "yes")).alias("unit_yes"), F.count_if(fine & (door == "yes") & (unit == "no")).alias("unit_no"),
        F.count_if(fine & (door == "yes") & (unit == "unsure")).alias("unit_unsure"), F.count_if(fine & (door == "yes") & (unit.isNull() | (unit == "n/a"))).alias("unit_na"),
    )


def unknown_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(pairs.select("pair_id"), "pair_id", "left_anti").select("pair_id")


def worst(merged: DataFrame, threshold: float = THRESHOLD, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """False positives by score from above, false negatives from below."""
    hit = F.col("score") >= threshold
    fp = merged.filter(hit & (F.col("label") == "no")).orderBy(F.desc("score"), "pair_id").limit(top)
    fn = merged.filter(~hit & (F.col("label") == "yes")).orderBy("score", "pair_id").limit(top)
    return fp, fn
