"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are range-sorted by (source,
key), so a large source spans many partitions; a prefix sum of word counts is
taken inside each range and carried from range to range, and a source is cut at
exactly its budget. A budget above the source's size takes whole epochs first.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share
the mix; a target stops at ``max_epochs`` times its source's size and what it
leaves is shared among the others by weight until none is above.

Defined cases: null text has size 0 and takes 0; the null source is a source of
its own, after all others; repeated rows are documents of their own (the rows of
a tie in (key, doc_id, size) are alike, so either order gives the same rows); an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, table
from .words import WORD, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7


def random_key(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """The same key in every run; 128 bits, so order is as good as random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def prefix_sums(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over earlier rows of the group.

    Rows are dealt out by ranges of (group, order): a group may span many
    ranges. Inside a range a window sums; the ranges' totals, one row a range
    and group, are summed over the ranges of each group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col(group).asc_nulls_last(), *[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    inside = Window.partitionBy("_range", group).orderBy(*order)
    local = ranged.withColumn("_local", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    totals = ranged.groupBy("_range", group).agg(F.sum(value).alias("_total"))
    before = totals.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_total").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = local.join(before, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(out, F.col("_local") + F.col("_before")).drop("_range", "_local", "_r", "_g", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The level at which unbounded sources share is found by rounds of capping:
    each round is one aggregate over the table of sources, and only its three
    sums come to the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = materialize(by, "sources")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picks = F.lit(None)
    for i, w in enumerate(weights):
        picks = F.when(place % len(weights) == i, w).otherwise(picks)
    by = materialize(by.withColumn("weight", picks.cast("long")).withColumn("cap", F.col("source_size") * max_epochs), "weighted-sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        n, caps, free = by.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        level, capped = (total - caps) / free, n
    return by.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), random_key(id_col, seed).alias("key"))
    sizes = materialize(sizes, "sizes")
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets")
    summed = prefix_sums(sizes, "source", ["key", "doc_id", "size"], "size", "before")
    joined = summed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("div(cast(round(target) as bigint), greatest(source_size, 1L))")).otherwise(0)
    rest = F.when(F.col("source_size") > 0, budget - epochs * F.col("source_size")).otherwise(0)
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **how) -> DataFrame:
    """The mix itself: a row for each epoch of a document, and the document that
    straddles its source's budget cut after the last word taken.

    Columns are those of docs. Documents of no words are in no mix. Rows that
    share an id and text share the decision of one of them.
    """
    how = {"id_col": id_col, "text_col": text_col, "source_col": source_col} | how
    decided = mix_sources(docs, **how).filter("taken > 0").groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("taken")).alias("all_taken"))
    decided = decided.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("all_taken")[0].alias("taken"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(text_col).alias("size"))
    joined = keyed.join(decided, F.col("id").eqNullSafe(F.col("_id")) & F.col("src").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("cast(div(taken - 1, size) as int)")))).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).cast("int"))
    whole = F.col(f"row.`{text_col}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(text_or_empty(f"row.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("words")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(whole)
    out = copies.withColumn("new_text", text)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("new_text").alias(c))
        elif c == chars_col:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("words") < F.col("size"), F.length("new_text").cast(kind)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap FROM s),
r AS (
  SELECT *, CAST(sum(cap) OVER p - cap AS DOUBLE) AS caps_before,
         CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS free,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
o AS (SELECT (total - caps_before) / free AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM r
      WHERE weight * ((total - caps_before) / free) <= cap),
l AS (SELECT coalesce(min(level), 0) AS level FROM o WHERE place = 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM w, l),
b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM b
"""
