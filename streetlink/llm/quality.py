"""Quality rules: per-document rules and cross-document line frequency.

Base rules look at one document. The line rule hashes normalised lines (lower
case, white space as one blank), counts for each host (the source) in how many
distinct documents a line occurs, and removes lines above the host's limit:
those are its templates. A document of which too little is left is rejected; the
others are given without those lines.

So that copies of a good document do not count as a template: exact copies count
once, the limit grows with the host (with the root of its documents, so that it
does not loosen in proportion), and the first document (smallest id) that has a
line keeps it, so one of a group always survives.

Defined cases: null text has no words and fails the base rules; a null source is
a host of its own; rows with the same id, source and text share one verdict; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, table
from .words import WORD, map_arrow, text_key, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is a template if it is in more documents than LINE_DOCS. Where that is less than
#: LINE_SHARE of a host's documents, the limit grows with the root of their number.
LINE_SHARE = 0.1
LINE_DOCS = 20
#: A document is depleted if fewer words than both of these are left.
KEPT_SHARE = 0.3

SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(text) - len(text.translate(SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), chars, symbols, dup, _repeated(words)


def _repeated(words: list[bytes], width: int = 3) -> int:
    """Words in windows of three words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, n)
    if len(number) < 1 << 21:
        k = np.uint64(len(number))
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        _, keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - width + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(width):
        covered[i : n - width + 1 + i] |= twice
    return int(covered.sum())


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Rows under names of our own, whatever else docs has."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text"))
    return named.withColumn("text_key", text_key("host", "text"))


def _line_norm(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def template_lines(keyed: DataFrame) -> DataFrame:
    """(doc_id, text_key, removed, gone): a document's words in its host's template lines, and the hashes of those lines."""
    lines = keyed.select("doc_id", "text_key", "host", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "text_key", "host", F.xxhash64(_line_norm(F.col("line"))).alias("h"), F.regexp_count("line", F.lit(WORD)).alias("words")).filter("words > 0")
    lines = lines.groupBy("doc_id", "text_key", "host", "h").agg(F.sum("words").alias("words"))
    lines = materialize(lines, "lines")
    rows = materialize(keyed.groupBy("doc_id", "text_key", "host").agg(F.count(F.lit(1)).alias("rows")), "row-counts")
    hosts = rows.groupBy("host", "text_key").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("docs")).withColumn("limit", LINE_DOCS * F.sqrt(F.greatest(F.col("docs") * LINE_SHARE / LINE_DOCS, F.lit(1.0))))
    # a text counts once, with the smallest id that has it
    texts = lines.groupBy("host", "h", "text_key").agg(F.min("doc_id").alias("first"))
    freq = texts.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).filter(F.col("n") > LINE_DOCS)
    hosts = hosts.select(F.col("host").alias("_host"), "limit")
    over = materialize(freq.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter("n > limit").select(F.col("host").alias("_host"), F.col("h").alias("_h"), "first"), "template-lines")
    hit = lines.join(over.hint("merge"), F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")) & ~F.col("doc_id").eqNullSafe(F.col("first")))
    found = hit.groupBy("doc_id", "text_key").agg(F.sum("words").alias("removed"), F.collect_list("h").alias("gone"))
    # repeated rows were summed; each has its equal share
    repeated = rows.filter("rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "rows")
    found = found.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return materialize(found.select("doc_id", "text_key", F.expr("removed div coalesce(rows, 1)").alias("removed"), "gone"), "document-templates")


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are in gone; the text as it is where gone is null."""
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(gone, F.xxhash64(_line_norm(line)))), "\n")
    return F.when(gone.isNull(), text).otherwise(left)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", with_text: bool = False) -> DataFrame:
    """One row per document with its base counts, base_failed, removed_words, kept and gone.

    With ``with_text`` also kept_text: the text of a kept document without its template lines.
    """
    keyed = _keyed(docs, id_col, text_col, host_col)
    extra = ", text string" if with_text else ""

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            n, chars, symbols, dup, repeat = base_stats(r["text"])
            yield {"doc_id": r["doc_id"], "text_key": r["text_key"], "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "text": r["text"]}

    base = map_arrow(keyed.select("doc_id", "text_key", "text"), rows, "doc_id long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long" + extra)
    removed = template_lines(keyed).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed", "gone")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    if with_text:  # only texts that may be kept travel
        base = base.withColumn("text", F.when(~failed, F.col("text")))
    joined = base.join(removed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    gone = F.coalesce("removed", F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & (left < MIN_WORDS) & (left < F.col("n_words") * KEPT_SHARE)
    kept = ~failed & ~depleted
    text = [F.when(kept, without_lines(F.col("text"), F.col("gone"))).alias("kept_text")] if with_text else []
    return joined.select("doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.cast("long").alias("removed_words"), kept.alias("kept"), "gone", *text)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The documents that pass, with all their columns and their text without its template lines."""
    kept = quality_verdicts(docs, id_col, text_col, host_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "gone").dropDuplicates(["_id", "_key"])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(host_col).cast("string"), text_or_empty(text_col)).alias("key"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    text = without_lines(F.col("row")[text_col], F.col("gone"))
    new = {text_col: text}
    if chars_col in docs.columns:
        chars = F.col("row")[chars_col]
        new[chars_col] = F.when(F.col("gone").isNull(), chars).otherwise(F.length(text).cast(docs.schema[chars_col].dataType))
    return keyed.join(kept.hint("merge"), same).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(table(spark, sf_dir, "documents"), with_text=True)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "kept_text")
