"""Substring dedup: words covered by windows of 35 words that also start elsewhere.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as
one packed string to its bucket, where sorting brings equal strings together and
windows are counted exactly (see ``repeats``).

Defined cases: null text has no words; a text of fewer words than a window loses
none; windows never cross documents; rows with the same id and text are one
document and each gets its result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import HOT, NULL_ID, Words, covered, keyed, repeated_spans, sort_merge
from .store import table
from .words import map_arrow

WIDTH = 35
GRAM = 8


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    units = Words(width, gram)
    rows = keyed(docs, id_col, text_col)
    spans, texts = repeated_spans(rows, units, "any", sort_merge, hot)

    def cut(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            words = units.split(r["text"])
            kept, at, gone = [], 0, 0
            for a, b in covered(r["spans"], width):
                kept += words[at:a]
                gone, at = gone + b - a, b
            text = b" ".join(kept + words[at:])
            yield {"cut_id": r["id"], "cut_key": r["key"], "n_removed": gone, "sha": _sha(text), "cut_text": text.decode("utf-8", "surrogatepass") if with_text else None}

    def whole(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            words = units.split(r["text"])
            text = b" ".join(words)
            yield {"id": r["id"], "key": r["key"], "n_words": len(words), "whole_sha": _sha(text), "whole_text": text.decode("utf-8", "surrogatepass") if with_text else None}

    done = map_arrow(texts.join(spans.hint("merge"), ["id", "key"]), cut, "cut_id long, cut_key long, n_removed long, sha string, cut_text string")
    base = map_arrow(rows, whole, "id long, key long, n_words long, whole_sha string, whole_text string")
    out = base.join(done, (F.col("id") == F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    cols = [F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole_sha").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("cut_text", "whole_text").alias("kept_text")] if with_text else []))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))
