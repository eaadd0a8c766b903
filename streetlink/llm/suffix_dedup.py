"""Suffix dedup: bytes covered by 100-byte strings that also start earlier.

A common-prefix-aware distributed merge sort. Suffixes are taken at minimisers
(every 100-byte string has one, at the same place wherever the string stands) and
ordered by a hash of their first 32 bytes, which spreads them evenly over ranges,
and then as text. Each task sorts its suffixes and front-codes them; the sorted
runs are exchanged by ranges, and a loser tree combines them without comparing a
known prefix again. It tells what neighbours share, and that decides: a string
that reaches a bytes back from its minimiser stands in two places if the suffixes
there share 100 - a bytes or more and the texts before them a bytes; the earliest
is kept (see ``repeats``).

Sorting one suffix for every byte would move the text a hundred times over; one
for each minimiser decides the same strings.

Defined cases: null text is empty; texts under 100 bytes lose nothing; strings
never cross documents; rows with the same id and text are one document and each
gets its result; a null id is smaller than all others; an empty table gives no
rows. What is left may end inside a character, so it is given as a digest or as
bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import HOT, NULL_ID, Bytes, covered, keyed, loser_tree_merge, repeated_spans
from .store import table
from .words import map_arrow

WIDTH = 100
GRAM = 32


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes)."""
    units = Bytes(width, gram)
    rows = keyed(docs, id_col, text_col)
    spans, texts = repeated_spans(rows, units, "earlier", loser_tree_merge, hot)

    def cut(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            raw = units.split(r["text"])
            kept, at, gone, found = [], 0, 0, covered(r["spans"], width)
            for a, b in found:
                kept.append(raw[at:a])
                gone, at = gone + b - a, b
            left = b"".join([*kept, raw[at:]])
            yield {"cut_id": r["id"], "cut_key": r["key"], "n_removed": gone, "n_spans": len(found), "sha": hashlib.sha256(left).hexdigest(), "cut_bytes": left if with_bytes else None}

    done = map_arrow(texts.join(spans.hint("merge"), ["id", "key"]), cut, "cut_id long, cut_key long, n_removed long, n_spans long, sha string, cut_bytes binary")
    base = rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha"), *([F.encode("text", "utf-8").alias("whole_bytes")] if with_bytes else []))
    out = base.join(done, (F.col("id") == F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    cols = [F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("cut_bytes", "whole_bytes").alias("kept_bytes")] if with_bytes else []))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))
