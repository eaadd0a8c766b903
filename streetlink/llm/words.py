"""Words, white space and row keys, as all operators here define them.

White space is the six characters space, tab, line feed, vertical tab, form feed
and carriage return; a word is a run of anything else. On UTF-8 bytes that is
exactly what ``bytes.split()`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Words of a text; a null has none."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def text_key(*cols: str) -> Column:
    """With doc_id, the key by which a row finds its own results again.

    Rows with the same doc_id and text have the same results, so repeated rows
    may share a key.
    """
    return F.xxhash64(*[F.col(c) for c in cols]).alias("text_key")


def map_arrow(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str, flush: int = 8192) -> DataFrame:
    """mapInArrow for a function from dict rows to dict rows, sent in bounded batches.

    A batch leaves when it has ``flush`` rows or about 8 MB of text and bytes.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from batch.slice(at, 256).to_pylist()

        held: dict[str, list] = {n: [] for n in names}
        count = size = 0
        for row in rows(unpacked()):
            for n in names:
                v = row[n]
                held[n].append(v)
                if isinstance(v, (str, bytes)):
                    size += len(v)
            count += 1
            if count >= flush or size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)
                held, count, size = {n: [] for n in names}, 0, 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
