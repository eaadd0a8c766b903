"""A strict CSV base: a header, named columns, exact quotes and bytes.

Spark's own reader forgives an unclosed quote, text after a closing quote and
bytes that are not in the charset, and refuses short rows; a base of addresses
needs the reverse. This data source reads each file with a strict reader, one
partition a file, and says the line of what it refuses.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank


class BaseFileError(ValueError):
    """The file cannot be read as a base of addresses."""


def read_rows(data: bytes, id_column: str, address_column: str, encoding: str = "utf-8", path: str = "") -> Iterator[tuple[str, str | None]]:
    """(id, address) of each row; a short row has a null address."""
    try:
        text = data.decode(encoding)
    except (UnicodeDecodeError, LookupError) as e:
        raise BaseFileError(f"{path}: {e}") from e
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=True)
    try:
        header = next(reader, None)
        if not header:
            raise BaseFileError(f"{path}: the file has no header")
        missing = [c for c in (id_column, address_column) if c not in header]
        if missing:
            hint = "; is the delimiter a comma?" if len(header) == 1 and any(d in header[0] for d in ";\t|") else ""
            raise BaseFileError(f"{path}: no column {', '.join(missing)} among {header}{hint}")
        at_id, at_address = header.index(id_column), header.index(address_column)
        for row in reader:
            if not row:
                continue
            if any(x for x in row[len(header) :]):
                raise BaseFileError(f"{path}: line {reader.line_num} has more fields than the header")
            yield (row[at_id] if at_id < len(row) else ""), (row[at_address] if at_address < len(row) else None)
    except csv.Error as e:
        raise BaseFileError(f"{path}: line {reader.line_num}: {e}") from e


def read_base_rows(spark: SparkSession, path: str, id_column: str, address_column: str, encoding: str = "utf-8") -> DataFrame:
    """(record_id, address, ordinal, blank_id) of all files of a path.

    Files come through Spark's binary reader, so any store that Spark reads will
    do; each file (2 GB at most) is one task, which hands its rows on as it reads them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = enumerate(read_rows(bytes(content), id_column, address_column, encoding, p))
                while part := list(islice(rows, 50_000)):
                    yield pd.DataFrame({"record_id": [r[0] for _, r in part], "address": [r[1] for _, r in part], "file": p, "line": [i for i, _ in part]})

    rows = files.mapInPandas(run, "record_id string, address string, file string, line long")
    return rows.select("record_id", "address", F.struct("file", "line").alias("ordinal"), is_blank(F.col("record_id")).alias("blank_id"))


def read_base(spark: SparkSession, path: str, id_column: str, address_column: str, encoding: str = "utf-8") -> DataFrame:
    """(record_id, address, ordinal) of all files of a path, rows without an id left out."""
    return read_base_rows(spark, path, id_column, address_column, encoding).filter("not blank_id").drop("blank_id")
