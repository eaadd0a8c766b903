"""Harmonic packing of token ids into sequences.

Whole sequences are cut from a long document first. What is left is cut into
pieces whose lengths are reciprocal parts of the capacity (capacity // k), the
largest that fits first; class k fills its bins with exactly k pieces, so a full
bin has at most a few free places. Each worker fills its own bins while it reads
its rows and nothing is shuffled. Pieces of bins that are not full at the end of
a partition (less than one bin a class) are laid end to end, and their last
sequence is cut down to powers of two, which need no padding.

Defined cases: null text is empty and packs as its end id alone; a document's
pieces may repeat if its row is repeated; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table
from .tokens import default_file, encoder
from .words import map_arrow, text_or_empty

CAPACITY = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def classes(capacity: int = CAPACITY, finest: int = 64) -> list[tuple[int, int]]:
    """(piece length, pieces a bin), longest first: every reciprocal down to
    capacity // finest, then halves down to single ids."""
    out = [(capacity // k, k) for k in range(1, finest + 1)]
    size = capacity // finest
    while size > 1:
        size //= 2
        out.append((size, capacity // size))
    seen: dict[int, int] = {}
    for length, k in out:
        seen.setdefault(length, capacity // length if length else k)
    return sorted(seen.items(), reverse=True)


class Packer:
    """One worker's bins. ``add`` yields the pieces of bins that became full."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.classes = capacity, classes(capacity)
        self.bins: dict[int, list[tuple]] = {length: [] for length, _ in self.classes}
        self.next_id = worker << 40

    def _sequence(self, pieces: list[tuple]) -> Iterator[dict]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            yield {"doc_id": doc_id, "start": start, "length": n, "ids_crc32": zlib.crc32(ids), "doc_tokens": total, "sequence_id": self.next_id, "offset": offset}
            offset += n
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        total, start = len(ids) // 4, 0
        for length, k in self.classes:
            while total - start >= length:
                pieces = self.bins[length]
                pieces.append((doc_id, start, ids[4 * start : 4 * (start + length)], total))
                start += length
                if len(pieces) == k:
                    yield from self._sequence(pieces)
                    self.bins[length] = []

    def finish(self) -> Iterator[dict]:
        rest = [p for length, _ in self.classes for p in self.bins[length]]
        left = sum(len(p[2]) // 4 for p in rest)
        room = size = 0
        held: list[tuple] = []
        for doc_id, start, ids, total in rest:
            while ids:
                if not room:
                    size = room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * n], total))
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    yield from self._sequence(held)
                    held = []


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence."""
    path = tokenizer or default_file()
    end = end_id.to_bytes(4, "little")

    def rows(docs: Iterator[dict]) -> Iterator[dict]:
        encode, packer = encoder(path).encode, None
        for row in docs:
            packer = packer or Packer(row["worker"], capacity)
            yield from packer.add(row["doc_id"], encode(row["text"]) + end)
        if packer:
            yield from packer.finish()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.spark_partition_id().alias("worker"))
    return map_arrow(narrow, rows, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
