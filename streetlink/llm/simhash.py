"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits or more is cut into segments. If two fingerprints differ
in at most r bits, then for m segments with r = m * q + a they agree up to q bits
in one of the first a + 1 segments, or up to q - 1 bits in one of the others. Each
distinct fingerprint is therefore entered under the values in a small Hamming ball
around each of its segments, and looks up those in another: two balls whose radii
sum to q meet if the segments differ in q bits or fewer. What is met is verified
with the complete distance.

Groups of near copies make buckets in which nearly all pairs are links. A bucket
never emits pairs: it is reduced where it lies to a spanning forest of its links
(one row a fingerprint at most), which keeps every connection. Buckets above
``BUCKET`` fingerprints are not handled in one task, see ``crowded_links``.

Two settings are used. ``simhash_components`` with its defaults: four words, 64
bits, at most 4 different. ``drop_near_copies``: five words and a similarity of
0.8 or more, told by 128 bits: two sets of shingles that share 0.8 of their union
differ in 19.4 bits on average, with a standard deviation of 4.1, so up to one
deviation more, 23 bits, are links. Below 0.7 few pairs come that near, and
unrelated texts differ in 64 bits, eleven deviations away.

Defined cases: null and empty texts have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; repeated rows link at
distance zero; documents with null doc_id take part, and a component whose
documents have no id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import materialize, table
from .words import text_or_empty

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: The pipeline's near copies: words a shingle, similarity, and 64-bit words of a fingerprint.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8
NEAR_WORDS = 2
#: Fingerprints of a bucket that one task compares.
BUCKET = 16384


def distance_for(similarity: float, bits: int, deviations: float = 1.0) -> int:
    """Bits in which two texts differ whose shingle sets share ``similarity`` of their
    union: the mean, and so many standard deviations more. A bit differs with the
    angle between the two sets as vectors."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + deviations * sqrt(bits * share * (1 - share)))


def _hashes(text: str | None, width: int) -> np.ndarray:
    """The hash of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def _another(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash made of each hash; the first is the hash itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint_words(text: str | None, width: int = SHINGLE, words: int = 1) -> list[int]:
    """The SimHash of a text as 64-bit words; zeros without words."""
    hashes, out = _hashes(text, width), []
    for k in range(words):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            part = _another(hashes[at : at + 65536], k).astype(">u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big"))
    return out


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; zero without words."""
    return fingerprint_words(text, width)[0]


def _sql_type(words: int) -> str:
    return "long" if words == 1 else "binary"


def _column(fp: np.ndarray) -> pa.Array:
    """Fingerprints (a row of 64-bit words each) as a column: a long, or big-endian bytes if there are more words."""
    if fp.shape[1] == 1:
        return pa.array(fp[:, 0].view(np.int64))
    raw = np.ascontiguousarray(fp).astype(">u8").tobytes()
    size = 8 * fp.shape[1]
    offsets = np.arange(0, len(raw) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _array(column: pa.Array, words: int) -> np.ndarray:
    if words == 1:
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, words: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, or as bytes if it has more words than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fps = np.array([fingerprint_words(t.as_py(), width, words) for t in batch.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), _column(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id long, fp {_sql_type(words)}")


def segments_for(n: int, distance: int = DISTANCE, bits: int = 64) -> int:
    """Segments that keep both buckets and balls small for n fingerprints: the most
    whose values outnumber the fingerprints by the size of a ball, or nearly so."""
    if bits == 64 and distance == DISTANCE:
        return 4 if n < 1 << 22 else 3 if n < 1 << 30 else 2
    words = bits // 64
    for m in range(max(2, (distance + 1) // 3 // words) * words, 2 * words, -words):
        if n < 64 << (bits // m):
            return m
    return 2 * words


def plan(m: int, distance: int = DISTANCE, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment; a radius below zero needs no look-up. No segment crosses a 64-bit word."""
    q, a = divmod(distance, m)
    each = m // (bits // 64)
    edges = [64 * w + 64 * i // each for w in range(bits // 64) for i in range(each)] + [bits]
    return [(lo, hi - lo, q if i <= a else q - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def _ball(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def bucket_rows(fps: DataFrame, m: int, distance: int = DISTANCE, words: int = 1) -> DataFrame:
    """(bucket, fp, entry): entry true where fp stands in the table, false where it only looks up."""
    segs = plan(m, distance, 64 * words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fp = _array(batch.column(0).slice(at, 2048), words)
                for i, (shift, bits, radius) in enumerate(segs):
                    if radius < 0:
                        continue
                    flips = _ball(bits, radius - radius // 2)
                    stands = np.bitwise_count(flips) <= radius // 2
                    value = ((fp[:, shift // 64] >> np.uint64(shift % 64)) & np.uint64((1 << bits) - 1))[:, None] ^ flips[None, :]
                    bucket = value.ravel().view(np.int64) | np.int64(i << 40)
                    entry = np.broadcast_to(stands, value.shape).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), _column(np.repeat(fp, len(flips), axis=0)), pa.array(entry)], ["bucket", "fp", "entry"])

    return fps.mapInArrow(run, f"bucket long, fp {_sql_type(words)}, entry boolean")


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of words differ."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.uint16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def forest(fp: np.ndarray, entry: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints that look up and entries, as pairs of places.

    Grows trees from unreached fingerprints, comparing one against all that are
    still unreached, so memory stays linear.
    """
    out: list[tuple[int, int]] = []
    if len(fp) <= 256:  # mostly unrelated fingerprints: one look tells
        near = _gap(fp[:, None], fp[None, :]) <= distance
        if not (np.triu(near, 1) & (entry[:, None] | entry[None, :])).any():
            return out
    alive = np.arange(len(fp))
    while len(alive) > 1:
        front, alive = [alive[0]], alive[1:]
        while front and len(alive):
            x = front.pop()
            near = _gap(fp[alive], fp[x]) <= distance
            if not entry[x]:
                near &= entry[alive]
            if near.any():
                hit = alive[near].tolist()
                out += [(int(x), y) for y in hit]
                front += hit
                alive = alive[~near]
    return out


def _bucket_links(rows: DataFrame, distance: int, words: int = 1) -> DataFrame:
    """rows (bucket, fp, entry) sorted by bucket within partitions; a bucket has BUCKET rows at most, or a few times that."""

    def links(fp: np.ndarray, entry: np.ndarray) -> list[np.ndarray]:
        if len(fp) < 2 or not entry.any():
            return []
        found = forest(fp, entry, distance)
        return [fp[np.array(found)]] if found else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(zero_copy_only=False), _array(batch.column(1), words), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)]
            if kept:
                now = [np.concatenate(x) for x in zip(kept, now)]
            cuts = np.flatnonzero(np.diff(now[0])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            bounds = [0, *cuts.tolist()]
            out = [e for a, b in zip(bounds, bounds[1:]) if b - a > 1 for e in links(now[1][a:b], now[2][a:b])]
            kept = [x[last:] for x in now]
            if out:
                yield _links_batch(out)
        if kept and (out := links(*kept[1:])):
            yield _links_batch(out)

    kind = _sql_type(words)
    return rows.select("bucket", "fp", "entry").mapInArrow(run, f"u {kind}, v {kind}")


def _links_batch(links: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(links)
    return pa.RecordBatch.from_arrays([_column(both[:, 0]), _column(both[:, 1])], ["u", "v"])


def ball_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links of fps through the common points of their balls of half the distance.

    Each point links all that reach it to the smallest of them: any two of them
    differ in at most ``distance`` bits, and any two that do share a point.
    """
    if distance % 2:
        raise ValueError("the distance must be even")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = _ball(64, distance // 2)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                fp = batch.column(0).slice(at, 256).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                point = (fp[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(point.view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(flips)))], ["point", "fp"])

    points = fps.mapInArrow(run, "point long, fp long")
    least = points.groupBy("point").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("point", "u")
    return points.join(least, "point").filter("fp <> u").select("u", F.col("fp").alias("v")).distinct()


def _apart(a: Column, b: Column, words: int) -> Column:
    """Bits in which two fingerprints of a column differ."""
    if words == 1:
        return F.bit_count(a.bitwiseXOR(b))
    part = lambda c, i: F.conv(F.substring(F.hex(c), 8 * i + 1, 8), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(2 * words):
        total += F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return total


def crowded_links(rows: DataFrame, sizes: DataFrame, distance: int, words: int, bucket: int = BUCKET) -> DataFrame:
    """Links inside buckets (bucket, fp, entry) of more than ``bucket`` rows; sizes: (bucket, n).

    A bucket is dealt out in chunks by hash. First each chunk is reduced to its
    forest, and every fingerprint near the bucket's smallest is linked to that one.
    What is connected by then needs no more comparing: only fingerprints outside the
    bucket's largest component are compared with all chunks, in blocks. So a group
    of near copies of any size costs rows in proportion to it, and no link that
    would connect anything is left out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(sizes.hint("merge"), "bucket").withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    dealt = materialize(dealt.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")), "crowded-rows")

    def reduced(some: DataFrame, *unit: str) -> DataFrame:
        """The forests of units, told apart by a hash of the bucket and the unit."""
        named = some.select(F.xxhash64("bucket", *unit).alias("unit"), "fp", "entry").repartition(parts, "unit").sortWithinPartitions("unit")
        return _bucket_links(named.select(F.col("unit").alias("bucket"), "fp", "entry"), distance, words)

    least = materialize(dealt.filter("entry").groupBy("bucket").agg(F.min("fp").alias("least")), "crowded-least")
    star = dealt.join(least.hint("merge"), "bucket").filter(F.col("fp") != F.col("least")).filter(_apart(F.col("fp"), F.col("least"), words) <= distance)
    links = materialize(star.select(F.col("least").alias("u"), F.col("fp").alias("v")).union(reduced(dealt, "chunk")), "crowded-links")
    roots = components(links)
    rooted = materialize(dealt.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "crowded-roots")
    largest = rooted.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum("count").alias("n"), F.max("count").alias("most"))
    largest = materialize(largest.withColumn("blocks", F.ceil((F.col("n") - F.col("most")) / bucket).cast("int")).filter("blocks > 0").drop("n", "most"), "crowded-largest")
    told = rooted.join(largest.hint("merge"), "bucket")
    outside = F.col("root") != F.col("largest")
    block = F.when(outside, F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    # every chunk meets every block of the others; one that is outside is not entered twice
    met = told.withColumn("own", block).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("own is null or own <> block")
    others = told.filter(outside).withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    same = ["bucket", "chunk", "block", "fp", "entry"]
    return links.union(reduced(met.select(*same).union(others.select(*same)), "chunk", "block"))


def near_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, words: int = 1) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp): enough of them to
    connect whatever is connected, each within the distance."""
    m = segments_for(fps.count(), distance, 64 * words)
    rows = bucket_rows(fps, m, distance, words)
    crowded = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket), "crowded-buckets")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if crowded.isEmpty():
        return _bucket_links(rows.repartition(parts, "bucket").sortWithinPartitions("bucket"), distance, words)
    normal = rows.join(crowded.hint("merge"), "bucket", "left_anti").select("bucket", "fp", "entry")
    normal = _bucket_links(normal.repartition(parts, "bucket").sortWithinPartitions("bucket"), distance, words)
    if words == 1 and distance == DISTANCE:
        return normal.union(ball_links(rows.join(crowded.hint("merge"), "bucket").select("fp").distinct(), distance))
    return normal.union(crowded_links(rows, crowded, distance, words, bucket))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, bucket: int = BUCKET, width: int = SHINGLE, words: int = 1
) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable)."""
    prints = materialize(with_fingerprints(docs, id_col, text_col, width, words), "fingerprints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    links = near_links(fps.select("fp"), distance, bucket, words)
    roots = components(links)
    rooted = materialize(fps.join(roots.hint("merge"), fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    # written first: a join of two plain shuffles may be split at a root of many fingerprints
    ids = materialize(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    labels = materialize(rooted.join(ids.hint("merge"), "root").select("fp", "component_id"), "fingerprint-labels")
    return prints.join(labels.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int | None = None, bucket: int = BUCKET, width: int = NEAR_SHINGLE, words: int = NEAR_WORDS
) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Rows that share that id are one document and stay together; documents
    without an id stay.
    """
    if distance is None:
        distance = distance_for(NEAR_SIMILARITY, 64 * words)
    stay = simhash_components(docs, id_col, text_col, distance, bucket, width, words).filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_stay")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    same = keyed["id"].eqNullSafe(stay["_stay"])
    return keyed.join(stay.hint("merge"), same, "left_semi").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
