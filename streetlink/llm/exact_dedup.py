"""Exact dedup (native): a persistent digest index, bucketed and sorted by hash.

The index is a table with one row per distinct text: its SHA-256, the document
that stays and the batch that brought it. It lies under a path and is reopened by
that path in any session. New documents are reduced to one row per digest before
the shuffle, sort-merge anti-joined against the index (whose side is read in its
buckets, without a shuffle) and appended; which document stays is then read back
from the index, for old and new digests alike.

A batch has a name. Rows that an earlier try of the same batch has appended are
found by that name, are not appended again, and do not make the batch's own
documents copies, so a batch that failed halfway is simply run again.

Defined cases: a null text counts as empty; texts are equal if they agree after
deleting every white-space character; of equal texts the row with most code
points stays, then the one with the smallest doc_id (nulls last), then, among
spellings of one id, the one whose row hashes lowest; of rows that agree in all
columns, one stays. A digest already in the index keeps its old document, and
every new row of it is dropped. An empty batch appends nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, scratch_path, table
from .words import SPACE, text_or_empty


def normal_digest(col: str = "text") -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(col), SPACE + "+", ""), 256))


def _row_hash(docs: DataFrame) -> Column:
    """Tells rows apart that agree in id and digest, the same way in every run."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`").alias("c"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A narrow row per document; the text itself is not shuffled."""
    return docs.select(
        F.col(id_col).alias("_id"),
        normal_digest(text_col).alias("_digest"),
        F.length(text_or_empty(text_col)).cast("long").alias("_points"),
        _row_hash(docs).alias("_hash"),
    )


def _keeper() -> Column:
    """Orders rows of a group: most code points, smallest id (nulls last), lowest hash, first row."""
    return F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_hash").alias("h"), F.col("_row").alias("r"))


class DigestIndex:
    """The index under ``path``; the same path reopens it, without one it lives for this use alone.

    The number of buckets is kept with the files as the name of an empty file, so
    a later session declares the table as the first one did. ``id_type`` is the
    type of the documents' ids.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.path = (path or scratch_path(spark, "digest-index")).rstrip("/")
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        self.buckets = self._bucket_count(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        self.spark.catalog.refreshTable(self.name)

    def _bucket_count(self, wanted: int) -> int:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.globStatus(hadoop.Path(folder, "_buckets_*")) or []]
        if len(found) > 1:
            raise ValueError(f"{self.path} has more than one bucket count: {found}")
        if found:
            return int(found[0].rsplit("_", 1)[1])
        if files.exists(hadoop.Path(folder, "rows")):
            raise ValueError(f"{self.path} has rows and no bucket count: it is not an index of this kind")
        files.mkdirs(folder)
        files.createNewFile(hadoop.Path(folder, f"_buckets_{wanted}"))
        return wanted

    def read(self) -> DataFrame:
        """(digest, keep_id, batch)."""
        return self.spark.table(self.name)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Dedupe ``docs`` against themselves and the index, and append what is new.

        Returns (rows, groups): rows has a row per document (_row, _id, _digest,
        _points, _hash); groups has a row per digest of this batch: keep_id (as the
        index has it), group_size (rows of this batch) and, where the digest is
        new, keep_row and keep_hash of the row that stays.
        """
        batch = batch or uuid.uuid4().hex
        rows = materialize(_row_keys(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "digest-rows")
        groups = rows.groupBy("_digest").agg(F.min(_keeper()).alias("k"), F.count(F.lit(1)).alias("n"))
        groups = materialize(groups.select("_digest", F.col("k.i").alias("own_id"), F.col("k.r").alias("keep_row"), F.col("k.h").alias("keep_hash"), F.col("n").alias("group_size")), "digest-groups")
        fresh = groups.join(self.read().select("digest").hint("merge"), F.col("_digest") == F.col("digest"), "left_anti")
        (fresh.select(F.col("_digest").alias("digest"), F.col("own_id").alias("keep_id"), F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest").write.mode("append").insertInto(self.name))
        known = groups.join(self.read().hint("merge"), F.col("_digest") == F.col("digest"))
        own = F.col("batch") == batch
        return rows, materialize(known.select("_digest", "keep_id", "group_size", F.when(own, F.col("keep_row")).alias("keep_row"), F.when(own, F.col("keep_hash")).alias("keep_hash")), "digest-verdicts")

    def close(self) -> None:
        """Forget the table's name in this session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _appended(docs: DataFrame, index: DigestIndex | None, id_col: str, text_col: str, batch: str | None) -> tuple[DataFrame, DataFrame]:
    if index is not None:
        return index.append(docs, id_col, text_col, batch)
    index = DigestIndex(docs.sparkSession, id_type=docs.schema[id_col].dataType.simpleString())
    try:
        return index.append(docs, id_col, text_col, batch)
    finally:
        index.close()


def exact_dedup_report(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The join on the digest has both sides in plain shuffles, so a digest that
    holds a third of all rows is split by adaptive execution.
    """
    rows, groups = _appended(docs, index, id_col, text_col, batch)
    return rows.join(groups.hint("merge"), "_digest").select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are found again by (id, digest, row hash), which is spread evenly: the
    many copies of one text have ids of their own. Rows that agree in every
    column fall together there and one of them stays.
    """
    _, groups = _appended(docs, index, id_col, text_col, batch)
    stay = groups.filter("keep_row is not null").select(F.col("keep_id").alias("_stay_id"), F.col("_digest").alias("_stay_digest"), F.col("keep_hash").alias("_stay_hash"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), normal_digest(text_col).alias("digest"), _row_hash(docs).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("_stay_id")) & (F.col("digest") == F.col("_stay_digest")) & (F.col("hash") == F.col("_stay_hash"))
    return keyed.join(stay.hint("merge"), same, "left_semi").dropDuplicates(["id", "digest", "hash"]).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_report(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS points
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, text_sha256 FROM g
"""
