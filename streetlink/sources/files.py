"""Readers and writers of bases, pairs, labels, scores and reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import LabelError

#: Column names, file names, the header of the label sheet and what it adds to a query.
BASE_COLUMNS = ("direccion", "numero_predial_nacional", "manzana", "comuna", "barrio")
PAIR_FILES = (("candidates_to_label.jsonl", "candidate"), ("synthetic_positives.jsonl", "synthetic"), ("random_negatives.jsonl", "sanity"))
PAIR_SCHEMA = (
    "pair_id string, addr_a string, addr_b string, same_door boolean, tier string, transform string, source_direccion string, stratum string, "
    "npn_a string, npn_b string, comuna_a string, comuna_b string, barrio_a string, barrio_b string, same_manzana boolean"
)
SHEET = ("pair_id", "addr_a", "addr_b", "query_a", "query_b", "comuna_a", "comuna_b", "barrio_a", "barrio_b", "npn_a", "npn_b", "same_door", "same_unit", "evidence_source", "notes")
QUERY_SUFFIX = ", Cali, Valle del Cauca, Colombia"
ENV_BASE = "STREETLINK_BASE"


def read_parquet_base(spark: SparkSession, path: str | None = None, address: str = "direccion", parcel: str | None = "numero_predial_nacional") -> DataFrame:
    """address and parcel (null if the base has none); the path may come from the environment."""
    path = path or os.environ.get(ENV_BASE)
    if not path:
        raise ValueError(f"give a path or set {ENV_BASE}")
    df = spark.read.parquet(path)
    if address not in df.columns:
        raise ValueError(f"{path}: no column {address} among {df.columns}")
    return df.select(F.col(address).alias("address"), (F.col(parcel) if parcel and parcel in df.columns else F.lit(None)).cast("string").alias("parcel"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The five columns that pair building needs."""
    return spark.read.parquet(path).select(*BASE_COLUMNS)


def read_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """pair_id, addr_a, addr_b, kind, grp, transform, builtin of the pair files that are there."""
    found = []
    for name, kind in PAIR_FILES:
        path = f"{directory.rstrip('/')}/{name}"
        if not _exists(spark, path):
            continue
        rows = spark.read.schema(PAIR_SCHEMA).option("mode", "FAILFAST").json(path)
        builtin = F.lit(None).cast("string") if kind == "candidate" else F.when(F.coalesce("same_door", F.lit(False)), "yes").otherwise("no")
        grp = F.coalesce("stratum", F.lit("unknown")) if kind == "candidate" else F.lit(kind)
        transform = F.coalesce("transform", F.lit("unknown")) if kind == "synthetic" else F.lit(None).cast("string")
        found.append(rows.select("pair_id", "addr_a", "addr_b", F.lit(kind).alias("kind"), grp.alias("grp"), transform.alias("transform"), builtin.alias("builtin")))
    if not found:
        raise LabelError(f"no pair files found in {directory}")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    _once(pairs, "pair files")
    return pairs


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, same_door, same_unit as text, from CSV or JSON lines by the file's ending."""
    if path.lower().endswith((".jsonl", ".json", ".ndjson")):
        raw = spark.read.text(path).filter(F.trim("value") != "")
        kind = "map<string,string>"
        df = raw.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("m"))
        odd = df.filter(~F.map_contains_key("m", "same_door") | ~F.map_contains_key("m", "pair_id")).limit(1).collect()
        if odd:
            raise LabelError(f"{path}: a row without pair_id or same_door (a lone label column is not read): {odd[0].m}")
        df = df.select(*[F.try_element_at("m", F.lit(c)).alias(c) for c in ("pair_id", "same_door", "same_unit")])
    else:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        df = df.toDF(*[c.strip().lower().removeprefix("﻿") for c in df.columns])
        for c in ("pair_id", "same_door"):
            if c not in df.columns:
                raise LabelError(f"{path}: no column {c} among {df.columns}" + (" (label is read as same_door no longer)" if "label" in df.columns else ""))
        df = df.select("pair_id", "same_door", (F.col("same_unit") if "same_unit" in df.columns else F.lit(None).cast("string")).alias("same_unit"))
    df = df.withColumn("pair_id", F.trim("pair_id")).filter("pair_id <> ''")
    _once(df, path)
    return df


def read_scores(spark: SparkSession, path: str, name: str = "matcher_scores_sidecar.jsonl") -> DataFrame:
    """Frozen scores, from a file or the folder that has it."""
    path = path if path.endswith((".jsonl", ".json")) else f"{path.rstrip('/')}/{name}"
    df = spark.read.schema("pair_id string, score double").option("mode", "FAILFAST").json(path)
    if not df.filter("score is null").isEmpty():
        raise LabelError(f"{path}: a pair without a numeric score")
    return df


def _once(df: DataFrame, where: str) -> None:
    twice = df.groupBy("pair_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise LabelError(f"duplicate pair_id in {where}: {twice[0].pair_id!r}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def label_sheet(rows: list[dict], seed: int) -> str:
    """CSV for people: shuffled by hash, no stratum and no score, empty label cells."""
    order = sorted(rows, key=lambda r: hashlib.sha256(f"{seed}:{r['pair_id']}".encode()).hexdigest())
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(SHEET)
    for r in order:
        given = r | {"query_a": r["addr_a"] + QUERY_SUFFIX, "query_b": r["addr_b"] + QUERY_SUFFIX, "same_door": "", "same_unit": "", "evidence_source": "", "notes": ""}
        writer.writerow(["" if given.get(c) is None else given.get(c, "") for c in SHEET])
    return out.getvalue()


def write_text(files: dict[str, str], directory: str) -> dict[str, str]:
    """Write small driver-side files; gives their SHA-256."""
    os.makedirs(directory, exist_ok=True)
    out = {}
    for name, text in files.items():
        data = text.encode()
        with open(os.path.join(directory, name), "wb") as f:
            f.write(data)
        out[name] = hashlib.sha256(data).hexdigest()
    return out
