"""Tables as Parquet, spread over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files give fewer.

    A small file of one row group would put all parsing on one core. Large
    tables have more splits than cores and pass as they are, without a shuffle.
    Give it a plain scan, so that counting its partitions starts no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the tables it names, without leaving views behind."""
    tables = {}
    for name in ("customer", "orders", "labels", "nation"):
        for word in ("FROM", "JOIN"):
            if f"{word} {name}" in sql:
                sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
                tables[name] = read_table(spark, sf_dir, name)
    return spark.sql(sql, **tables)
