"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_html_extraction": html_extract.op3_html_extraction,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_warc": warc.op6_warc,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_packing": packing.op8_packing,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op4_mixing": mixing.OP4_SQL}
