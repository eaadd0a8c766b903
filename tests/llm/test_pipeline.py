import brute
import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import frame
from test_others import ids

from streetlink.llm import queries
from test_dedup import corpus


def test_stages(spark, tmp_path):
    rows = corpus(9, 80)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    alive = {r["doc_id"]: r for r in rows}
    bad = {d for d, r in alive.items() if (q := brute.quality_base(r["text"]))[0] < 50 or 100 * q[4] > 50 * q[0]} | brute.template_rejects(rows)
    want = [r for r in rows if r["doc_id"] not in bad]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        if name == "exact_dedup":
            want = [r for r in want if r["doc_id"] in {k[0] for k in brute.exact(want) if k[3]}]
        if name == "near_dedup":
            roots = {v[1] for v in brute.near_copies(want).values()}
            want = [r for r in want if r["doc_id"] in roots]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(out := f"{tmp_path}/{name}")
        docs = spark.read.parquet(out)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r["doc_id"] for r in want)
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    mixed.write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    total = sum(len(brute.WORD.findall(r["text"])) for r in want)
    assert abs(words - total) <= 3
    packed = corpus_pipeline.packing(spark, mixed, str(tmp_path)).collect()
    texts = [r.text for r in mixed.collect()]
    assert sum(p.length for p in packed) == sum(len(ids(t)) + 1 for t in texts)


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and set(queries.oracle_sql()) <= set(names)
