import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.samples import SF, documents, empty_docs, odd_docs, rows
from tests.llm.test_groups import brute_components


def test_stages_one_after_another(spark, tmp_path):
    docs, n = documents(spark), documents(spark).count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
            assert {r["doc_id"] for r in rows(docs.select("doc_id"))} <= {r["doc_id"] for r in rows(before.select("doc_id"))}
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in rows(docs.select("doc_id"))}
            every = {r["doc_id"] for r in rows(before.select("doc_id"))}
            good, bad = ([d for d in every if labels.get(d) == q] for q in (1, 0))
            assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)
        if name == "MinHash near-dedup":
            data = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = sorted(d for d, _, c in brute_components(data, 5) if d == c)
            assert sorted(r["doc_id"] for r in rows(docs)) == want
        if name == "PII":
            assert docs.count() == before.count()
            assert not docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count()
            assert not docs.where("n_chars <> length(text)").count()
    sizes = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert not sizes.where("n > 2048 or n <> m").count()
    assert n


def test_run_equals_the_stages_columns(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert got.count() > 0


def test_odd_and_empty_documents_pass_every_stage(spark):
    assert public_tokenizers.path("word_bpe_49k.json")
    for docs in (odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"), empty_docs(spark)):
        some, kept = docs.count(), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            kept.append(docs.select("doc_id").distinct())
            docs = corpus_pipeline.scratch(stage(spark, docs, SF), f"test{k}")
        assert (docs.count() > 0) == (some > 0)
        assert docs.join(kept[-1], docs["doc_id"].eqNullSafe(kept[-1]["doc_id"]), "left_anti").count() == 0
        sizes = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
        assert not sizes.where("n > 2048 or n <> m").count()
