import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from varlens.llm import decontaminate, near_dup, scratch, secrets, segment


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = scratch.written(stage(spark, docs, sf_dir), name)
        assert after.columns == first.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "language":
            assert kept == ids  # all are clean prose in a learned language
        if name == "near_duplicates":
            assert kept == {r.doc_id for r in near_dup.classes(docs).where("kept").collect()} and len(kept) < len(ids)
        if name == "decontamination":
            assert ids - kept == {r.doc_id for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
        if name == "secrets":
            assert kept == ids and secrets.scan(after).where("is_secret").count() == 0
        docs = after
    rows = pipeline.run(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {(r.doc_id, r.decoded_crc32) for r in rows} == {(k, zlib.crc32(t.encode())) for k, t in texts.items()}
    assert max(r.sample for r in rows) == segment.K - 1


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            docs = scratch.written(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_rejected_languages_go(spark, odd_docs, sf_dir):
    kept = pipeline.keep_known_languages(spark, odd_docs, sf_dir)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} <= {1, None, 4, 7, 8, 9}


def test_unlearned_languages_and_letter_junk_go(spark, sf01):
    """However many languages are learned, texts in another one and random letters are rejected, clean ones kept."""
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(7)
    junk = [(-1 - k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 10))) for _ in range(100)), None) for k in range(50)]
    junk.append((-100, "abcdefghijklmnopqrstuvwxyz" * 20 + " the the", None))
    for left_out in ("de", "en", "es", "fr"):
        unlearned = F.col("lang") == left_out
        rows = docs.withColumn("lang", F.when(~unlearned, F.col("lang"))).unionByName(spark.createDataFrame(junk, docs.schema))
        kept = {r.doc_id for r in pipeline.keep_known_languages(spark, rows, sf01).collect()}
        assert kept == {r.doc_id for r in docs.where(~unlearned).collect()}
