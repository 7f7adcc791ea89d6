"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat_format, html_text, minhash_dedup, mixing, ordinal, packing, periodic_runs, pii, structure_repair, topk_search, vector_dedup
from .shared import read_table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk_search.top_k(topk_search.quantized(rows.where("vec_id % 50 = 0")), topk_search.quantized(rows, merge=False), 5)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_duplicates(read_table(spark, sf_dir, "embeddings"), 0.98)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digests(packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = ordinal.train(docs, read_table(spark, sf_dir, "labels"), "toxic")
    scores = ordinal.scored(docs, model)
    return scores.select("doc_id", F.col("expected").alias("expected_severity"), F.col("grade").alias("severity"), (F.col("tail") >= 0.5).alias("toxic"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read_table(spark, sf_dir, "documents")).taken()


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = ordinal.train(docs, read_table(spark, sf_dir, "labels"), "quality")
    scores = ordinal.scored(docs, model)
    return scores.select("doc_id", F.col("expected").alias("expected_grade"), F.col("tail").alias("tail_probability"), (F.col("tail") >= 0.5).alias("kept"))


def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert(read_table(spark, sf_dir, "pages"), unnamed=True)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), 3, (85, 100))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.runs(periodic_runs.looped(read_table(spark, sf_dir, "documents"))))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # one more conversation, whose texts hold the template's own control strings
    trap = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), trap.alias("text"))
    return chat_format.digests(chat_format.formatted(rows.unionByName(more)))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.digests(structure_repair.repaired(structure_repair.damaged(read_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_vector_dedup, op3_packing, op4_toxicity, op5_mixing, op6_html_text, op7_quality, op8_archives, op9_minhash_dedup, op10_pii, op11_periodic_runs, op12_chat_format, op13_structure_repair, pipeline)}
