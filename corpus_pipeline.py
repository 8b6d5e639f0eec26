"""Documents to token ids in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.llm import decontaminate, language_id, line_dedup, ngram_join, sentencepiece_codec
from rainweave.llm.packing import small_batches
from rainweave.llm.queries import held_out, piece_model
from rainweave.session import cut_lineage

LEAST_SCORE = 0.5


def written(stage):
    """For stages whose rows come out of Python: written by their own job in small batches and read again."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return cut_lineage(stage(spark, docs, sf_dir))
    return run_stage


@written
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose likeliest language has a posterior under LEAST_SCORE."""
    model = language_id.fit(docs.where(~held_out()))
    judged = language_id.judge(docs, model, keep=tuple(docs.columns))
    kept = judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col("kept")[c].alias(c) for c in docs.columns))


def unshared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least three documents share, except in the largest doc_id."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    rows = line_dedup.dedup_lines(docs, keep=others)
    return rows.select("doc_id", "text", "kept.*", F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of similar documents."""
    groups = ngram_join.similar_components(docs)
    return docs.join(groups.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


@written
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip."""
    rows = sentencepiece_codec.encode_texts(docs, piece_model())
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [("language_id", known_language), ("line_dedup", unshared_lines), ("ngram_jaccard_join", one_of_each_group),
          ("decontamination", without_benchmark), ("sentencepiece", tokens)]

#: No SQL states language scores, the similarity join and subword encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
