"""The queries of this folder: name -> (spark, sf_dir) -> DataFrame; ORACLES has SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, induced_sort, latent_decontam, line_crf, pii, piece_viterbi, quality_crf, secret_scan, setsketch, suffix_trees, token_output, weak_toxicity, whitening,
)
from .oracles import ORACLES
from .tables import read


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is, on the driver and on each executor alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.encode_to_shards(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_output.document_digests(shards)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.dedup_passages(read(spark, sf_dir, "documents"))


def op5_induced_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induced_sort.dedup_bytes(read(spark, sf_dir, "documents"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_crf.score_lines(docs, line_crf.fit(docs, read(spark, sf_dir, "labels")))


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"), 85)


def op8_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.find_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.round_trips(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return weak_toxicity.score(docs, weak_toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)


def op12_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.fit(docs, read(spark, sf_dir, "labels")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.whole_vectors(read(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, whitening.fit(vectors))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_secret_scan": op2_secret_scan,
    "op3_pii": op3_pii,
    "op4_suffix_trees": op4_suffix_trees,
    "op5_induced_sort": op5_induced_sort,
    "op6_line_crf": op6_line_crf,
    "op7_setsketch": op7_setsketch,
    "op8_latent_decontam": op8_latent_decontam,
    "op9_piece_viterbi": op9_piece_viterbi,
    "op10_weak_toxicity": op10_weak_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_crf": op12_quality_crf,
    "op13_whitening": op13_whitening,
}

__all__ = ["ORACLES", "QUERIES"]
