"""From raw documents to training ids: STAGES, each a step over all documents that the one before kept.

Cases: null and empty texts fail the quality rules and go, as do texts under 50 words; rows without doc_id are judged like any
others but are no near duplicate of anything; of rows that repeat doc_id and text all stay or go; an empty table of documents or of
benchmark items gives what there is to give; without labels the quality rules keep to their built-in weights; texts are read whole;
further columns pass through, whatever their names, but piece_ids and round_trip, which the last stage writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderflow.llm import latent_decontam, line_crf, pii, piece_viterbi, setsketch
from cinderflow.llm.queries import vocabulary
from cinderflow.llm.tables import read, staged

NEAR_PERCENT = 80
#: Bytes of text that go to a Python worker at a time: with whole texts in the rows the usual 64 MB are held by the JVM, twice, and by
#: the worker, for each task.
BATCH_BYTES = "8m"


def batched(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling rejects go."""
    batched(spark)
    return line_crf.keep_good(docs, line_crf.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    batched(spark)
    return setsketch.keep_one(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    batched(spark)
    return latent_decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in place; no document goes."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get their piece ids, and whether these decode to the text."""
    batched(spark)
    return piece_viterbi.with_ids(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", mask_pii),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


#: Models decide three of the stages, so no SQL can give run()'s rows; the tests hold stages against brute force instead.
ORACLE_SQL: str | None = None
