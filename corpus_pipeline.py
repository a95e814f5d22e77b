"""Corpus pipeline: toxic documents out, one of each near-duplicate group, no benchmark
passages, sources mixed, and the rest written as token codes.

Every stage but the last returns the columns of ``documents``. ``run`` writes each stage's rows
as Parquet in the work folder and the next stage reads them from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opportunity.llm import decontaminate, minhash_dedup, mixing, token_codes, toxicity_chain
from opportunity.llm.common import table, written
from opportunity.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not predict to be toxic."""
    return toxicity_chain.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; five words a shingle, likeness of 0.8 or more."""
    return minhash_dedup.deduplicated(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice, by tempered weights."""
    return mixing.mixed_documents(docs, repeats=2.0, budget=None)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token codes of what is left, read back: doc_id, start, n_tokens and ids_crc32 of each row."""
    return token_codes.token_codes(docs, tokenizer_file("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_codes", write_tokens),
]

#: The trained classifier and the keyed permutation have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
