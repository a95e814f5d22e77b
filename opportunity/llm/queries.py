"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opportunity.llm import decontaminate, lexical_ranking, license_rules, minhash_dedup, mixing, pii_surrogates, prefix_fingerprints, prefix_trie, quality_nbsvm, rotated_codes, token_codes, token_transducer, toxicity_chain
from opportunity.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_codes.token_codes(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replaced(docs, key="opportunity")


def op3_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), repeats=2.0)


def op11_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_codes": op1_token_codes,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_prefix_fingerprints": op3_prefix_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_license_rules": op7_license_rules,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_quality_nbsvm": op9_quality_nbsvm,
    "op10_mixing": op10_mixing,
    "op11_lexical_ranking": op11_lexical_ranking,
    "op12_rotated_codes": op12_rotated_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op5_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op6_decontamination": decontaminate.ORACLE_SQL,
    "op11_lexical_ranking": lexical_ranking.ORACLE_SQL,
    "op12_rotated_codes": rotated_codes.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
