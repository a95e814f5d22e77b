"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opportunity.llm import decontaminate, license_rules, minhash_dedup, mixing, pii_surrogates, prefix_fingerprints, quality_nbsvm, token_codes, token_transducer, toxicity_chain
from opportunity.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", 5),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b", 3),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b", 3),
    (None, "no id here but some words", "en", "c", 3),
    (7, "   \n\t ", "xx", "a", 1),
    (8, "mail me at jo.doe@site.example.org or 10.20.30.40", "en", "a", 1),
]
BENCH = [(0, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (1, None), (2, ""), (3, "short item")]
LABELS = [(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (5, 1, 0), (8, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    # Names that the operators use inside must not clash.
    extra = ["id", "row", "tie", "bucket", "match", "kinds", "_found", "part", "copies", "place", "words", "toxic", "item_id", "value"]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(1))


def operators(labels, benchmark):
    word, byte = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
    return {
        "token_codes": lambda d: token_codes.token_codes(d, word),
        "pii": lambda d: pii_surrogates.replaced(d, "k"),
        "fingerprints": prefix_fingerprints.fingerprints,
        "pairs": prefix_fingerprints.edited_pairs,
        "counts": lambda d: token_transducer.count_tokens(d, byte),
        "dedup": lambda d: minhash_dedup.near_duplicates(d),
        "licenses": license_rules.scan,
        "toxicity": lambda d: toxicity_chain.toxicity_scores(d, labels),
        "quality": lambda d: quality_nbsvm.quality_scores(d, labels),
        "mixing": lambda d: mixing.mixed(d, repeats=2.0),
    }


@pytest.mark.parametrize("name", ["token_codes", "pii", "fingerprints", "pairs", "counts", "dedup", "licenses", "toxicity", "quality", "mixing"])
def test_every_row_has_a_result(docs, labels, benchmark, name):
    operator = operators(labels, benchmark)[name]
    found = operator(docs)
    assert sorted(str(r.doc_id) for r in found.select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)
    assert operator(docs.limit(0)).count() == 0


def test_overlaps_of_odd_rows(docs, benchmark):
    assert decontaminate.overlaps(docs, benchmark).count() == 0
    assert decontaminate.overlaps(docs.limit(0), benchmark).count() == 0
    assert decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, benchmark).count() == len(ROWS)


def test_without_labels_nothing_is_toxic(docs, labels):
    assert toxicity_chain.toxicity_scores(docs, labels.limit(0)).filter("toxic").count() == 0
    scores = {r.score for r in quality_nbsvm.quality_scores(docs, labels.limit(0)).select("score").collect()}
    assert scores == {0.5}


def test_stages_keep_the_columns(spark, docs, labels, benchmark, tmp_path):
    labels.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.drop("doc_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


def test_repeated_ids_and_exact_copies(docs):
    rows = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert (1, 1, True) in rows and (5, 1, False) in rows and (None, None, True) in rows and (3, 3, True) in rows


def test_mixing_keeps_nulls_apart(docs):
    assert {r.source for r in mixing.mixed(docs, repeats=2.0).collect()} == {"a", "b", "c", None}
