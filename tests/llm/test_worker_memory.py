"""What the Python workers of the corpus operators hold while a task runs, and after it."""

import tracemalloc

import numpy as np
import pyarrow as pa
from opportunity.llm import common, linear_text, token_codes, toxicity_chain
from opportunity.llm.queries import tokenizer_file


def anonymous_kb():
    with open("/proc/self/smaps_rollup") as lines:
        return next(int(line.split()[1]) for line in lines if line.startswith("Anonymous:"))


def test_a_batch_is_encoded_in_small_runs():
    encoder = token_codes.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    texts = pa.array(["some of the words of a text, and more of them. " * 80] * 1_600)  # 6 MB
    tracemalloc.start()
    tokens = sum(len(ids) for ids in encoder.encode(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = sum(len(ids) for ids in encoder.encode(texts[:1]))
    assert tokens == alone * len(texts)
    assert peak < 60_000_000


def test_memory_is_given_back_after_a_task():
    def work(batches):
        for n in batches:
            # Small arrays, every hundredth of which stays: freed memory lies between held pieces.
            made = [np.ones(300) for _ in range(n)]
            kept.append(made[::100])
            yield len(made)

    kept: list = []
    assert list(common.giving_back(work)([1])) == [1]
    before = anonymous_kb()
    assert sum(common.giving_back(work)([50_000])) == 50_000
    assert anonymous_kb() - before < 60_000


def test_features_are_counted_in_small_parts():
    rng = np.random.default_rng(4)
    rows = linear_text.Rows([np.unique(rng.integers(0, linear_text.SIZE, 900)).astype(np.int32) for _ in range(3_000)])  # 11 MB
    chosen = rng.permutation(3_000)[:2_500]
    want = np.zeros(linear_text.SIZE)
    for i in chosen:
        want[rows.rows[i]] += 1
    tracemalloc.start()
    found = rows.counts(chosen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.dtype == float and (found == want).all()
    assert peak < 12_000_000
    assert (rows.counts(np.zeros(0, int)) == 0).all()


def test_a_task_of_other_work_lets_go_of_what_is_kept():
    word_encoder = token_codes.word_encoder
    path = tokenizer_file("word_bpe_49k.json")
    first = word_encoder(path)
    list(common.giving_back(iter, keeps=True)([]))
    assert word_encoder(path) is first
    list(common.giving_back(iter)([]))
    assert word_encoder(path) is not first


def test_a_fit_in_parts_is_that_of_the_whole_sample(spark):
    """Groups reach the fit in several Arrow batches; it sees all rows, in the order of their ids."""
    words = ["good", "fine", "awful", "vile"]
    rows = [(i, f"{words[i % 4]} {words[i * 7 % 4]} word{i % 50} " * 20, int(i % 4 > 1)) for i in range(2_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    stems = linear_text.Stems()

    def seen(found, labels, ids):
        return ids, labels["toxic"].tolist(), [list(r) for r in found.rows]

    ids, toxic, features = linear_text.fitted(linear_text.labelled_sample(docs, docs, ["toxic"], 8_000), stems, ["toxic"], seen)
    assert ids == list(range(2_500)) and toxic == [r[2] for r in rows]
    assert features == [list(stems.features(r[1])) for r in rows]
    chain, _ = toxicity_chain.fitted_chain(docs, docs, kinds=1)
    assert [link.name for link in chain] == ["kind_1", "toxic"]
