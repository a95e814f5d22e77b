"""Exact ids beside nulls, rows that share an id, whole-text token ids, and test items of every length."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opportunity.llm import decontaminate, license_rules, minhash_dedup, prefix_fingerprints, quality_nbsvm, token_codes, token_transducer, toxicity_chain
from opportunity.llm.queries import tokenizer_file

BIG = [9007199254740993, None, 9007199254740995]


@pytest.fixture(scope="module")
def big(spark):
    texts = ["alpha beta gamma delta epsilon one", "two words and some more of them", "nothing like the other two at all"]
    return spark.createDataFrame(list(zip(BIG, texts)), "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG[0], 1, 0), (BIG[2], 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["codes", "pairs", "marks", "counts", "dedup", "licenses", "toxicity", "quality"])
def test_large_ids_beside_a_null(big, labels, name):
    operators = {
        "codes": lambda: token_codes.token_codes(big, tokenizer_file("word_bpe_49k.json")),
        "pairs": lambda: prefix_fingerprints.edited_pairs(big),
        "marks": lambda: prefix_fingerprints.fingerprints(big),
        "counts": lambda: token_transducer.count_tokens(big, tokenizer_file("byte_bpe_50k.json")),
        "dedup": lambda: minhash_dedup.near_duplicates(big),
        "licenses": lambda: license_rules.scan(big),
        "toxicity": lambda: toxicity_chain.toxicity_scores(big, labels),
        "quality": lambda: quality_nbsvm.quality_scores(big, labels),
    }
    assert {r.doc_id for r in operators[name]().select("doc_id").collect()} == set(BIG)


def test_token_ids_of_odd_texts():
    encoder = token_codes.WordEncoder(tokenizer_file("word_bpe_49k.json"), max_words=3000)
    rng = random.Random(5)
    marks = [chr(c) for c in (0x300, 0x301, 0x307, 0x327, 0x338, 0x93C)]
    letters = [chr(c) for c in (0x130, 0x3A3, 0x958, 0x95F, 0x9DC, 0xA33, 0xB5C, 0xF43, 0xFB1D, 0xFB4E, 0x1E9E, 0x212A, 0x1100, 0x1161, 0x11A8)]
    alphabet = [chr(c) for c in range(32, 0x530)] + letters * 3 + marks * 20 + list(" .,;:!?|&%$*#'<>\n\t") * 30
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(14))) for _ in range(30_000)]
    odd = ["İSTANBULDAKİ. BİR", "don't", "<|endoftext|>", "<|ENDOFTEXT|>.", "J̌", "'s.", "a<", "|>", "é.", "Å.", "é|x", "\x0b", "½."]
    texts += ["".join(rng.choice(odd) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += [c + m + " x" for c in itertools.chain(map(chr, range(0x80, 0x2000)), letters) for m in token_codes.TAIL_MARKS.decode()]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    assert [x.tolist() for x in encoder.encode(pa.array(texts).slice(7, 100))] == want[7:107]
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def test_next_document_of_rows_with_one_id(spark):
    rows = [(5, f"text number {i} of the same id") for i in range(40)] + [(None, f"no id {i}") for i in range(20)] + [(4, "before"), (9, "after")]
    found = prefix_fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    marks = {r.fingerprint: r for r in found}
    assert len(marks) == len(rows)
    after = {"before": 5, "after": None}
    read = spark.createDataFrame([(k, t) for k, t in enumerate(after)], "doc_id long, text string")
    for row in prefix_fingerprints.fingerprints(read).collect():
        assert marks[row.fingerprint].doc_id == (4 if row.doc_id == 0 else 9)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    t = " ".join(f"a{i}" for i in range(40))
    u = " ".join(f"b{i}" for i in range(40))
    rows = [(1, t), (5, t), (5, u), (7, u + " more"), (None, u + " more"), (None, None), (9, ""), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("x"))
    found = {(r.doc_id, r.component_id, r.n_shingles) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {(1, 1, 36), (5, 1, 36), (5, 5, 36), (7, 5, 37), (None, 5, 37)} <= found
    kept = minhash_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("1", t), ("5", u)]
    assert kept.filter("coalesce(text, '') = ''").count() == 4
    copies = spark.createDataFrame([(3, t)] * 4 + [(None, u)] * 3, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in minhash_dedup.deduplicated(copies).collect()) == [("3", t), ("None", u)]


def test_contraction_equals_one_task(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    once = {(r.id, r.component) for r in minhash_dedup.components(frame).collect()}
    monkeypatch.setattr(minhash_dedup, "TASK_EDGES", 20)
    assert {(r.id, r.component) for r in minhash_dedup.components(frame).collect()} == once
    first, more = frame.limit(120), frame.subtract(frame.limit(120))
    labels = minhash_dedup.merged(minhash_dedup.components(first), frame)
    assert {(r.id, r.component) for r in labels.collect()} == once
    assert more.count() >= 0


def test_items_of_every_length(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(60)]
    items = [(i if i % 7 else None, " ".join(rng.choices(words, k=rng.randrange(1, 41)))) for i in range(60)] + [(3, "v1 v2 v3"), (3, "v9 v8 v7 v6")]
    rows = []
    for d in range(150):
        body = rng.choices(words, k=rng.randrange(200))
        if d % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "zz"
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        rows.append((d // 2 if d < 40 else d, " ".join(body)))
    want, dirty = set(), set()
    for k, (d, text) in enumerate(rows):
        have = text.split()
        for i, item in items:
            own = item.split()
            width = min(13, len(own))
            need = math.ceil(width * 11 / 13)
            if any(sum(x == y for x, y in zip(have[p : p + width], own[q : q + width])) >= need for q in range(len(own) - width + 1) for p in range(len(have))):
                want.add((d, i))
                dirty.add(k)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == want
    assert sorted((r.doc_id, r.text) for r in decontaminate.decontaminated(docs, bench).collect()) == sorted(r for k, r in enumerate(rows) if k not in dirty)
    monkeypatch.setattr(decontaminate, "SEED_ROWS", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == want


def test_domains_stay_distinct_and_introductions_count(spark):
    from opportunity.llm import pii_surrogates

    rows = [(i, f"write a{i}@x{c}.org or b@x{c}.org") for i, c in enumerate("abcdefghijklmnopqrstuvwx")]
    rows += [(100, "My name is John Smith, signed by John Smith"), (101, "Dear Ann Lee")]
    found = {r.doc_id: r for r in pii_surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    domains = [{w.split("@")[1] for w in found[i].text.split() if "@" in w} for i in range(24)]
    assert all(len(d) == 1 for d in domains) and len(set.union(*domains)) == 24
    assert not set.union(*domains) & {f"x{c}.org" for c in "abcdefghijklmnopqrstuvwx"}
    first, second = found[100].text.removeprefix("My name is ").split(", signed by ")
    assert first == second != "John Smith" and found[100].n_entities == 2
    assert found[101].text.startswith("Dear ") and found[101].text != "Dear Ann Lee"
