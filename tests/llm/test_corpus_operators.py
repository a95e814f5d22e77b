"""Operators against brute force, round trips and planted cases."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opportunity.llm import decontaminate, license_rules, linear_text, minhash_dedup, mixing, pii_surrogates, prefix_fingerprints, quality_nbsvm, token_codes, token_transducer, toxicity_chain
from opportunity.llm.common import table
from opportunity.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


# 1 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 1 << 24])
def test_block_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top + 1, 3000).astype(np.uint32)
    packed = token_codes.pack_block(ids)
    assert (token_codes.unpack_block(*packed[:2]) == ids).all()
    assert all(token_codes.token_in_block(*packed, i) == ids[i] for i in [0, 1, 511, 512, 513, 2047, 2048, 2999, *rng.integers(0, 3000, 200)])


def test_token_codes_match_the_library(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    store = token_codes.write_token_codes(table(spark, SF, "documents"), f"{tmp_path}/codes", path, block_tokens=2000)
    rows = {r.doc_id: r for r in token_codes.read_token_codes(spark, store).collect()}
    every, at = [], 0
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 1]
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        every += ids
        at += len(ids)
    places = random.Random(1).sample(range(at), 40) + [0, at - 1]
    assert token_codes.tokens_at(spark, store, places) == {p: every[p] for p in places}
    with pytest.raises(IndexError):
        token_codes.tokens_at(spark, store, [at])


def test_word_encoder_on_odd_words():
    path = tokenizer_file("word_bpe_49k.json")
    encoder = token_codes.WordEncoder(path, max_words=50)
    odd = ["don't", "I'LL", "<|endoftext|>", "<|ENDOFTEXT|>.", "İstanbul", "ΟΔΟΣ", "é", "é.", "a\xa0b", "x..", "!!,", "漢字。", "½.", "\x0b", "a\x85b", "A'S."]
    rng = random.Random(3)
    cases = [" ".join(rng.choices(odd, k=rng.randrange(12))) for _ in range(300)] + ["", "a" * 3000]
    want = [e.ids for e in encoder.library.encode_batch(cases, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(cases))] == want


# 2 -----------------------------------------------------------------------------------------

PII = [
    (1, "Call +1 (017) 555-7713 or write jo.doe.34@mail7.example.com, card 4111 1111 1111 1111."),
    (2, "JO.DOE.34@mail7.example.com and ann@mail7.example.com from 97.51.17.173; 4111111111111111 again"),
    (3, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" by Mr. John Smith and Mrs. Smith; Frau Müller'),
    (4, "Господин Иван Петров, Κύριος Παπάς, nothing at 3.14 or 1.2.3"),
    (5, None),
]


@pytest.fixture(scope="module")
def surrogates(spark):
    docs = spark.createDataFrame(PII, "doc_id long, text string")
    return {r.doc_id: r for r in pii_surrogates.replaced(docs, "key").collect()}


def test_surrogates_are_consistent(surrogates):
    one, two, three, four = (surrogates[k].text for k in (1, 2, 3, 4))
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert phone != "+1 (017) 555-7713"
    first, second = re.search(r"\S+@\S+?\.com", one)[0], re.search(r"\S+@\S+?\.com", two)[0]
    assert second == first.upper()[: first.index("@")] + first[first.index("@") :] and first.endswith(".com") and "jo.doe" not in first
    assert {m.split("@")[1] for m in re.findall(r"\S+@\S+?\.com", two)} == {first.split("@")[1]}
    spaced, plain = re.search(r"\d{4} \d{4} \d{4} \d{4}", one)[0], re.search(r"\b\d{16}\b", two)[0]
    assert spaced.replace(" ", "") == plain != "4111111111111111" and plain[0] == "4"
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(plain))))
    assert total % 10 == 0
    john, smith = re.search(r"Mr\. (\S+) (\S+) and", three).groups()
    assert re.search(r"Mrs\. (\S+);", three)[1] == smith and john != "John" and smith != "Smith"
    assert re.search(r'"([0-9a-f]{40})"', three)[1] != "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    assert re.match(r"Господин [А-Я][а-я]+ [А-Я][а-я]+, Κύριος [Α-Ωα-ωίάέώού]+, nothing at 3\.14 or 1\.2\.3", four)
    assert surrogates[5].text is None and surrogates[5].n_entities == 0
    assert (surrogates[1].n_entities, surrogates[1].kinds) == (3, ["card", "email", "phone"])


def test_surrogates_do_not_collide(spark):
    # 60 of the 81 addresses with such parts: attempts must go on until all differ from each other and from the rest.
    rows = [(i, f"from {1 + i % 9}.{1 + i // 9}.1.1 on") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii_surrogates.replaced(docs, "k").collect()
    new = [r.text.split()[1] for r in found]
    assert len(set(new)) == 60 and not set(new) & {t.split()[1] for _, t in rows}
    assert [r.text for r in sorted(pii_surrogates.replaced(docs, "k").collect())] == [r.text for r in sorted(found)]


def test_exhausted_spaces_get_plain_forms(spark, monkeypatch):
    monkeypatch.setattr(pii_surrogates, "ROUNDS", 1)
    monkeypatch.setattr(pii_surrogates, "_address", lambda match, digest, attempt: F.lit("9.9.9.9"))
    docs = spark.createDataFrame([(i, f"at {i}.1.1.1 x") for i in range(1, 7)], "doc_id long, text string")
    new = [r.text.split()[1] for r in pii_surrogates.replaced(docs, "k").collect()]
    assert len(set(new)) == 6 and sum(x.startswith("<IP-") for x in new) == 5


# 3 -----------------------------------------------------------------------------------------


def test_spans_and_extensions():
    rng = random.Random(5)
    a, b = ("".join(rng.choices("abé", k=300)) for _ in range(2))
    b = b[:100] + a[40:200] + b[100:]
    x, y = prefix_fingerprints.PrefixHashes(a), prefix_fingerprints.PrefixHashes(b)
    for _ in range(500):
        i, j, n = rng.randrange(300), rng.randrange(400), rng.randrange(60)
        assert prefix_fingerprints.spans_equal(x, i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert prefix_fingerprints.common_extension(x, i, y, j) == k
    assert prefix_fingerprints.common_extension(x, 40, y, 100) >= 160


def test_edited_pairs(spark, texts):
    import hashlib
    import os

    rows = {r.doc_id: r for r in prefix_fingerprints.edited_pairs(table(spark, SF, "documents").repartition(7)).collect()}
    ids = sorted(texts)
    marks = {r.doc_id: r.fingerprint for r in prefix_fingerprints.fingerprints(table(spark, SF, "documents")).collect()}
    assert len(rows) == len(ids)
    for doc_id, after in zip(ids, ids[1:] + ids[:1]):
        text, following = texts[doc_id], texts[after]
        changed = prefix_fingerprints.edited(text, following)
        row = rows[doc_id]
        assert (row.n_chars, row.edited_sha256, row.fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), marks[doc_id])
        assert row.same_start_edited == len(os.path.commonprefix([text, changed]))
        assert row.near_next == prefix_fingerprints.likeness(marks[doc_id], marks[after])
    assert len({(texts[d], marks[d]) for d in ids}) == len({texts[d] for d in ids}) == len(set(marks.values()))
    assert np.mean([r.near_edited for r in rows.values()]) > 0.5 > 0.1 > np.mean([r.near_next for r in rows.values()])


# 4 -----------------------------------------------------------------------------------------


def test_token_counts_match_the_library(texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(7)
    bits = ["'re", "'ve", "'ll", "'s", "'t", " ", "  ", "\n", "don't", "<|endoftext|>", "''", "'", "r", "Ünï", "你好", "12", "$$", "\r\n", "\xa0", "　", "²", "😀", "v", "l"]
    cases = list(texts.values()) + ["".join(rng.choices(bits, k=rng.randrange(25))) for _ in range(3000)]
    cases += ["a" * 4000, "thequickbrownfox" * 200, "=-" * 2000, "", " ", "\n\n  ", "'r", "x'v"]
    counter = token_transducer.TokenCounter(path)
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(cases, add_special_tokens=False)]
    assert counter.count(cases) == want
    assert counter.count([]) == []


def test_chunks_compose(texts):
    step, marks = token_transducer._splitter()
    symbols = token_transducer._classes().take(np.frombuffer("".join(texts.values())[:5000].encode("utf-32-le"), np.uint32))
    symbols = np.append(symbols, np.uint8(16 * token_transducer.STOP))
    whole = token_transducer.split_starts(symbols, step, marks, 1 << 14).tolist()
    assert all(token_transducer.split_starts(symbols, step, marks, n).tolist() == whole for n in (1, 3, 64, 999))


# 5 -----------------------------------------------------------------------------------------


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        parts = (text or "").encode().lower().split()
        sets.append({tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def family(seed, size, words, edits):
    """Copies of one text with a few to many random edits; some differ only by what another has too."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(30)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, words, percent):
    some = family(1, 60, 90, 9) + family(2, 40, 40, 5) + family(3, 30, 12, 2) + ["", None, "one", "one", "one two", "  One\tTWO "]
    random.Random(9).shuffle(some)
    rows = list(enumerate(some, 1))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_residual_joins_find_every_link(spark, monkeypatch):
    """With hopeless bands all links beyond the centre must come from pivots and rare shingles."""
    rows = list(enumerate(family(4, 80, 60, 8) + family(5, 40, 60, 8), 1))
    monkeypatch.setattr(minhash_dedup.OnePermutation, "keys", lambda self, hashes: np.array([7], np.int64))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 85)


@pytest.mark.parametrize("seed,percent", [(11, 85), (12, 80), (13, 90)])
def test_rare_shingles_alone_find_every_link(spark, monkeypatch, seed, percent):
    """All links beyond the centre from rare shingles, for texts of many sizes that share a passage."""
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    some = [f"{passage} {t}" if k % 2 else t for k, t in enumerate(family(seed, 60, 50, 6))]
    some = [" ".join(t.split()[: len(t.split()) - rng.randrange(12)]) for t in some]
    some += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    rows = list(enumerate(some, 1))
    monkeypatch.setattr(minhash_dedup.OnePermutation, "keys", lambda self, hashes: np.array([7], np.int64))
    monkeypatch.setattr(minhash_dedup, "PIVOT_TURNS", 0)
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, percent)


def test_heavy_buckets_and_pivots_lose_no_link(spark, monkeypatch):
    """Every bucket counts as heavy, and every pivot's rows are dealt into parts."""
    rows = list(enumerate(family(6, 60, 60, 9) + family(7, 40, 40, 7), 1))
    monkeypatch.setattr(minhash_dedup, "HEAVY_PARTS", 10**9)
    monkeypatch.setattr(minhash_dedup, "light", lambda *_: False)
    monkeypatch.setattr(minhash_dedup.OnePermutation, "keys", lambda self, hashes: np.array([7, hashes[0] % 3], np.int64))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 85)


def test_signature_estimates_likeness():
    rng = np.random.default_rng(2)
    hasher = minhash_dedup.OnePermutation(32, 4)
    for size in (8, 40, 400):
        agree = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            b = np.sort(np.concatenate([a[1:], rng.integers(0, 1 << 63, 1).astype(np.uint64)]))
            agree.append((hasher.signature(a) == hasher.signature(b)).mean())
        assert abs(np.mean(agree) - (size - 1) / (size + 1)) < 0.06


# 6 -----------------------------------------------------------------------------------------


def test_masks_survive_two_substitutions():
    import itertools

    kept = [{s + k for k, bit in enumerate(m) if bit == "1"} for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - len(m) + 1)]
    assert all(any(not places & set(gone) for places in kept) for gone in itertools.combinations(range(decontaminate.WINDOW), 2))


def test_overlaps_match_brute_force(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(13, 40)))) for i in range(12)]
    rows = []
    for d in range(120):
        body = rng.choices(words, k=rng.randrange(5, 60))
        if d % 2:
            passage = rng.choice(items)[1].split()
            start = rng.randrange(max(1, len(passage) - 12))
            passage = passage[start : start + rng.randrange(10, 30)]
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "zz"
            at = rng.randrange(len(body))
            body[at:at] = passage
        rows.append((d, ", ".join(body).upper() if d % 3 else " ".join(body)))
    want = set()
    for d, text in rows:
        have = text.lower().replace(",", "").split()
        for i, item in items:
            own = item.split()
            if any(sum(x == y for x, y in zip(have[p : p + 13], own[q : q + 13])) >= 11 for q in range(len(own) - 12) for p in range(len(have) - 12)):
                want.add((d, i))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    shuffled = decontaminate.overlaps(docs, bench)
    assert shuffled.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["op2", "op6", "op10"])
def test_native_operators_run_no_python(spark, name):
    docs = table(spark, SF, "documents")
    frame = {"op2": lambda: pii_surrogates.replaced(docs.select("doc_id", "text"), "k"), "op6": lambda: decontaminate.overlaps(docs, table(spark, SF, "benchmark")), "op10": lambda: mixing.mixed(docs, repeats=2.0)}[name]()
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7 -----------------------------------------------------------------------------------------


def test_license_rules():
    assert len(license_rules.default_rules()) > 300
    labels = lambda text: [(a, b, r.label) for a, b, r in license_rules.detections(text)]
    assert labels("Licensed under CC BY-NC 4.0.") == [(0, 27, "cc-by-nc")]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == [(13, 69, "gpl")]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == [(0, 41, "gpl")]
    assert [x[2] for x in labels("Creative Commons Attribution-ShareAlike 4.0, BSD 3-Clause License.\nAll rights reserved")] == ["cc-by-sa", "bsd", "proprietary"]
    assert labels("a submitted licence of some kind") == []
    for text in ("MIT License. " * 2000, "apache license, version 2.0 " * 1000):
        found = license_rules.detections(text)
        assert len(found) == text.count("icense") and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_base_places(spark, texts):
    wordish = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    some = texts | {-1: "Mit License MIT LICENSE. CC-BY cc byé cc  by gnu general public license"}
    for text in some.values():
        words = wordish.findall(text.translate(lower))
        want = sorted((i, label) for phrase, label in license_rules.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        count, places = license_rules.base_places(text)
        assert (count, sorted(places)) == (len(words), want)


# 8, 9 --------------------------------------------------------------------------------------


def held_out_auc(scores, y):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    ones = y.sum()
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_quality_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = quality_nbsvm.quality_scores(docs, labels, max_train=1500).join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", "quality").toPandas()
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id)
    assert held_out_auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.97
    assert (rows.predicted == rows.quality).mean() > 0.95


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    train = labels.filter("doc_id % 4 <> 2")
    found = toxicity_chain.toxicity_scores(docs, train, max_train=3000).withColumnRenamed("toxic", "said")
    rows = found.join(labels.filter("doc_id % 4 = 2"), "doc_id").toPandas()
    caught, said = rows[rows.toxic == 1].said.mean(), rows[rows.said].toxic.mean()
    assert held_out_auc(rows.p_toxic.to_numpy(), rows.toxic.to_numpy()) > 0.95 and caught > 0.9 and said > 0.8  # from 3,000 rows


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.integers(0, 2, n).astype(float)
    rows = linear_text.Rows([np.array([5, 9]) if x else np.array([9]) for x in first])
    chain = toxicity_chain.fit_chain(rows, {"a": first, "b": first, "none": np.zeros(n)}, list(range(n)))
    assert len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    assert toxicity_chain.probabilities(chain, np.array([5, 9]))[1] > 0.9 > 0.1 > toxicity_chain.probabilities(chain, np.array([9]))[1]
    assert chain[2].threshold > 1


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200).astype(float)
    rows = linear_text.Rows([np.unique(np.concatenate([rng.integers(100, 200, 8), [1 if v else 2]])) for v in y])
    model = quality_nbsvm.fit(rows, y, list(range(200)))
    assert all((model.score(r) > 0.5) == (v == 1) for r, v in zip(rows.rows, y))


# 10 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(6)
    rows = [(i, "a" if i % 3 else f"s{i % 7}", "w " * rng.randrange(1, 60)) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_mixing_meets_its_target(spark, sized):
    sizes = sized.select("source", mixing.token_column().alias("n_tokens"))
    shares = mixing.source_shares(sizes)
    p = np.array([r.share for r in shares.collect()])
    assert p.sum() == pytest.approx(1)
    entropy = lambda a: float(-(lambda q: (q * np.log(q)).sum())(p**a / (p**a).sum()))
    exponent = mixing.find_exponent(shares, entropy=0.9)
    assert entropy(exponent) == pytest.approx(0.9 * np.log(len(p)), abs=1e-6)
    exponent = mixing.find_exponent(shares, repeats=1.5)
    assert (p**exponent / (p**exponent).sum() / p).max() == pytest.approx(1.5, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.find_exponent(shares)


def test_realised_budgets(spark, sized):
    rows = mixing.mixed(sized, repeats=1.5).collect()
    assert len(rows) == 900
    tokens, taken, largest, weight = {}, {}, {}, {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens * r.copies
        largest[r.source] = max(largest.get(r.source, 0), r.n_tokens)
        weight[r.source] = r.weight
    total = sum(tokens.values())
    for s in tokens:
        budget = round(weight[s] * total)
        assert budget - largest[s] < taken[s] <= budget
        copies = {r.copies for r in rows if r.source == s}
        assert copies <= {budget // tokens[s], budget // tokens[s] + 1}
    again = {(r.doc_id, r.copies) for r in mixing.mixed(sized.repartition(5), repeats=1.5).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    assert {(r.doc_id, r.copies) for r in mixing.mixed(sized, repeats=1.5, seed=99).collect()} != again


def test_budget_for_every_document(spark, sized):
    rows = mixing.mixed(sized, repeats=2.0, budget=None).collect()
    assert min(r.copies for r in rows) == 1 and max(r.copies for r in rows) == 2
    many = mixing.mixed_documents(sized, repeats=2.0, budget=None)
    assert many.columns == sized.columns and many.count() == sum(r.copies for r in rows)
