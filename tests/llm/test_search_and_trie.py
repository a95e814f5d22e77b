"""Ranked search, rotated codes and the prefix trie against plain versions, with the cases their docstrings define."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opportunity.llm import lexical_ranking, prefix_trie, rotated_codes

# Ranked search -----------------------------------------------------------------------------

DOCS = [
    (1, "The fox, the fox and the dog. Ünder Ångström"), (2, None), (3, ""), (4, "fox " * 5000 + "rare"), (5, "dog dog cat"), (5, "dog dog cat"), (None, "dog dog cat"), (7, "  \n "),
    (8, "ÜNDER ünder Ünder"), (9, "a1 b2 a1_b2"), *[(100 + i, f"common word number {i % 7} and {'fox' if i % 3 else 'dog'}") for i in range(60)],
]
ITEMS = [(0, "The FOX and the common word"), (1, None), (2, ""), (3, "nowhere to be seen xyzzy"), (4, "dog dog dog"), (4, "rare fox"), (None, "ünder A1"), (6, "number 3 and 4 common common")]


def plain_ranking(docs, items, k):
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(lower(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, length, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), size in zip(counts, sizes, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // length))) for t in lower(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if unknown else doc, -s) for rank, (s, unknown, doc) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranking_equals_plain(spark, k):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item", "n", "terms", "score", "rank")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = lexical_ranking.ranked(docs.repartition(3), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_ranking(DOCS, ITEMS, k)


def test_ranking_in_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_ranking, "ITEM_BYTES", 200)
    got = lexical_ranking.ranked(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"), 20)
    assert Counter(map(tuple, got.collect())) == plain_ranking(DOCS, ITEMS, 20)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null or text = ''"), items)):
        assert lexical_ranking.ranked(d, i).collect() == []


def test_no_accumulator_after_the_bound():
    """A block whose later rows cannot reach the best partial score gives them no accumulator, and the best stay exact."""
    best = lexical_ranking._Best(1, [(np.array([0, 1]), np.array([1, 1]))])
    first, later = np.array([0]), np.arange(1, 50)
    postings = {0: (first, np.array([1000])), 1: (np.r_[first, later], np.r_[10, np.full(49, 20)])}
    lexical_ranking._score_block(best, np.arange(50), np.zeros(50, bool), postings)
    assert best.doc[0].tolist() == [0] and best.score[0].tolist() == [1010]


# Rotated codes -----------------------------------------------------------------------------


def plain_nearest(rows, wanted, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in usable:
        if q is not None and wanted(q):
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), i is None, i or 0) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, rank, None if unknown else i, round(d, 9)) for rank, (d, unknown, i) in enumerate(found[:k], 1)]
    return Counter(out)


def rounded(df):
    return Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def vectors(seed=1, n=400, size=24):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(size=(n, size)) + rng.integers(0, 4, (n, 1)))]
    same = rows[40][1]
    return [*rows, *[(n + i, same) for i in range(60)], (None, same), (900, None), (901, []), (910, [0.0] * size), (920, [float("nan")] * size), (930, [float("inf")] + [1.0] * (size - 1)), (940, [None] + [1.0] * (size - 1)), (950, [1.0, 2.0]), (960, [1.0, 2.5]), (10, same)]


def test_nearest_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "size", "code", "length", "q", "block")})
    got = rotated_codes.nearest(df.repartition(3), F.col("id") % 10 == 0, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rounded(got) == plain_nearest(rows, lambda q: q % 10 == 0, 10)


def test_nearest_in_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(rotated_codes, "QUERY_BYTES", 1000)
    rows = vectors(2, 120)
    got = rotated_codes.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 10 == 0, k=3)
    assert rounded(got) == plain_nearest(rows, lambda q: q % 10 == 0, 3)


def test_nearest_of_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in rotated_codes.nearest(few, F.col("id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert rotated_codes.nearest(few.limit(0), F.col("id") == 0).collect() == []
    assert rotated_codes.nearest(few, F.col("id") == 7).collect() == []


def test_rotation_keeps_lengths_and_bound_leaves_few():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(2000, 64))
    assert np.allclose((rotated_codes.rotated(rows) ** 2).sum(axis=1), (rows**2).sum(axis=1))
    bits, length, cosine = rotated_codes.coded(rows, rows.mean(axis=0))
    assert bits.shape == (2000, 8) and np.allclose(length, np.sqrt(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))) and (cosine > 0.6).all() and (cosine <= 1).all()
    # Estimates of inner products lie within the bound of four deviations.
    query = rng.normal(size=(1, 64))
    corners = (np.unpackbits(bits, axis=1) * 2.0 - 1) / 8
    estimate = corners @ rotated_codes.rotated(query)[0] / cosine * length
    true = (rows - rows.mean(axis=0)) @ query[0]
    assert (np.abs(estimate - true) <= 4 * length * np.sqrt((query**2).sum()) * np.sqrt((1 - cosine**2) / cosine**2 / 63)).mean() > 0.999


@pytest.mark.parametrize("spread", [1.0, 2.0])
def test_recall_of_a_narrow_bound(spark, spread):
    rows = vectors(4, 2000, 48)
    want = plain_nearest(rows, lambda q: q % 50 == 0, 10)
    got = rounded(rotated_codes.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0, spread=spread))
    pairs = lambda c: {(q, i) for q, _, i, _ in c}
    assert len(pairs(want) & pairs(got)) >= 0.9 * len(pairs(want))


# Prefix trie -------------------------------------------------------------------------------


def plain_trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in conv.items()}
    rebuilt = {c: conv.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :] for c, v in conv.items()}
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for key in members:
        kids[key[:-1]] += bool(key)
    for key, m in members.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
            leaves[key[:d]] += kids[key] == 0
    ends = {k: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)) for k, m in members.items()}
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def talks(n=260):
    rows = []
    for c in range(n):
        first = "hello" if c % 3 else f"start {c % 5}"
        rows += [(c, t, ("user", "assistant")[t % 2], first if t == 0 else f"turn {t} of {(c // 4) % (t + 2)}") for t in range(c % 9)]
    odd = [(300, None, None, None), (300, 0, "user", "ünï 😀"), (300, 0, "user", "ünï 😀"), (300, 0, "a", "tie"), (301, 5, None, "x"), (777, 1, "user", ""), (None, 0, "user", "lost"), (450, 0, "user", "long " * 3000)]
    return [*rows, *odd, *[(600, t, "user", f"t{t}") for t in range(40)], *[(601, t, "user", f"t{t}") for t in range(40)], *[(650 + i, t, "user", f"t{t}") for i in range(30) for t in range(8)]]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_equals_plain(spark):
    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "block", "d1", "at", "own", "sha", "_upto", "base")})
    got = prefix_trie.trie_nodes(df.repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_in_blocks_of_turns(spark, monkeypatch):
    """Conversations cut into blocks, many shards and small chunks of ids give the same nodes."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 6)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 100)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = talks()
    assert Counter(map(tuple, prefix_trie.trie_nodes(spark.createDataFrame(rows, SCHEMA)).collect())) == plain_trie(rows)


def test_trie_without_turns_left(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "b"), (5, 0, "user", "c")]
    assert Counter(map(tuple, prefix_trie.trie_nodes(spark.createDataFrame(rows, SCHEMA)).collect())) == plain_trie(rows)
    assert prefix_trie.trie_nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie_nodes(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)).collect() == []


def test_shared_digests_are_noticed(spark):
    """With digests of a few bits, prefixes collide: another set of bases is taken, or an error is raised, never a wrong node."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(20) for t in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        prefix_trie.trie_nodes(df, modulus=2).collect()
    assert Counter(map(tuple, prefix_trie.trie_nodes(df, modulus=17).collect())) == plain_trie(rows)


def test_node_table_is_minimal_and_verified():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 62, (5000, 2)), axis=0)
    table = prefix_trie.NodeTable(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (table.slots(rng.integers(0, 1 << 62, (5000, 2))) == -1).all()
    assert prefix_trie.NodeTable(np.zeros((0, 2), np.int64)).slots(keys[:3]).tolist() == [-1, -1, -1]
