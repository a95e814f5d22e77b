"""Operators and pipeline stages against plain versions that share none of their code."""

import collections
import math
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from opportunity.llm import mixing, pii_surrogates, prefix_fingerprints, toxicity_chain
from opportunity.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# 2 -----------------------------------------------------------------------------------------


def shape(text):
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text)))


def test_surrogates_by_plain_search(docs, texts):
    patterns = {kind: regex.compile(p) for kind, p in pii_surrogates.PATTERNS.items()}
    cued, before = regex.compile(pii_surrogates.ENTITY), regex.compile(pii_surrogates.BEFORE)
    seen: dict = {}
    for row in pii_surrogates.replaced(docs.select("doc_id", "text"), "key").collect():
        text = texts[row.doc_id]
        named = [m[0] for m in cued.finditer(text) if before.match(m[0])]
        known = {w for m in named for name in [before.sub("", m)] for w in (name, name.split(" ")[-1]) if len(w) > 1}
        again = "|".join(regex.escape(w) for w in sorted(known, key=len, reverse=True))
        either = regex.compile(pii_surrogates.ENTITY + (f"|{pii_surrogates.START}(?:{again}){pii_surrogates.STOP}" if known else ""))
        found = list(either.finditer(text))
        assert row.n_entities == len(found)
        at, rest, names = 0, row.text or "", {}
        for m in found:
            kept = text[at : m.start()]
            assert rest.startswith(kept)
            rest, at = rest[len(kept) :], m.end()
            kind = next((k for k, p in patterns.items() if p.fullmatch(m[0])), "name")
            if kind == "name":
                own = len(before.match(m[0])[0]) if before.match(m[0]) else 0
                assert rest.startswith(m[0][:own])
                rest, name = rest[own:], m[0][own:]
                new = " ".join(rest.split(" ")[: name.count(" ")] + [regex.match(r"[\p{L}\p{M}.'’-]*[\p{L}\p{M}]", rest.split(" ")[name.count(" ")])[0]])
                assert new != name and all(regex.fullmatch(r"\p{Lu}[\p{L}\p{M}.'’-]*", x) or x in pii_surrogates.PARTICLES for x in new.split(" "))
                # The family name reads alike everywhere in a document.
                assert names.setdefault(name.split(" ")[-1], new.split(" ")[-1]) == new.split(" ")[-1]
                rest = rest[len(new) :]
                if " " not in name:
                    assert seen.setdefault((kind, name), new) == new
                continue
            new = rest[: len(m[0])]
            if kind in ("email", "secret", "ip", "card", "phone", "ssn"):
                assert kind == "secret" or shape(new) == shape(m[0])
                assert patterns[kind].fullmatch(new) and new != m[0]
            normal, plain = (x.lower() if kind in ("email", "secret") else x if kind == "ip" else re.sub(r"[^0-9A-Za-z+]", "", x) for x in (m[0], new))
            assert seen.setdefault((kind, normal), plain) == plain
            rest = rest[len(new) :]
        assert rest == text[at:]
    assert len(seen) > 10 and len({(k, s) for (k, _), s in seen.items()}) == len(seen)
    assert not {(k, s) for (k, _), s in seen.items()} & set(seen)


# 3 -----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    p, points = (1 << 31) - 1, [ord(c) + 1 for c in text]

    def mixed(a, b):
        one, two = (sum(points[k] * pow(base, k - a, p) for k in range(a, b)) % p for base in prefix_fingerprints.BASES)
        x = ((one << 31) | two) * 0x9E3779B97F4A7C15 % (1 << 64)
        x ^= x >> 29
        return x * 0xBF58476D1CE4E5B9 % (1 << 64)

    parts = [f"{len(points):x}", *(f"{sum(c * pow(base, k, p) for k, c in enumerate(points)) % p:08x}" for base in prefix_fingerprints.BASES)]
    for span, slots in ((20, 64), (4, 16)):
        best: dict = {}
        width = min(span, len(points))
        for a in range(len(points) - width + 1 if points else 0):
            x = mixed(a, a + width)
            slot = x * slots >> 64
            best[slot] = min(best.get(slot, x), x)
        parts.append("".join(f"{best[s] >> 20 & 0xFFFFFFFF:08x}" if s in best else "." * 8 for s in range(slots)))
    return "-".join(parts)


def test_fingerprints_by_plain_sums(texts):
    for text in ["", "a", "abc", "x" * 30, *[t[:90] for t in list(texts.values())[:25]]]:
        assert prefix_fingerprints.fingerprint(prefix_fingerprints.PrefixHashes(text)) == plain_fingerprint(text)
    some = [plain_fingerprint(t[:n]) for t in list(texts.values())[:6] for n in (3, 40, 95, 97, 300)]
    for a in some:
        for b in some:
            x, y = a.split("-"), b.split("-")
            shares = []
            for p, q in ((x[3], y[3]), (x[4], y[4])):
                cells = [(p[k : k + 8], q[k : k + 8]) for k in range(0, len(p), 8)]
                used = [c for c in cells if c != (".." * 4, ".." * 4)]
                shares.append(sum(c[0] == c[1] for c in used) / len(used) if used else 0.0)
            w = 10 / (20 + min(int(x[0], 16), int(y[0], 16)))
            assert prefix_fingerprints.likeness(a, b) == (1.0 if a == b else pytest.approx((1 - w) * shares[0] + w * shares[1]))


# 10 ----------------------------------------------------------------------------------------


def plain_mix(rows, repeats, every):
    """rows: source, n_tokens, draw of a pass. Copies by the definition, one source and document after the other."""
    tokens, sizes = collections.Counter(), collections.Counter()
    for source, n, _ in rows:
        tokens[source] += n
        sizes[source] += 1
    whole = sum(tokens.values())
    share = {s: n / whole for s, n in tokens.items()}

    def passes(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z / p for s, p in share.items()}

    low, high = 0.0, 1.0
    scale = lambda a: 1 / min(passes(a).values()) if every else 1.0
    if max(passes(0.0).values()) * scale(0.0) > repeats:
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if max(passes(middle).values()) * scale(middle) > repeats else (low, middle)
    else:
        high = 0.0
    copies = [0] * len(rows)
    for s in tokens:
        budget = round(passes(high)[s] * share[s] * whole * scale(high))
        full, rest = divmod(budget, tokens[s])
        used = 0
        blocks = math.ceil(math.sqrt(sizes[s]))
        order = lambda k: (math.floor(rows[k][2](full) % (1 << 40) / (1 << 40) * blocks), rows[k][2](full))
        for k in sorted((k for k in range(len(rows)) if rows[k][0] == s), key=order):
            used += rows[k][1]
            copies[k] = full + (used <= rest)
    return copies


@pytest.mark.parametrize("every", [False, True])
def test_mix_by_plain_definition(spark, docs, every):
    budget = None if every else 1.0
    most = 8
    draws = F.array(*[F.xxhash64(F.lit(17), F.lit(k).cast("long"), F.col("doc_id"), F.col("n")) for k in range(most)])
    rows = docs.select("doc_id", "source", mixing.token_column().alias("n")).withColumn("draws", draws).collect()
    want = plain_mix([(r.source, r.n, lambda k, d=r.draws: d[k]) for r in rows], 2.0, every)
    got = {r.doc_id: r.copies for r in mixing.mixed(docs, repeats=2.0, budget=budget).collect()}
    assert got == dict(zip([r.doc_id for r in rows], want))
    if every:
        staged = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
        assert staged == {d: n for d, n in got.items() if n}


# Pipeline ----------------------------------------------------------------------------------


def test_near_duplicate_stage(spark, docs, texts):
    sets = {}
    for d, t in texts.items():
        words = t.encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {d for d in ids if find(d) == d}


def test_decontamination_stage(spark, docs, texts):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = set()
    for d, t in texts.items():
        have = words(t)
        at = collections.defaultdict(list)
        for p, w in enumerate(have):
            at[w].append(p)
        for own in items:
            width = min(13, len(own))
            need = math.ceil(width * 11 / 13)
            shifts = collections.Counter(p - q for q, w in enumerate(own) for p in at.get(w, ()))
            for shift, n in shifts.items():
                if n < need:
                    continue
                same = [0 <= q + shift < len(have) and have[q + shift] == w for q, w in enumerate(own)]
                if any(sum(same[s : s + width]) >= need for s in range(len(own) - width + 1)):
                    dirty.add(d)
    kept = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()}
    assert kept == set(texts) - dirty and dirty


def test_toxicity_stage(spark, docs, texts):
    chain, stems = toxicity_chain.fitted_chain(docs, table(spark, SF, "labels"))
    assert [link.name for link in chain] == ["kind_1", "kind_2", "toxic"]
    toxic = set()
    for d, t in texts.items():
        before: list[float] = []
        for link in chain:
            features = {n for w in set(re.findall(r"\w+", t.lower())) for n in stems._numbers(w)}
            values = {n: float(link.scale[n]) for n in features}
            norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
            total = link.offset + sum(w * (p - 0.5) for w, p in zip(link.earlier, before)) + sum(float(link.weights[n]) * v for n, v in values.items()) / norm
            before.append(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))))
        if abs(before[-1] - chain[-1].threshold) > 1e-6 and before[-1] >= chain[-1].threshold:
            toxic.add(d)
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert kept == set(texts) - toxic and toxic


def test_kinds_part_the_toxic_texts():
    from opportunity.llm.linear_text import Rows

    rng = np.random.default_rng(3)
    y = np.array([1.0] * 40 + [0.0] * 160)
    rows = Rows([np.unique(np.concatenate([rng.integers(100, 200, 6), [1 + i % 2] if v else [50]])) for i, v in enumerate(y)])
    kinds = toxicity_chain.toxic_kinds(rows, y, 2)
    assert (kinds["kind_1"] + kinds["kind_2"] == y).all()
    assert {tuple(sorted({i % 2 for i in range(40) if k[i]})) for k in kinds.values()} == {(0,), (1,)}
    assert all(not k.any() for k in toxicity_chain.toxic_kinds(rows, np.zeros(200), 2).values())
