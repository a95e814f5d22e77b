"""Document fingerprints from prefix polynomial hashes.

For code points ``c[0..n)`` the prefix array is ``H[i] = sum(c[j] * B**j for j < i) mod p`` with
``p = 2**31 - 1`` and two bases, so that a span ``[a, b)`` has the hash ``(H[b] - H[a]) / B**a``
in both bases. The arrays answer the equality of any two spans in constant time, and binary
search over span lengths gives the longest common extension from any two places.

A fingerprint has three parts: the hash of the whole text; for each of 64 slots the smallest
mixed hash of the spans of 20 code points that fall into it (the whole text where it is shorter);
and the same for 16 slots and spans of 4. It does not depend on where a passage stands. The
likeness of two fingerprints is the share of equal slots among those either one has: of the long
spans and, with a weight of 10 / (20 + code points of the shorter text), of the short ones; 1
where the fingerprints are equal; 0 where one is of an empty text and the other isn't. Equal
texts have equal fingerprints.

``edited_pairs`` compares each document with an edited copy and with the next document in
ascending doc_id order; rows of one id, null ids too, are ordered by a hash of their text, and
null ids come first. Documents are dealt into ranges of (doc_id, hash) whose bounds are quantiles
of sampled keys, as in any range partitioning, so that many rows of one id are spread as well;
only rows alike in id and text stay together. The first document of each range also goes to the
range before, so that every pair meets in one task with one shuffle of the texts and no global
window. Null texts count as empty. A table of one row has itself as the next document; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opportunity.llm.common import beside_texts, partitions

P = (1 << 31) - 1
BASES = (911382323, 972663749)
SPAN, SLOTS = 20, 64
SHORT_SPAN, SHORT_SLOTS = 4, 16
#: Ranges for each task, so that tasks even out, and sampled keys for each range.
RANGES_A_TASK, KEYS_A_RANGE = 8, 16
#: Stands for a null id in the order of documents.
FIRST_ID = -(1 << 63)


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod P for 0 <= x < 2**62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


class Powers:
    """Powers of the bases and of their inverses, grown as longer texts come."""

    def __init__(self) -> None:
        self.tables = [(np.ones(1, np.int64), np.ones(1, np.int64)) for _ in BASES]

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        while len(self.tables[0][0]) < n:
            grown = []
            for base, (up, down) in zip(BASES, self.tables):
                k = len(up)
                factor, inverse = pow(base, k, P), pow(pow(base, k, P), -1, P)
                grown.append((np.concatenate([up, _mod(up * factor)]), np.concatenate([down, _mod(down * inverse)])))
            self.tables = grown
        return self.tables


_POWERS = Powers()


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        self.n = len(points)
        self.powers = _POWERS.upto(self.n + 1)
        self.arrays = []
        for up, _ in self.powers:
            terms = _mod(points * up[: self.n])
            self.arrays.append(np.concatenate([np.zeros(1, np.int64), _mod(np.cumsum(terms))]))  # below 2**62 for texts of 2**31

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of this length, by start, both bases in one unsigned number."""
        count = self.n - length + 1
        parts = []
        for h, (_, down) in zip(self.arrays, self.powers):
            d = h[length:] - h[:count]
            parts.append(_mod(np.where(d < 0, d + P, d) * down[:count]))
        return (parts[0].astype(np.uint64) << np.uint64(31)) | parts[1].astype(np.uint64)

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """Hash of one span."""
        return tuple(int(h[start + length] - h[start]) % P * int(down[start]) % P for h, (_, down) in zip(self.arrays, self.powers))

    def whole(self) -> tuple[int, ...]:
        return tuple(int(h[self.n]) for h in self.arrays)


def spans_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether ``a[i:i+length]`` and ``b[j:j+length]`` are equal (up to a hash collision)."""
    return i + length <= a.n and j + length <= b.n and a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension from place ``i`` of a and ``j`` of b."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def slots_of(hashes: PrefixHashes, span: int, slots: int) -> str:
    """Smallest mixed span hash by slot in eight hex digits; dots where a slot has none."""
    if not hashes.n:
        return "." * 8 * slots
    mixed = hashes.spans(min(span, hashes.n)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed = np.sort(mixed)
    shift = np.uint64(64 - slots.bit_length() + 1)
    slot, at = np.unique(mixed >> shift, return_index=True)
    body = ["." * 8] * slots
    for k, value in zip(slot.tolist(), (mixed[at] >> np.uint64(20)).tolist()):
        body[k] = f"{value & 0xFFFFFFFF:08x}"
    return "".join(body)


def fingerprint(hashes: PrefixHashes) -> str:
    """Length, both whole hashes, slots of long spans and of short ones."""
    parts = [slots_of(hashes, SPAN, SLOTS), slots_of(hashes, SHORT_SPAN, SHORT_SLOTS)]
    return "-".join([f"{hashes.n:x}", *(f"{h:08x}" for h in hashes.whole()), *parts])


def _share(x: str, y: str) -> float:
    pairs = [(x[k : k + 8], y[k : k + 8]) for k in range(0, len(x), 8)]
    used = [p == q for p, q in pairs if p[0] != "." or q[0] != "."]
    return sum(used) / len(used) if used else 0.0


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = a.split("-"), b.split("-")
    short = SPAN / 2 / (SPAN + min(int(x[0], 16), int(y[0], 16)))
    return (1 - short) * _share(x[3], y[3]) + short * _share(x[4], y[4])


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; nothing is shuffled."""

    def each(texts: list[str]) -> dict[str, list]:
        marks = [PrefixHashes(t) for t in texts]
        return {"n_chars": [m.n for m in marks], "fingerprint": [fingerprint(m) for m in marks]}

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return beside_texts(read, lambda: each, "n_chars long, fingerprint string")


def _ranges(rows: DataFrame, ranges: int) -> Column:
    """The range of each row of ``rows`` by (place, tie), as a column."""
    total = rows.count()
    sample = rows.sample(min(1.0, KEYS_A_RANGE * ranges / max(1, total)), 23).select("place", F.xxhash64("text").alias("tie"))
    keys = sorted((r.place, r.tie) for r in sample.collect())  # KEYS_A_RANGE for each range, whatever the table's size
    cuts = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
    ids, ties = (np.array([cut[i] for cut in cuts], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def range_of(place: pd.Series, tie: pd.Series) -> pd.Series:
        """How many cuts are at or before a row."""
        low, at = (np.searchsorted(ids, place, side) for side in ("left", "right"))
        for first in np.unique(low[low < at]):  # ids that are cuts themselves
            own = (low == first) & (low < at)
            upto = np.searchsorted(ids, ids[first], "right")
            at[own] = first + np.searchsorted(ties[first:upto], tie[own], "right")
        return pd.Series(at.astype(np.int32))

    return range_of("place", "tie")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(doc_id, F.lit(FIRST_ID)).alias("place"))
    at = _ranges(rows, RANGES_A_TASK * partitions(spark))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.withColumn("at", at)
    firsts = {r.at: r.first for r in dealt.groupBy("at").agg(F.min(F.struct("place", "tie")).alias("first")).collect()}  # a row for each range
    filled = sorted(firsts)
    before = [(firsts[at].place, firsts[at].tie, filled[k - 1], 1 if k else 2) for k, at in enumerate(filled)]
    lookahead = spark.createDataFrame(before, "place long, tie long, range_before int, turn int")
    shown = dealt.withColumn("turn", F.lit(0)).select("doc_id", "text", "place", "tie", "at", "turn")
    # As many rows as there are ranges; of rows alike in id and text any one will do.
    heads = rows.join(F.broadcast(lookahead), ["place", "tie"]).dropDuplicates(["range_before", "turn"])
    heads = heads.select("doc_id", "text", "place", "tie", F.col("range_before").alias("at"), "turn")
    together = shown.unionByName(heads).repartition(partitions(spark), "at").sortWithinPartitions("at", "turn", "place", "tie")
    fields = to_arrow_schema(StructType.fromDDL(PAIRS_SCHEMA))
    return together.select("doc_id", "text", "at", "turn").mapInArrow(lambda batches: _compare(batches, fields), PAIRS_SCHEMA)


PAIRS_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, same_start_edited long, same_start_next long"
)


def _compare(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come by range and order; rows with a turn over 0 only follow as the next document."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for doc_id, text, at, turn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "at", "turn"))):
            here = PrefixHashes(text)
            mark = fingerprint(here)
            if held is not None and held[4] == at:
                old_id, old_text, old, old_mark, _ = held
                changed_text = edited(old_text, text)
                changed = PrefixHashes(changed_text)
                changed_mark = fingerprint(changed)
                digest = hashlib.sha256(changed_text.encode()).hexdigest()
                near = likeness(old_mark, changed_mark), likeness(old_mark, mark)
                same = common_extension(old, 0, changed, 0), common_extension(old, 0, here, 0)
                out.append((old_id, old.n, digest, old_mark, changed_mark, *near, *same))
            held = (doc_id, text, here, mark, at) if turn == 0 else None
        yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*out) if out else [[]] * len(fields), fields)], schema=fields)
