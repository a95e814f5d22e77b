"""Ranked lexical search, term at a time with a limited set of accumulators.

The words of a stated set of items are looked for in every document once; what is found is kept as
postings (document, word, occurrences) in the work folder. Numbers of documents and words are taken
from these, and a second pass scores them in blocks of documents. In a block, an item's words are
taken rarest first. A document gets an accumulator when one of its words is met, until the sum of
what the item's remaining words could give at most is less than the k-th best partial score; from
then on no accumulator is made, and those there are are updated to the end. The k best of a task's
earlier blocks count for that bound too. So the k best are exact.

Defined cases: a null text has no words; documents and items that share an id, or have none, are
rows of their own; equal scores are ordered by doc_id, null ids last; a document without a score
above 0 is not returned, so an item without words has no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opportunity.llm.common import arrow_batches, written

#: Bytes of the items' distinct words that one pass over the documents takes; more items take more passes.
ITEM_BYTES = 8 << 20
#: Groups of tasks whose best rows are merged first, so that no task gets a row list of every task.
MERGE_GROUPS = 64

# A word is a run of digits, letters and whatever is not ASCII; in UTF-8 the latter are bytes from 0x80.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, ASCII letters in lower case."""
    return WORD.findall(text.lower()) if text else []


def _item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, terms and how often the item has each."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
            lists = [pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *lists], ["item", "item_id", "terms", "repeats"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(mapped, "item long, item_id long, terms array<binary>, repeats array<long>")
    return written(found.filter(F.size("terms") > 0), "ranking-items")


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (words of the whole text), and the vocabulary's terms in it with their occurrences."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, terms, times = [], [0], [], []
            for text in batch.column("text"):
                found = words_of(text.as_py())
                n.append(len(found))
                for word, count in Counter(found).items():
                    if (term := vocabulary.get(word)) is not None:
                        terms.append(term)
                        times.append(count)
                at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(mapped, "doc_id long, n long, terms array<int>, times array<int>")
    with arrow_batches(docs.sparkSession):
        return written(found, "ranking-postings")


def _document_frequencies(postings: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term; at most ``size`` rows come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    found = postings.select("terms").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}


class _Best:
    """The k best documents of each item that a task has seen."""

    def __init__(self, k: int, items: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.k, self.items = k, items
        self.score = [np.zeros(0, np.int64)] * len(items)
        self.doc = [np.zeros(0, np.int64)] * len(items)
        self.unknown = [np.zeros(0, bool)] * len(items)

    def floor(self, item: int) -> int:
        return int(self.score[item][-1]) if len(self.score[item]) == self.k else 0

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, unknown: np.ndarray) -> None:
        score, doc, unknown = (np.concatenate(x) for x in ((self.score[item], score), (self.doc[item], doc), (self.unknown[item], unknown)))
        first = np.lexsort((doc, unknown, -score))[: self.k]
        self.score[item], self.doc[item], self.unknown[item] = score[first], doc[first], unknown[first]


def _score_block(best: _Best, doc: np.ndarray, unknown: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Term at a time over one block; ``postings`` has the rows and contributions of each term in it."""
    held = np.zeros(len(doc), np.int64)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for item, (terms, repeats) in enumerate(best.items):
        lists = [postings.get(t, nothing) for t in terms.tolist()]
        most = np.array([part.max(initial=0) for _, part in lists], np.int64) * repeats
        ahead = np.cumsum(most[::-1])[::-1]  # what this term and all later ones can give
        held[:] = 0
        kth, creating = best.floor(item), True
        for (rows, part), times, rest in zip(lists, repeats.tolist(), ahead.tolist(), strict=True):
            creating = creating and rest >= kth
            if creating:
                held[rows] += times * part
                partial = held[held > 0]
                if len(partial) >= best.k:
                    kth = max(kth, int(np.partition(partial, -best.k)[-best.k]))
            else:
                alive = held[rows] > 0
                held[rows[alive]] += times * part[alive]
        chosen = np.flatnonzero(held >= max(1, kth))
        if len(chosen):
            best.add(item, held[chosen], doc[chosen], unknown[chosen])


def _scored(postings: DataFrame, items: list[tuple[int, int | None, np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, item_id, doc_id and score: the k best of each task."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, [(terms, repeats) for _, _, terms, repeats in items])
        for batch in batches:
            doc = batch.column("doc_id")
            unknown = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = 75 + (25 * batch.column("n").to_numpy().astype(np.int64) * documents) // length
            terms = batch.column("terms")
            rows = np.repeat(np.arange(len(ids)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            term, times = terms.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            part = weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * size[rows]))
            order = np.argsort(term, kind="stable")
            term, rows, part = term[order], rows[order], part[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(term)] if len(term) else starts
            _score_block(best, ids, unknown, {int(term[a]): (rows[a:b], part[a:b]) for a, b in zip(starts, ends, strict=True)})
        for at, (number, item_id, _, _) in enumerate(items):
            if n := len(best.score[at]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(best.doc[at], pa.int64(), mask=best.unknown[at]), pa.array(best.score[at], pa.int64())], ["item", "item_id", "doc_id", "score"]
                )

    return postings.mapInArrow(mapped, "item long, item_id long, doc_id long, score long")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with rank: groups of tasks first, then all."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    grouped = found.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
    some = grouped.withColumn("rank", rank("item", "_group")).filter(F.col("rank") <= k)
    return some.withColumn("rank", rank("item")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents (doc_id, text) for each item (item_id, text).

    Postings and items are written to the work folder while the plan is built. Items whose words take
    more than ITEM_BYTES are dealt into blocks of about that size, with a pass for each.
    """
    spark = docs.sparkSession
    queries = _item_terms(items)
    held = queries.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16)).alias("n")).first().n or 0
    blocks = max(1, -(-held // ITEM_BYTES))
    parts = []
    for block in range(blocks):
        asked = queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for q in asked for t in q.terms}))}
        postings = _postings(docs, vocabulary)
        total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not total.length or not asked:
            continue
        df = _document_frequencies(postings, len(vocabulary))
        # The natural logarithm in doubles; a word that no document has is never scored.
        weight = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        lists = []
        for q in asked:
            pairs = sorted(((df.get(i, 0), i, n) for t, n in zip(q.terms, q.repeats, strict=True) for i in [vocabulary[bytes(t)]]))
            lists.append((q.item, q.item_id, np.array([i for _, i, _ in pairs], np.int64), np.array([n for _, _, n in pairs], np.int64)))
        parts.append(_scored(postings, lists, weight, total.documents, total.length, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _best_of(reduce(DataFrame.unionByName, parts), k)


# The driver's SQL engine has no lower() for A-Z alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
ORACLE_SQL = (
    f"with d as (select doc_id, {_TERMS} as term from documents where text is not null), q as (select item_id, {_TERMS} as term from benchmark where text is not null), "
    "tf as (select doc_id, term, count(*) as tf from d group by all), n as (select doc_id, sum(tf)::bigint as n from tf group by 1), c as (select count(*) as docs, sum(n)::bigint as len from n), "
    "df as (select term, floor(1000 * ln((2 * (select docs from c) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf group by 1), m as (select doc_id, 75 + ((25 * n * (select docs from c)) // (select len from c)) as m from n), "
    "p as (select tf.term, tf.doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) as p from tf join df using (term) join m using (doc_id)), s as (select item_id, doc_id, sum(p)::bigint as score from q join p using (term) group by all having sum(p) > 0), "
    "r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s) select * from r where rank <= 20"
)
