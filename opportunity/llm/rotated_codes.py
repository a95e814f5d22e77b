"""Nearest neighbours by randomly rotated one-bit codes.

A vector's difference from a centre is turned by a random rotation and kept as one bit a dimension,
with three scalars: its length, its cosine with the corner of the cube that the bits name, and the
row's id. The inner product of a query with the difference is estimated from the packed bits and
divided by that cosine; the error is at most ``spread`` * sqrt((1 - c^2) / c^2 / (d - 1)) of the
lengths' product, but for a small chance. A row whose distance could be, within that bound, as near as
the k-th best so far is compared on its original vector in doubles; all others are passed over. So
the distances are exact, and a neighbour can only be missed where the bound fails.

The index holds every vector; only the centre is fitted on a sample (``SAMPLE`` rows by a hash of
the id). Queries are a stated set and are taken in blocks of QUERY_BYTES, each against all rows.

Defined cases: null, zero and empty vectors and those with null or non-finite components take no
part; vectors of different length are never compared; rows that share an id are candidates of their
own, but a query is never compared with a row of its own id; a null id is no query's, and as a
candidate comes after the others; equal distances are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.llm.common import arrow_batches, written

#: Rows that the centre of the codes is the mean of.
SAMPLE = 10_000
#: Bytes of the queries (their vectors) that are compared with all rows in one pass.
QUERY_BYTES = 8 << 20
#: Groups of tasks whose nearest rows are merged first.
MERGE_GROUPS = 64
#: Numbers that a task may hold as estimates at a time.
CELLS = 4_000_000
SEED = 20


def _width(size: int) -> int:
    """Dimensions after padding: a power of two, 8 at least."""
    return max(8, 1 << (size - 1).bit_length())


def rotated(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """``rows`` (padded with zeros to a power of two) under a random rotation: three turns of random signs and a Hadamard transform."""
    width = _width(rows.shape[1])
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (3, width))
    for turn in signs:
        out *= turn
        step = 1
        while step < width:
            halves = out.reshape(len(rows), -1, 2, step)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(rows), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def coded(rows: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, length and cosine of each row; a row on the centre has length 0 and cosine 1."""
    turned = rotated(rows - centre)
    length = np.sqrt((turned**2).sum(axis=1))
    along = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    cosine = np.divide(along, length, out=np.ones(len(rows)), where=length > 0)
    return np.packbits(turned > 0, axis=1), length, np.maximum(cosine, 1e-6)


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """id, size and vec of the rows that take part."""
    vec = F.col(column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = (F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.size(vec).alias("size"), vec.alias("vec"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def build_index(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index, in the work folder: id, size, vec, code, length and cosine of every usable row; and the centre of each size."""
    rows = _usable(vectors, column)
    order = Window.partitionBy("size").orderBy(F.xxhash64("id", F.lit(SEED)), "id")
    some = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE)
    means = some.select("size", F.posexplode("vec").alias("at", "x")).groupBy("size", "at").agg(F.avg("x").alias("x")).collect()
    centres: dict[int, np.ndarray] = {}
    for r in means:
        centres.setdefault(r.size, np.zeros(r.size))[r.at] = r.x

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                bits, length, cosine = coded(_matrix(own.column("vec"), int(size)), centres[int(size)])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(cosine)], [*own.schema.names, "code", "length", "cosine"])

    coded_rows = rows.mapInArrow(mapped, "id long, size int, vec array<double>, code binary, length double, cosine double")
    return written(coded_rows, "codes"), centres


class _Nearest:
    """The k nearest rows of each query that a task has seen."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.distance = np.full((queries, k), np.inf)
        self.id = np.zeros((queries, k), np.int64)
        self.unknown = np.ones((queries, k), bool)

    def add(self, q: int, distance: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        distance, ids, unknown = np.concatenate([self.distance[q], distance]), np.concatenate([self.id[q], ids]), np.concatenate([self.unknown[q], unknown])
        first = np.lexsort((ids, unknown, distance))[: self.k]
        self.distance[q], self.id[q], self.unknown[q] = distance[first], ids[first], unknown[first]


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles, squares added in the order of the dimensions."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        total += (rows[:, i] - query[i]) ** 2
    return np.sqrt(total)


def _search_block(best: _Nearest, queries: np.ndarray, query_ids: np.ndarray, turned: np.ndarray, rows: pa.RecordBatch, size: int, spread: float) -> None:
    """Compare one block of codes with all queries, and rerank what the bound leaves."""
    vec, ids = _matrix(rows.column("vec"), size), rows.column("id").fill_null(0).to_numpy(zero_copy_only=False)
    unknown = rows.column("id").is_null().to_numpy(zero_copy_only=False)
    length, cosine = rows.column("length").to_numpy(), rows.column("cosine").to_numpy()
    width = turned.shape[1]
    packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    corners = (np.unpackbits(packed, axis=1, count=width).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(width))
    reach = np.sqrt((turned**2).sum(axis=1))
    off = spread * np.sqrt((1 - np.minimum(1, cosine**2)) / cosine**2 / max(1, width - 1))
    step = max(1, CELLS // max(1, len(ids)))
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        inner = (corners @ turned[part].T.astype(np.float32)).T.astype(np.float64) / cosine * length
        square = length**2 + reach[part, None] ** 2 - 2 * inner
        slack = 2 * length * reach[part, None] * (off + 1e-5)  # the second is the rounding of the single-precision estimate
        for at, q in enumerate(range(start, min(len(queries), start + step))):
            own = unknown | (ids != query_ids[q])
            if np.isinf(best.distance[q, -1]):  # no k-th distance yet: the nearest by estimate give one
                likely = np.flatnonzero(own)
                likely = likely[np.argsort(square[at, likely], kind="stable")[: best.k]]
                best.add(q, _distances(vec[likely], queries[q]), ids[likely], unknown[likely])
                own = own.copy()
                own[likely] = False
            chosen = np.flatnonzero(own & (square[at] - slack[at] <= best.distance[q, -1] ** 2))
            if len(chosen):
                best.add(q, _distances(vec[chosen], queries[q]), ids[chosen], unknown[chosen])


def _pass(index: DataFrame, asked: list[tuple[int, np.ndarray]], centre: np.ndarray, size: int, k: int, spread: float) -> DataFrame:
    ids, queries = np.array([i for i, _ in asked], np.int64), np.stack([v for _, v in asked])
    context = index.sparkSession.sparkContext.broadcast((ids, queries, rotated(queries - centre)))  # at most QUERY_BYTES of vectors

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, turned = context.value
        best = _Nearest(len(vectors), k)
        for batch in batches:
            if batch.num_rows:
                _search_block(best, vectors, query_ids, turned, batch, size, spread)
        q, at = np.nonzero(np.isfinite(best.distance))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(query_ids[q]), pa.array(best.id[q, at], mask=best.unknown[q, at]), pa.array(best.distance[q, at])], ["q", "query_id", "vec_id", "score"])

    return index.filter(F.col("size") == size).mapInArrow(mapped, "q long, query_id long, vec_id long, score double").withColumn("size", F.lit(size))


def search(index: DataFrame, centres: dict[int, np.ndarray], queries: Column, k: int = 10, spread: float = 4.0) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of each row that ``queries`` (a condition on id) is true for.

    Queries are read in blocks of about QUERY_BYTES while the plan is built. ``spread`` is how many
    standard deviations of the estimate the bound allows for.
    """
    spark, parts = index.sparkSession, []
    asked = index.filter(F.coalesce(queries, F.lit(False)) & F.col("id").isNotNull()).select("id", "size", "vec")
    counts = {r.size: r.n for r in asked.groupBy("size").agg(F.count("*").alias("n")).collect()}
    for size, n in sorted(counts.items()):
        blocks = -(-n * 16 * _width(size) // QUERY_BYTES)
        for block in range(blocks):
            rows = asked.filter((F.col("size") == size) & (F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)) == block)).collect()
            if rows:
                parts.append(_pass(index, [(r.id, np.array(r.vec)) for r in rows], centres[size], size, k, spread).withColumn("block", F.lit(block)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, parts).withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
    query = ["size", "block", "q"]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("score", F.col("vec_id").asc_nulls_last()))
    some = found.withColumn("rank", rank(*query, "_group")).filter(F.col("rank") <= k)
    return some.withColumn("rank", rank(*query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, column: str = "embedding", spread: float = 4.0) -> DataFrame:
    """``search`` over the index of ``vectors`` (vec_id and ``column``)."""
    with arrow_batches(vectors.sparkSession, rows=5000):
        index, centres = build_index(vectors, column)
    return search(index, centres, queries, k, spread)


ORACLE_SQL = (
    "with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "d as (select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as score from v q join v c on c.vec_id is distinct from q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0), "
    "r as (select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score from d) select * from r where rank <= 10"
)
