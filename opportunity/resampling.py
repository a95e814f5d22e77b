"""Bootstraps whose draws depend on a key alone and are summed as partial aggregates.

The clusters of a scope are numbered in order. Place ``j`` of sample ``s`` takes the cluster whose number
is a hash of (seed, scope, s, j) modulo their count, so a lost task draws the same again, and scopes
stay independent. In E3 and E4 no task holds a scope; in E11 one holds two numbers a row, and only
of scopes up to ``ARRAY_ROWS`` rows. With few clusters all resamples are listed instead, as
numbers of times that each cluster is taken and in how many orders.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opportunity.functions.hashes import AT_ONCE, numbered_md5
from opportunity.functions.stored import stored
from opportunity.operators.ranges import running_total

#: Most clusters of which all resamples are listed.
MOST_EXACT = 7
#: Clusters up to which their values are broadcast to the draws; counted first.
BROADCAST_CLUSTERS = 200_000
#: Rows of a scope up to which a task holds their values, to rank samples of them.
ARRAY_ROWS = 4_000_000


def _draws(scopes: DataFrame, scope: str, samples: int, seed: int) -> DataFrame:
    """scope, sample and idx, a row for each place; ``scopes`` has the scope and its count ``k``.

    A hash of 32 digits gives four places.
    """
    each = scopes.select(scope, "k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).repartition(scope, "sample")
    each = each.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / 4))))
    each = each.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(scope).cast("string"), F.col("sample").cast("string"), F.col("_chunk").cast("string"))))
    drawn = each.select(scope, "k", "sample", F.posexplode(F.array(*[F.struct(F.conv(F.substring("_hash", 1 + 8 * p, 8), 16, 10).cast("long").alias("_x"), (4 * F.col("_chunk") + p).alias("_place")) for p in range(4)])).alias("_p", "_d"))
    return drawn.filter(F.col("_d._place") < F.col("k")).select(scope, "sample", (F.col("_d._x") % F.col("k")).alias("idx"))


def resample_table(spark: SparkSession, most: int = MOST_EXACT) -> DataFrame:
    """k, sample, orders, idx and times: every way to take k of k clusters with replacement, for k to ``most``, and in how many orders."""
    rows = []
    for k in range(1, most + 1):
        for sample, taken in enumerate(itertools.combinations_with_replacement(range(k), k)):
            times = Counter(taken)
            orders = math.factorial(k) // math.prod(math.factorial(n) for n in times.values())
            rows += [(k, sample, orders, idx, n) for idx, n in times.items()]
    return spark.createDataFrame(rows, "k long, sample int, orders long, idx long, times long")


def _light(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_CLUSTERS + 1).count() <= BROADCAST_CLUSTERS else df


def interpretation(low: Column, high: Column) -> Column:
    return F.when(high < 0, "lower_error").when(low > 0, "higher_error").otherwise("uncertain")


def paired_cluster_bootstrap(deltas: DataFrame, scope: str, cluster: str, delta: str, samples: int = 2000, level: float = 0.90, seed: int = 0, exact_to: int = 0, pooled: bool = False) -> DataFrame:
    """Interval of the mean of cluster means, per scope (or, ``pooled``, of the mean of all rows of the clusters taken).

    With up to ``exact_to`` clusters (7 at most) all resamples are listed instead of drawn. Null deltas
    take no part. Cluster sums are written to the work folder while the plan is built.
    """
    if exact_to > MOST_EXACT:
        raise ValueError("all resamples of more than 7 clusters are too many")
    known = deltas.filter(F.col(delta).isNotNull())
    means = known.groupBy(scope, cluster).agg(F.sum(delta).alias("_sum"), F.count(delta).alias("_n"), F.sum(F.when(F.col(delta) < 0, 1).otherwise(0)).alias("_wins"))
    numbered = running_total(means, [scope], [F.col(cluster)])
    value = [F.col("_sum"), F.col("_n").cast("double")] if pooled else [F.col("_sum") / F.col("_n"), F.lit(1.0)]
    values = stored(numbered.select(F.col(scope).alias("scope"), (F.col("_upto") - 1).alias("idx"), F.col("_all").alias("k"), value[0].alias("_x"), value[1].alias("_w"), "_sum", "_n", "_wins"), "clusters")
    scopes = values.groupBy("scope").agg(F.max("k").alias("k"), F.sum("_n").alias("rows"), F.sum("_sum").alias("_sum"), F.sum("_wins").alias("_wins"))
    side = _light(values.select("scope", "idx", "_x", "_w"))
    taken = _draws(scopes.filter(F.col("k") > exact_to).select("scope", "k"), "scope", samples, seed).select("scope", "sample", "idx", F.lit(1).cast("long").alias("times"), F.lit(1).cast("long").alias("orders"))
    if exact_to:
        listed = scopes.filter(F.col("k") <= exact_to).select("scope", "k").join(F.broadcast(resample_table(deltas.sparkSession, exact_to)), "k")  # at most 8,000 rows
        taken = taken.unionByName(listed.select("scope", "sample", "idx", "times", "orders"))
    drawn = taken.join(side, ["scope", "idx"]).groupBy("scope", "sample").agg((F.sum(F.col("times") * F.col("_x")) / F.sum(F.col("times") * F.col("_w"))).alias("_mean"), F.first("orders").alias("_orders"))
    tail = (1 - level) / 2
    interval = drawn.groupBy("scope").agg(F.percentile("_mean", F.array(F.lit(tail), F.lit(1 - tail)), F.col("_orders")).alias("_i"))
    joined = scopes.join(interval, "scope")
    low, high = F.get("_i", F.lit(0)), F.get("_i", F.lit(1))
    return joined.select("scope", "rows", F.col("k").alias("clusters"), (F.col("_sum") / F.col("rows")).alias("mean_delta"), low.alias("low"), high.alias("high"), (F.col("_wins") / F.col("rows")).alias("win_rate"), interpretation(low, high).alias("interpretation"))


def _drawn(prefix: bytes, k: int) -> np.ndarray:
    """How often a sample takes each of ``k`` rows: the counts of the places that ``_draws`` gives it."""
    places = np.empty(-(-k // 4) * 4, np.uint32)
    for low in range(0, len(places) // 4, AT_ONCE):
        high = min(low + AT_ONCE, len(places) // 4)
        places[4 * low : 4 * high] = numbered_md5([prefix], low, high)[:, 0].T.ravel()
    return np.bincount(places[:k] % np.uint32(k), minlength=k)


def _value_groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their values, where each value starts, and each row's value by number."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    placed = values[order]
    new = np.append(True, (placed[1:] != placed[:-1]) & ~(np.isnan(placed[1:]) & np.isnan(placed[:-1])))
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _correlations(scope: str, samples: range, seed: int, x: np.ndarray, y: np.ndarray) -> list[float]:
    """The rank correlation of each of a scope's samples; degenerate ones are left out."""
    sides, found = (_value_groups(x), _value_groups(y)), []
    for sample in samples:
        times = _drawn(f"{seed}|{scope}|{sample}|".encode(), len(x))
        n, ranks, sums, squares = float(len(x)), [], [], []
        for order, starts, number in sides:
            # Rows of one value share the middle of their places: those before, and half of those that tie.
            tied = np.add.reduceat(times[order], starts)
            rank = np.cumsum(tied) - (tied - 1) / 2
            sums.append(float(tied @ rank))
            squares.append(float(tied @ (rank * rank)))
            ranks.append(rank[number])
        (a, b), (va, vb) = sums, (n * q - s * s for q, s in zip(squares, sums, strict=True))
        if va > 0 and vb > 0:
            found.append((n * float((times * ranks[0]) @ ranks[1]) - a * b) / math.sqrt(va) / math.sqrt(vb))
    return found


def _rank_samples(samples: int, parts: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Correlations of the samples of each part of a scope, whose rows come one after the other in the order of idx."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            (scope, part), x, y = now, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            own = range(samples * part // parts, samples * (part + 1) // parts)
            rho = _correlations(scope, own, seed, x, y)
            return pa.RecordBatch.from_arrays([pa.array([scope] * len(rho), pa.string()), pa.array(rho, pa.float64())], ["scope", "_rho"])

        for batch in batches:
            runs = batch.column("_run").to_numpy()
            starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])[: len(runs)])
            for start, end in zip(starts, [*starts[1:], len(runs)], strict=True):
                key = (batch.column("scope")[int(start)].as_py(), batch.column("_part")[int(start)].as_py())
                if key != now:
                    if held:
                        yield done()
                    now, held = key, []
                held.append([np.array(batch.column(c).slice(start, end - start).to_numpy(zero_copy_only=False), float) for c in ("_x", "_y")])
        if held:
            yield done()

    return mapped


def _rank_samples_by_array(values: DataFrame, scopes: int, samples: int, seed: int) -> DataFrame:
    """scope and _rho of every sample of scopes of up to ``ARRAY_ROWS`` rows: each sample counts its draws in one array.

    ``values`` has scope, idx, _x and _y. A scope's rows go to as many tasks as share its samples.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(samples, max(1, -(-2 * tasks // scopes)))
    dealt = values.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.withColumn("_run", F.xxhash64("scope", "_part")).repartitionByRange(parts * scopes, "_run").sortWithinPartitions("_run", "scope", "_part", "idx")
    return dealt.select("scope", "_part", "_run", "_x", "_y").mapInArrow(_rank_samples(samples, parts, seed), "scope string, _rho double")


def _rank_samples_by_shuffle(values: DataFrame, scopes: DataFrame, samples: int, seed: int) -> DataFrame:
    """The same for scopes of any size, with a row for each row drawn and windows over those of a sample."""
    taken = _draws(scopes.select("scope", "k"), "scope", samples, seed).groupBy("scope", "sample", "idx").agg(F.count("*").alias("m"))
    rows = taken.join(_light(values), ["scope", "idx"])
    own = Window.partitionBy("scope", "sample")
    for name in ("_x", "_y"):
        rows = rows.withColumn(f"_r{name}", F.sum("m").over(own.orderBy(name)) - (F.sum("m").over(Window.partitionBy("scope", "sample", name)) - 1) / 2)
    m, a, b = F.col("m"), F.col("_r_x"), F.col("_r_y")
    n = F.sum(m)
    sums = rows.groupBy("scope", "sample").agg(n.alias("n"), F.sum(m * a).alias("a"), F.sum(m * b).alias("b"), F.sum(m * a * a).alias("aa"), F.sum(m * b * b).alias("bb"), F.sum(m * a * b).alias("ab"))
    va, vb = F.col("n") * F.col("aa") - F.col("a") * F.col("a"), F.col("n") * F.col("bb") - F.col("b") * F.col("b")
    return sums.filter((va > 0) & (vb > 0)).select("scope", ((F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(va) / F.sqrt(vb)).alias("_rho"))


def bootstrap_spearman(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str, samples: int = 2000, level: float = 0.95, seed: int = 0, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Interval (low, high) of the rank correlation over resampled rows, by key; degenerate samples are skipped.

    ``unit`` tells the rows of a key apart and numbers them. A sample's average ranks come from how often
    each row was taken, in the order of the values. With less than half of the samples usable the
    interval is null. Numbered rows are written to the work folder while the plan is built. Keys of more than
    ``array_rows`` rows are not held by one task.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *unit, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    both = both.withColumn("scope", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    values = stored(running_total(both, ["scope"], [F.col(u) for u in unit]).withColumn("idx", F.col("_upto") - 1), "rank-units")
    scopes = values.groupBy("scope", *keys).agg(F.max("_all").alias("k"))
    sizes = scopes.agg(F.count(F.when(F.col("k") <= array_rows, 1)).alias("small"), F.count(F.when(F.col("k") > array_rows, 1)).alias("large")).first()
    rows = lambda which: values.filter(which).select("scope", "idx", "_x", "_y")
    found = _rank_samples_by_array(rows(F.col("_all") <= array_rows), max(1, sizes.small), samples, seed)
    if sizes.large:
        found = found.unionByName(_rank_samples_by_shuffle(rows(F.col("_all") > array_rows), scopes.filter(F.col("k") > array_rows), samples, seed))
    tail = (1 - level) / 2
    interval = found.groupBy("scope").agg(F.percentile("_rho", F.array(F.lit(tail), F.lit(1 - tail))).alias("_i"), F.count("*").alias("samples"))
    enough = F.col("samples") >= max(1, samples // 2)
    return scopes.join(interval, "scope", "left").select(*keys, F.when(enough, F.get("_i", F.lit(0))).alias("low"), F.when(enough, F.get("_i", F.lit(1))).alias("high"), F.coalesce("samples", F.lit(0)).cast("long").alias("samples"))
