"""Running totals and places in an order, without a task for a whole group.

Rows are dealt into ranges of (keys, order) and stored; the sums of the ranges, a row for each
key and range, give what stands before each of them. So a group that holds most of the rows is
spread over as many tasks as it fills.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.functions.stored import stored


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], measure: Column | None = None) -> DataFrame:
    """``df`` with ``_upto`` (sum of ``measure``, or rows, up to and with the row) and ``_all`` (that of its keys).

    ``order`` must be total within the keys, or rows that tie may come in any order. Null keys are
    a group of their own.
    """
    measure = F.lit(1).cast("long") if measure is None else measure
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*[F.col(k) for k in keys], *order]
    dealt = df.withColumn("_m", measure).repartitionByRange(ranges, *sort).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_m").alias("_sum"))
    own = Window.partitionBy(*keys)
    before = F.sum("_sum").over(own.orderBy("_range")) - F.col("_sum")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    offsets = sums.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_range").alias("_r"), before.alias("_before"), F.sum("_sum").over(own).alias("_all"))
    inside = F.sum("_m").over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = F.col("_range") == F.col("_r")
    for key, name in names.items():
        on &= F.col(key).eqNullSafe(F.col(name))
    joined = dealt.withColumn("_inside", inside).join(offsets, on)
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias("_upto"), "_all")


def places_in(df: DataFrame, orders: Mapping[str, tuple[Sequence[str], Sequence[tuple[str, bool]]]]) -> DataFrame:
    """``df`` with a column for each of ``orders``: the row's place from 1 within keys, in an order of (column, ascending).

    All orders go through one set of ranges and one table, written while the plan is built: a row stands in it
    once for each order, and carries its columns once. Orders must be total within their keys.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.monotonically_increasing_id().alias("_id"), F.struct(*df.columns).alias("_row"))
    rows = rows.withColumn("_o", F.explode(F.array(*[F.lit(k) for k in range(len(orders))])))
    sort, key = [F.col("_o"), F.col("_key")], F.lit(None).cast("string")
    for at, (keys, order) in enumerate(orders.values()):
        own = F.col("_o") == at
        key = F.when(own, F.to_json(F.struct(F.lit(at).alias("_"), *[F.col(f"_row.{k}") for k in keys]))).otherwise(key)
        for j, (column, ascending) in enumerate(order):
            # Null in the rows of other orders, so it does not sort these.
            rows = rows.withColumn(f"_s{at}_{j}", F.when(own, F.col(f"_row.{column}")))
            sort.append(F.asc(f"_s{at}_{j}") if ascending else F.desc(f"_s{at}_{j}"))
    rows = rows.withColumn("_key", key).withColumn("_row", F.when(F.col("_o") == 0, F.col("_row")))
    dealt = stored(rows.repartitionByRange(ranges, *sort).withColumn("_range", F.spark_partition_id()), "places")
    counts = dealt.groupBy("_o", "_key", "_range").agg(F.count("*").alias("_n"))
    before = counts.select("_o", "_key", "_range", (F.sum("_n").over(Window.partitionBy("_o", "_key").orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", "_o", "_key").orderBy(*sort[2:]))
    placed = dealt.withColumn("_inside", inside).join(before, ["_o", "_key", "_range"])
    found = placed.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), *[F.max(F.when(F.col("_o") == k, F.col("_before") + F.col("_inside"))).alias(f"_p{k}") for k in range(len(orders))])
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns], *[F.col(f"_p{k}").alias(name) for k, name in enumerate(orders)])


def counted_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and each known value, with _equal (rows that have it), _upto (rows at or below it) and _all."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_equal"))
    return running_total(counted, keys, [F.col(value)], F.col("_equal"))


def percentiles_by_rank(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Percentiles with linear interpolation, read off the counts of the values."""
    ranked = counted_values(df, keys, value)
    parts = []
    for name, p in points.items():
        place = (F.col("_all") - 1) * p
        parts += [F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).alias(f"_{name}_low"), F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).alias(f"_{name}_high")]
    found = ranked.groupBy(*keys).agg(*parts, F.first("_all").alias("_all"))
    between = [
        (F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * ((F.col("_all") - 1) * p - F.floor((F.col("_all") - 1) * p))).alias(name) for name, p in points.items()
    ]
    return found.select(*keys, *between)
