"""Windows, ranks, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.functions.clean import safe_ratio
from opportunity.functions.stored import stored
from opportunity.operators.ranges import counted_values, running_total
from opportunity.quality import QualityError


#: Positions of a league.
MOST_POSITIONS = 64
#: Digits to which shares are compared: sums of the same numbers in another order are equal.
TIE_DIGITS = 9


def share_in_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value over the sum of its group; null where the group has no mass (see ``checked_share``)."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(keys)).withColumn("share", safe_ratio(F.col(value), F.when(F.col("_total") != 0, F.col("_total")))).drop("_total")


def checked_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """W1 with its error: a group without mass."""
    empty = df.groupBy(*keys).agg(F.sum(value).alias("_total")).filter(~F.coalesce(F.col("_total") > 0, F.lit(False)))
    if found := empty.select(*keys).limit(1).collect():
        raise QualityError(f"no mass in {found[0].asDict()}")
    return share_in_group(df, keys, value)


def _once(df: DataFrame) -> DataFrame:
    """``df`` computed once: a value that is a sum may have other last bits the next time, and would not find its own rank."""
    return stored(df, "to-rank")


def average_rank_percentile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean rank of ties on 0..1; 0.5 for a group of one. ``df`` is written to the work folder while the plan is built."""
    df = _once(df)
    place = (F.col("_upto") - (F.col("_equal") + 1) / 2) / (F.col("_all") - 1)
    ranks = counted_values(df, keys, value).withColumn("percentile", F.when(F.col("_all") == 1, 0.5).otherwise(place))
    return df.join(ranks.drop("_upto", "_equal", "_all"), [*keys, value], "left")


def midrank_percentile(df: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(below + half of equal) over the size of a reference set; 0.5 without one. ``df`` is written to the work folder while the plan is built."""
    df = _once(df)
    both = df.select(*keys, value).distinct().withColumn("_n", F.lit(0)).unionByName(reference.select(*keys, value).withColumn("_n", F.lit(1)))
    counted = both.groupBy(*keys, value).agg(F.sum("_n").alias("_equal"))
    ranked = running_total(counted, keys, [F.col(value)], F.col("_equal"))
    ranks = ranked.select(*keys, value, F.when(F.col("_all") == 0, 0.5).otherwise((F.col("_upto") - F.col("_equal") / 2) / F.col("_all")).alias("percentile"))
    return df.join(ranks, [*keys, value], "left")


def cume_percentile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """100 times the share of peers at or below the value. ``df`` is written to the work folder while the plan is built."""
    df = _once(df)
    ranks = counted_values(df, keys, value).withColumn("percentile", 100 * F.col("_upto") / F.col("_all"))
    return df.join(ranks.drop("_upto", "_equal", "_all"), [*keys, value], "left")


def ordinal_percentile(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Place in a total order on 0..100, one decimal; 50 for a group of one."""
    place, count = F.col("_upto"), F.col("_all")
    ranked = running_total(df, keys, order)
    return ranked.withColumn("percentile", F.when(count == 1, 50.0).otherwise(F.round(100 * (place - 1) / (count - 1), 1))).drop("_upto", "_all")


def rank_in(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 in a total order."""
    return running_total(df, keys, order).withColumnRenamed("_upto", name).drop("_all")


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order, by a partial aggregate rather than a sort."""
    others = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)], F.struct(*others).alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best._row.*")


def top_role(df: DataFrame, room: Sequence[str], player: str, share: str) -> DataFrame:
    """The player with the largest share, the smallest id of equal ones."""
    return df.groupBy(*room).agg(F.min_by(player, F.struct(-F.round(share, TIE_DIGITS), F.col(player))).alias("top_player"))


def half_season_trend(usage: DataFrame, through_week: int) -> DataFrame:
    """Mean volume of the later and earlier half of the weeks so far.

    ``usage`` has player_id, week, team and volume, and may have target_share, whose late mean is
    late_share. A player with usage and no late game is unavailable.
    """
    middle = through_week // 2
    late, early = F.col("week") > middle, F.col("week") <= middle
    more = [F.avg(F.when(late, F.col("target_share"))).alias("late_share")] if "target_share" in usage.columns else []
    out = usage.filter(F.col("week") <= through_week).groupBy("player_id").agg(
        F.avg(F.when(late, F.col("volume"))).alias("late"),
        F.avg(F.when(early, F.col("volume"))).alias("early"),
        F.count("*").alias("games"),
        F.max(F.struct("week", "team"))["team"].alias("team"),
        *more,
    )
    return out.withColumn("trend", F.coalesce("late", F.lit(0.0)) - F.coalesce("early", F.lit(0.0))).withColumn("unavailable", F.col("late").isNull())


def rolling_usage(usage: DataFrame, latest: int, width: int = 3) -> DataFrame:
    """Mean volume of the last ``width`` weeks against the ones before them."""
    recent = F.col("week").between(latest - width + 1, latest)
    before = F.col("week").between(latest - 2 * width + 1, latest - width)
    return usage.groupBy("player_id").agg(F.avg(F.when(recent, F.col("volume"))).alias("recent"), F.avg(F.when(before, F.col("volume"))).alias("before"))


def drop_to_kth_next(df: DataFrame, keys: Sequence[str], player: str, points: str, k: str) -> DataFrame:
    """Points minus those of the player ``k`` places below (the last one past the end), 0 at least."""
    ranked = stored(running_total(df, keys, [F.desc(points), F.col(player)]).withColumnRenamed("_upto", "_place"), "places")
    other = ranked.select(*keys, F.col("_place").alias("_at"), F.col(points).alias("_points"))
    joined = ranked.withColumn("_at", F.least(F.col("_all"), F.col("_place") + F.col(k))).join(other, [*keys, "_at"])
    return joined.withColumn("drop", F.greatest(F.lit(0.0), F.col(points) - F.col("_points"))).select(*df.columns, "drop")


def recent_share(picks: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Share of each position in the last ``n`` picks of each draft."""
    last = picks.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_place") <= n)
    counted = last.groupBy(*keys, "position").agg(F.count("*").alias("_n"))
    totals = last.groupBy(*keys).agg(F.count("*").alias("_all"))
    return counted.join(totals, list(keys)).select(*keys, "position", (F.col("_n") / F.col("_all")).alias("share"))


def run_pressure(picks: DataFrame, demand: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """How far each position's share of the last ``n`` picks is above its expected share, from 0 to 1.

    ``demand`` has position and the starters that the league needs; the expected share is its part
    of all. Drafts without picks have no rows; positions without recent picks have 0.
    """
    total = demand.agg(F.greatest(F.lit(1), F.sum("demand")).alias("_all"))
    expected = demand.crossJoin(F.broadcast(total)).select("position", (F.col("demand") / F.col("_all")).alias("expected"))  # one row on the right
    if demand.limit(MOST_POSITIONS + 1).count() > MOST_POSITIONS:
        raise QualityError("too many positions")
    drafts = picks.select(*keys).distinct().crossJoin(F.broadcast(expected))  # MOST_POSITIONS rows on the right
    joined = drafts.join(recent_share(picks, keys, order, n), [*keys, "position"], "left")
    excess = (F.coalesce("share", F.lit(0.0)) - F.col("expected")) / F.greatest(F.lit(0.05), F.col("expected"))
    return joined.select(*keys, "position", "expected", F.greatest(F.lit(0.0), F.least(F.lit(1.0), excess)).alias("pressure"))


def scope_deltas(rows: DataFrame, keys: Sequence[str], model: str, error: str, baseline: str) -> DataFrame:
    """Each model's error less the baseline's on the same key."""
    base = rows.filter(F.col(model) == baseline).select(*keys, F.col(error).alias("_base"))
    return rows.filter(F.col(model) != baseline).join(base, list(keys)).withColumn("delta", F.col(error) - F.col("_base")).drop("_base")


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in a total order, of each group where ``by`` is given."""
    if not by:
        return df.orderBy(*order).limit(n)
    # A limit on row_number lets every task drop the rest of a group before the shuffle.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side; empty where the sets are equal."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.subtract(right).withColumn("side", F.lit("extra")).unionByName(right.subtract(left).withColumn("side", F.lit("missing")))


def retained(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both sides have."""
    return a.select(*keys).intersect(b.select(*keys))


def unresolved_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def observed_universe(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """T4: union of the sources; of one id the row of the first source stays."""
    ranked = [df.withColumn("_source", F.lit(k)) for k, df in enumerate(sources)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df)
    columns = [c for c in sources[0].columns if c != key]
    return keep_best(out, [key], [F.col("_source"), *[F.col(c) for c in columns]]).drop("_source")
