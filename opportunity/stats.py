"""Statistics that judge forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opportunity.functions.clean import safe_ratio
from opportunity.operators.aggregates import leave_one_out
from opportunity.operators.joins import prior_history
from opportunity.operators.ranges import counted_values
from opportunity.operators.windows import TIE_DIGITS
from opportunity.quality import QualityError
from opportunity.resampling import bootstrap_spearman, paired_cluster_bootstrap  # noqa: F401  E3, E4 and E11 are statistics too



def room_errors(rows: DataFrame, room: Sequence[str]) -> DataFrame:
    """Total variation, mean error, top hit and coverage of each room.

    ``rows`` is what ``forecast_vs_actual`` returns, with a player_id.
    """
    gap = F.abs(F.col("forecast") - F.col("actual"))
    # Shares are sums, whose last bits depend on the order of rows: equal ones must stay equal.
    top = lambda share: F.min_by("player_id", F.struct(-F.round(share, TIE_DIGITS), F.col("player_id")))
    out = rows.groupBy(*room).agg(
        (F.sum(gap) / 2).alias("total_variation"),
        F.avg(gap).alias("mean_error"),
        top("forecast").alias("_f"),
        top("actual").alias("_a"),
        F.sum(F.when(F.col("row_type") == "opening", F.col("actual")).otherwise(0.0)).alias("coverage"),
    )
    return out.withColumn("top_hit", F.col("_f") == F.col("_a")).drop("_f", "_a")


def oracle_allocation(weights: DataFrame, active: DataFrame, pools: DataFrame, room: Sequence[str], active_by: Sequence[str] | None = None) -> DataFrame:
    """Each week's pool shared by weight among the players active that week.

    ``weights`` has the room, player_id and weight; ``active`` the room (or ``active_by`` of it),
    week and player_id; ``pools`` the room, week and pool. A pool without an active player goes to
    ``__UNALLOCATED__``.
    """
    key = [*room, "week"]
    live = active.join(weights, [*(room if active_by is None else active_by), "player_id"])
    totals = live.groupBy(*key).agg(F.sum("weight").alias("_total")).filter("_total > 0")
    shared = live.join(totals, key).join(pools, key).select(*room, "week", "player_id", (F.col("pool") * F.col("weight") / F.col("_total")).alias("allocated"))
    left = pools.join(totals, key, "left_anti").select(*room, "week", F.lit("__UNALLOCATED__").alias("player_id"), F.col("pool").alias("allocated"))
    return shared.withColumn("player_id", F.col("player_id").cast("string")).unionByName(left)


def wilson_bounds(successes: Column, trials: Column, z: float = 1.645) -> tuple[Column, Column]:
    """E5: score interval of a share, within 0 and 1."""
    p, z2 = successes / trials, z * z
    scale = 1 + z2 / trials
    centre = (p + z2 / (2 * trials)) / scale
    margin = z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / scale
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def laplace_mean(successes: Column, trials: Column) -> Column:
    """E5: share with one success and one failure added."""
    return (successes + 1) / (trials + 2)


def conformal_radius(errors: DataFrame, keys: Sequence[str], error: str, coverage: float = 0.90) -> DataFrame:
    """The error at rank min(n, ceil((n + 1) * coverage)) of each key."""
    ranked = counted_values(errors, keys, error).withColumnRenamed("_all", "n")
    want = F.least(F.col("n"), F.ceil((F.col("n") + 1) * coverage))
    return ranked.filter(F.col("_upto") >= want).groupBy(*keys).agg(F.min(error).alias("radius"), F.first("n").alias("n"))


def holdout_coverage(rows: DataFrame, radius: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holdout rows (forecast, actual) within the radius of their key, below and above it."""
    joined = rows.join(radius.select(*keys, "radius"), list(keys))
    below, above = F.col("actual") < F.col("forecast") - F.col("radius"), F.col("actual") > F.col("forecast") + F.col("radius")
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    out = joined.groupBy(*keys).agg(F.count("*").alias("rows"), count(~below & ~above).alias("covered"), count(below).alias("below"), count(above).alias("above"), F.avg(2 * F.col("radius")).alias("mean_width"))
    return out.withColumn("rate", F.col("covered") / F.col("rows"))


def shrunk_rate_multiplier(events: DataFrame, teams: DataFrame, targets: DataFrame, lookback: int, priors: Sequence[int] = (12, 24, 48), moved: float = 0.45, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """A player's rate of high-value events against his teams', shrunk by prior opportunities.

    ``events`` has player_id, season, team, high and base; ``teams`` season, team, team_high and
    team_base; ``targets`` player_id, target_season and team.
    """
    weighted = prior_history(targets, events.join(teams, ["season", "team"]), lookback)
    w = F.col("weight")
    totals = weighted.groupBy("player_id", "target_season", "target_team").agg(
        *[F.sum(w * F.col(c)).alias(c) for c in ("high", "base", "team_high", "team_base")],
        F.max(F.when(F.col("base") > 0, F.struct("season", "team")))["season"].alias("_latest"),
    )
    seen = weighted.filter("base > 0").select("player_id", "target_season", "season", F.col("team").alias("target_team"), F.lit(True).alias("_same")).distinct()
    joined = totals.join(seen.withColumnRenamed("season", "_latest"), ["player_id", "target_season", "_latest", "target_team"], "left")
    rate = safe_ratio(F.col("team_high"), F.col("team_base"))
    out = joined
    for prior in priors:
        raw = (F.col("high") + prior * rate) / (F.col("base") + prior) / rate
        pulled = F.when(F.col("_same"), raw).otherwise(1 + moved * (raw - 1))
        usable = (F.col("base") > 0) & (rate > 0)
        out = out.withColumn(f"p{prior}", F.when(usable, F.least(F.lit(high), F.greatest(F.lit(low), pulled))).otherwise(1.0))
    return out.select("player_id", "target_season", "high", "base", *[f"p{p}" for p in priors])


def shrunk_team_rate(values: DataFrame, target: int, lookback: int, priors: Sequence[int], decay: float, keys: Sequence[str] = (), teams: DataFrame | None = None) -> DataFrame:
    """League rate, raw team rate and shrunk team rates from strictly earlier seasons.

    ``values`` has season, team, amount and games, and the ``keys`` (such as a resource) that have a
    league rate of their own. ``teams`` (keys and team) are those asked for, all with a past if None; one
    without a past takes the league rate.
    """
    past = values.filter(F.col("season").between(target - lookback, target - 1)).withColumn("_w", F.pow(F.lit(decay), F.lit(target - 1) - F.col("season")))
    team = past.groupBy(*keys, "team").agg(F.sum(F.col("_w") * F.col("amount")).alias("x"), F.sum(F.col("_w") * F.col("games")).alias("n"))
    if teams is not None:
        team = teams.join(team, [*keys, "team"], "left").fillna(0, ["x", "n"])
    league = past.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("amount")) / F.sum(F.col("_w") * F.col("games"))).alias("league"))
    joined = team.join(league, list(keys)) if keys else team.crossJoin(F.broadcast(league))  # one row on the right
    raw = F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.col("league"))
    shrunk = [F.when(F.col("n") > 0, (F.col("x") + p * F.col("league")) / (F.col("n") + p)).otherwise(F.col("league")).alias(f"p{p}") for p in priors]
    return joined.select(*keys, "team", "league", raw.alias("raw"), *shrunk)


def brier_scores(rows: DataFrame, segment: Sequence[str], models: Sequence[str], outcome: str) -> DataFrame:
    """Mean squared error of each model's probability, and of the first less the second."""
    square = {m: F.pow(F.col(m) - F.col(outcome), F.lit(2.0)) for m in models}
    out = [F.avg(s).alias(f"{m}_brier") for m, s in square.items()]
    delta = square[models[0]] - square[models[1]]
    return rows.groupBy(*segment).agg(F.count("*").alias("n"), *out, F.avg(delta).alias("delta"), (F.stddev_samp(delta) / F.sqrt(F.count("*"))).alias("delta_se"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for name in (x, y):
        ranks = counted_values(both, keys, name).select(*keys, name, (F.col("_upto") - (F.col("_equal") - 1) / 2).alias(f"_{name}_rank"))
        both = both.join(ranks, [*keys, name])
    return both.groupBy(*keys).agg(F.corr(f"_{x}_rank", f"_{y}_rank").alias("spearman"), F.count("*").alias("n"))


def tier_radii(rows: DataFrame, keys: Sequence[str], error: str, coverage: float = 0.90) -> DataFrame:
    """The radius (E6) of each tier of the keys, and of all tiers (tier ``global``)."""
    every = rows.withColumn("tier", F.explode(F.array(F.col("tier"), F.lit("global"))))
    return conformal_radius(every, [*keys, "tier"], error, coverage)


def leave_one_out_brier(counts: DataFrame, outcomes: DataFrame, keys: Sequence[str], segment: Sequence[str], cluster: str, z: float = 1.645) -> DataFrame:
    """Squared errors of a cohort and a coarse probability, both from all other seasons, per segment.

    ``counts`` has season, the keys, trials and successes; ``outcomes`` season, the keys, the segment,
    the cluster and active (0 or 1). The coarse model pools the last key. The interval of the paired
    difference is normal over cluster means.
    """
    def chance(own: Sequence[str], name: str) -> DataFrame:
        pooled = counts.groupBy("season", *own).agg(F.sum("trials").alias("trials"), F.sum("successes").alias("successes"))
        rest = leave_one_out(pooled, own, "season", ["trials", "successes"])
        return rest.select("season", *own, laplace_mean(F.col("successes"), F.col("trials")).alias(name))

    rows = outcomes.join(chance(keys, "cohort"), ["season", *keys]).join(chance(keys[:-1], "coarse"), ["season", *keys[:-1]])
    square = {m: F.pow(F.col(m) - F.col("active"), F.lit(2.0)) for m in ("cohort", "coarse")}
    rows = rows.select(*segment, cluster, *[s.alias(m) for m, s in square.items()])
    means = rows.groupBy(*segment, cluster).agg(F.count("*").alias("_n"), *[F.sum(m).alias(f"_{m}") for m in square], F.avg(F.col("cohort") - F.col("coarse")).alias("_d"))
    out = means.groupBy(*segment).agg(
        F.sum("_n").alias("n"), F.count("*").alias("clusters"), *[(F.sum(f"_{m}") / F.sum("_n")).alias(f"{m}_brier") for m in square], F.avg("_d").alias("delta"), (F.stddev_samp("_d") / F.sqrt(F.count("*"))).alias("_se")
    )
    return out.withColumn("low", F.col("delta") - z * F.col("_se")).withColumn("high", F.col("delta") + z * F.col("_se")).drop("_se")


def tertiles(df: DataFrame, development: Column, score: str) -> DataFrame:
    """Tier of each row by cut points from the development rows alone."""
    cuts = df.filter(development).agg(F.percentile(score, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cuts"))
    tier = F.when(F.col(score) <= F.get("_cuts", F.lit(0)), "low").when(F.col(score) <= F.get("_cuts", F.lit(1)), "middle").otherwise("high")
    return df.crossJoin(F.broadcast(cuts)).withColumn("tier", tier).drop("_cuts")  # one row on the right


def promotion_gate(evaluations: DataFrame, comparisons: DataFrame, baseline: str, primary: str, windows: Sequence[int], min_events: int, min_rooms: int) -> DataFrame:
    """Whether a metric's challengers beat the baseline in every way asked.

    ``evaluations`` has metric, window_end, model, error, events and rooms; ``comparisons`` metric,
    window_end, challenger, low and high. Errors are sums, whose last bits depend on the order of rows:
    what differs by less than the digits of ties is equal, and the best of equal models is the first by name.
    """
    rounded = lambda value: F.round(value, TIE_DIGITS)
    means = evaluations.groupBy("metric", "model").agg(F.avg("error").alias("mean"), F.countDistinct("window_end").alias("windows"))
    base = means.filter(F.col("model") == baseline).select("metric", F.col("mean").alias("base"))
    deltas = means.join(base, "metric").groupBy("metric").agg(
        F.max(F.when(F.col("model") != baseline, F.col("mean") - F.col("base"))).alias("worst_delta"),
        F.min("windows").alias("windows"),
        F.collect_list(F.when(F.col("model") != baseline, F.struct("model", "mean"))).alias("_rivals"),  # a row for each model
    )
    least = F.array_min(F.transform("_rivals", lambda r: r["mean"]))
    best = F.filter("_rivals", lambda r: r["mean"] <= least + 10.0**-TIE_DIGITS)
    deltas = deltas.select("metric", "worst_delta", "windows", F.array_min(F.transform(best, lambda r: r["model"])).alias("best_model"))
    last = evaluations.filter((F.col("model") == baseline) & (F.col("window_end") == max(windows))).select("metric", "events", "rooms")
    own = comparisons.filter(F.col("challenger") == primary).groupBy("metric").agg(F.sum(F.when(rounded("high") < 0, 1).otherwise(0)).alias("wins"), F.sum(F.when(rounded("low") > 0, 1).otherwise(0)).alias("losses"))
    joined = deltas.join(last, "metric", "left").join(own, "metric", "left")
    passed = (F.col("windows") == len(windows)) & (F.col("events") >= min_events) & (F.col("rooms") >= min_rooms) & (F.col("wins") >= 2) & (F.col("losses") == 0) & (rounded("worst_delta") < 0)
    return joined.select("metric", "worst_delta", "best_model", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"), F.coalesce(passed, F.lit(False)).alias("promoted"))


def two_stage_gate(evaluations: DataFrame, comparisons: DataFrame, baseline: str, windows: Sequence[int], min_wins: int = 2) -> DataFrame:
    """The challenger chosen on development rows, and whether the holdout lets it replace the baseline.

    ``evaluations`` has metric, segment (development or holdout), window_end, model and error;
    ``comparisons`` metric, segment, window_end, challenger, mean_delta, low and high. The candidate has
    the lowest mean error over the development windows, ties to the first name. It passes if it beats
    the baseline in every window of both segments, clearly in at least ``min_wins`` holdout windows, and
    clearly loses in none. A metric without rows of both segments is an error.
    """
    means = evaluations.groupBy("metric", "segment", "model").agg((F.sum("error") / len(windows)).alias("mean"))
    parts = means.groupBy("metric").agg(F.bool_or(F.col("segment") == "development").alias("_d"), F.bool_or(F.col("segment") == "holdout").alias("_h"))
    if lost := parts.filter(~(F.col("_d") & F.col("_h"))).select("metric").limit(1).collect():
        raise QualityError(f"no development or no holdout rows: {lost[0].metric}")
    at = lambda segment, model: F.max(F.when((F.col("segment") == segment) & (F.col("model") == model), F.col("mean")))
    rivals = F.when((F.col("segment") == "development") & (F.col("model") != baseline), F.struct("mean", "model"))
    chosen = means.groupBy("metric").agg(F.min(rivals).alias("_best"), at("development", baseline).alias("baseline_development"), at("holdout", baseline).alias("baseline_holdout"))
    chosen = chosen.select("metric", F.col("_best.model").alias("candidate"), F.col("_best.mean").alias("candidate_development"), "baseline_development", "baseline_holdout")
    held = means.filter("segment = 'holdout'").select("metric", F.col("model").alias("candidate"), F.col("mean").alias("candidate_holdout"))
    own = comparisons.withColumnRenamed("challenger", "candidate").join(chosen.select("metric", "candidate"), ["metric", "candidate"])
    holdout, count = F.col("segment") == "holdout", lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    rules = own.groupBy("metric").agg(
        count(~holdout & (F.col("mean_delta") < 0)).alias("development_wins"), count(holdout & (F.col("mean_delta") < 0)).alias("holdout_wins"),
        count(holdout & (F.col("high") < 0)).alias("clear_wins"), count(holdout & (F.col("low") > 0)).alias("clear_losses"),
    )
    out = chosen.join(held, ["metric", "candidate"], "left").join(rules, "metric", "left").fillna(0, ["development_wins", "holdout_wins", "clear_wins", "clear_losses"])
    n = len(windows)
    passed = (F.col("development_wins") == n) & (F.col("holdout_wins") == n) & (F.col("clear_wins") >= min_wins) & (F.col("clear_losses") == 0)
    return out.withColumn("passed", passed).withColumn("selected", F.when(passed, F.col("candidate")).otherwise(baseline))


def joint_coverage(rows: DataFrame, unit: str, covered: str) -> DataFrame:
    """Share of units with every row covered; one row."""
    units = rows.groupBy(unit).agg(F.every(covered).alias("_all"))
    return units.agg(F.count("*").alias("units"), F.avg(F.col("_all").cast("double")).alias("joint_rate"))
