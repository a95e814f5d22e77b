"""Backtests: forecasts from strictly earlier seasons against what followed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opportunity.functions.clean import depth_weight
from opportunity.functions.stored import stored
from opportunity.operators.aggregates import evaluation_summary, pool_by_window, unpivoted
from opportunity.operators.joins import forecast_vs_actual
from opportunity.operators.windows import TIE_DIGITS, scope_deltas, share_in_group
from opportunity.plans.forecast import HISTORY_WEIGHT, _by_resource
from opportunity.quality import QualityError
from opportunity.resampling import MOST_EXACT, paired_cluster_bootstrap
from opportunity.stats import conformal_radius, holdout_coverage, oracle_allocation, room_errors, shrunk_team_rate, two_stage_gate

WINDOWS = (4, 8, 18)


def role_weights(rooms: DataFrame, history: DataFrame) -> DataFrame:
    """Weights of the models depth, prior and blend, long.

    ``rooms`` has season, team, resource, position, player_id and depth_rank; ``history`` season
    (the target), team, resource, player_id, share, weighted_games and same_team.
    """
    room = ["season", "team", "resource"]
    rows = rooms.join(history, [*room, "player_id"], "left").withColumn("_past", F.coalesce("share", F.lit(0.0))).drop("share")
    rows = share_in_group(rows.withColumn("_depth", depth_weight(F.col("position"), F.col("depth_rank"))), room, "_depth").withColumnRenamed("share", "depth")
    rows = share_in_group(rows, room, "_past").withColumn("prior", F.coalesce("share", "depth")).drop("share")
    games = F.col("weighted_games")
    trust = F.least(F.lit(0.80), games / (games + F.when(F.col("position") == "QB", 6.0).otherwise(8.0))) * F.when(F.col("same_team"), 1.0).otherwise(0.45)
    trust, weight = F.coalesce(trust, F.lit(0.0)), _by_resource(HISTORY_WEIGHT, F.col("resource"))
    rows = rows.withColumn("blend", weight * (trust * F.col("prior") + (1 - trust) * F.col("depth")) + (1 - weight) * F.col("depth"))
    return rows.unpivot([*room, "player_id"], ["depth", "prior", "blend"], "model", "weight")


def allocation_backtest(weights: DataFrame, active: DataFrame, actual: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """E15 (and E16, with a metric as the resource): errors of each room, model and window when weekly pools are known and shared by weight.

    ``weights`` has season, team, resource, player_id, model and weight; ``active`` season, team,
    week and player_id; ``actual`` season, team, resource, week, player_id and amount. Weekly pools
    are allocated once; windows are sums of weeks.
    """
    room = ["season", "team", "resource"]
    models = weights.select(*room, "model").distinct()
    pools = actual.groupBy(*room, "week").agg(F.sum("amount").alias("pool")).filter("pool > 0")
    key = [*room, "model"]
    allocated = oracle_allocation(weights, active, pools.join(models, room), key, active_by=["season", "team"])
    ahead = pool_by_window(allocated, [*key, "player_id"], ["allocated"], windows)
    seen = pool_by_window(actual.withColumn("player_id", F.col("player_id").cast("string")), [*room, "player_id"], ["amount"], windows).join(models, room)
    totals = pool_by_window(pools, room, ["pool"], windows)
    by = [*key, "window_end"]
    share = lambda df, value, name: df.join(totals, [*room, "window_end"]).filter("pool > 0").select(*by, "player_id", (F.col(value) / F.col("pool")).alias(name))
    return room_errors(forecast_vs_actual(share(ahead, "allocated", "forecast"), share(seen, "amount", "actual"), [*by, "player_id"]), by)


def allocation_comparisons(rooms: DataFrame, baseline: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """E3 of each model's total variation less the baseline's in the same room and window, by resource (and ALL), window and model, clustered by team."""
    room = ["season", "team", "resource", "window_end"]
    # Errors are sums, whose last bits depend on the order of rows: equal ones must stay equal.
    deltas = scope_deltas(rooms.select(*room, "model", F.round("total_variation", TIE_DIGITS).alias("total_variation")), room, "model", "total_variation", baseline)
    deltas = deltas.withColumn("_in", F.explode(F.array(F.lit("ALL"), F.col("resource").cast("string"))))
    return paired_cluster_bootstrap(deltas.withColumn("scope", F.concat_ws("|", "_in", F.col("window_end").cast("string"), "model")), "scope", "team", "delta", samples=samples, seed=seed)


def rate_backtest(values: DataFrame, targets: Sequence[int], lookback: int = 3, priors: Sequence[int] = (4, 17), decay: float = 0.65, windows: Sequence[int] = WINDOWS, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast and actual rate per game of each target season, team, window and model.

    ``values`` has season, week, team, amount and games, and the ``keys`` (a resource, or a metric whose
    games are base opportunities). The loop is over the few target seasons; each forecast reads earlier
    seasons only. A team that is new takes the league rate. ``values`` are written to the work folder while the
    plan is built, as each target reads them three times.
    """
    parts, unit, values = [], [*keys, "team"], stored(values, "rate-values")
    for target in targets:
        asked = values.filter(F.col("season") == target).select(*unit).distinct()
        rates = shrunk_team_rate(values.groupBy("season", *unit).agg(F.sum("amount").alias("amount"), F.sum("games").alias("games")), target, lookback, priors, decay, keys, asked)
        ahead = unpivoted(rates, unit, ["league", "raw", *[f"p{p}" for p in priors]]).withColumnsRenamed({"metric": "model", "value": "forecast"})
        seen = pool_by_window(values.filter(F.col("season") == target), unit, ["amount", "games"], windows)
        seen = seen.filter("games > 0").select(*unit, "window_end", (F.col("amount") / F.col("games")).alias("actual"))
        parts.append(ahead.join(seen, unit).withColumn("target_season", F.lit(target)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("error", F.abs(F.col("forecast") - F.col("actual")))


def rate_summary(rows: DataFrame) -> DataFrame:
    """Errors by season and over all, against the league rate."""
    return evaluation_summary(rows, F.array(F.lit("ALL"), F.col("target_season").cast("string")), "league")


def holdout_calibration(rows: DataFrame, holdout: int, model: str, coverage: float = 0.90) -> DataFrame:
    """Radius from the development seasons, and its coverage of the holdout season, by window."""
    own = rows.filter(F.col("model") == model)
    radius = conformal_radius(own.filter(F.col("target_season") < holdout), ["window_end"], "error", coverage)
    return holdout_coverage(own.filter(F.col("target_season") == holdout), radius, ["window_end"]).join(radius.select("window_end", "radius"), "window_end")


# Weights of caller's anchor, team and league by cohort.
CALLER_BLENDS = {"returning": (0.0, 0.95, 0.05), "changed_with_anchor": (0.70, 0.20, 0.10), "changed_without_anchor": (0.0, 0.60, 0.40)}


def transition_backtest(prior: DataFrame, actual: DataFrame, cohorts: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Three style forecasts of each team and metric against what followed.

    ``prior`` has team, metric and value of the season before; ``actual`` team, window_end, metric
    and value; ``cohorts`` is what ``caller_cohort`` returns; ``tolerances`` metric and tolerance.
    Ambiguous callers have no caller-aware forecast and are left out.
    """
    league = prior.groupBy("metric").agg(F.median("value").alias("league"))
    own = prior.select("team", "metric", F.col("value").alias("persistence"))
    anchor = prior.select(F.col("team").alias("anchor_team"), "metric", F.col("value").alias("anchor"))
    rows = own.join(league, "metric").join(cohorts.filter(F.col("cohort").isin(*CALLER_BLENDS)).select("team", "cohort", "anchor_team"), "team").join(anchor, ["anchor_team", "metric"], "left")
    aware = F.lit(None).cast("double")
    for cohort, (a, d, l) in CALLER_BLENDS.items():
        blend = d * F.col("persistence") + l * F.col("league")
        aware = F.when(F.col("cohort") == cohort, blend + a * F.col("anchor") if a else blend).otherwise(aware)
    rows = rows.withColumn("shrunken", 0.8 * F.col("persistence") + 0.2 * F.col("league")).withColumn("caller_aware", aware)
    long = rows.unpivot(["team", "metric", "cohort"], ["persistence", "shrunken", "caller_aware"], "model", "forecast")
    found = long.join(actual.withColumnRenamed("value", "actual"), ["team", "metric"]).join(tolerances, "metric")
    return found.filter("forecast is not null and actual is not null").withColumn("error", F.abs(F.col("forecast") - F.col("actual")) / F.col("tolerance"))


def paired_team_effects(rows: DataFrame, candidate: str = "caller_aware", baseline: str = "shrunken") -> DataFrame:
    """Mean error of the candidate less the baseline's, per team and window, over the metrics both have."""
    by = ["team", "window_end", "metric"]
    wide = rows.filter(F.col("model").isin(candidate, baseline)).groupBy(*by).agg(F.max(F.when(F.col("model") == candidate, F.col("error"))).alias("_c"), F.max(F.when(F.col("model") == baseline, F.col("error"))).alias("_b"))
    return wide.filter("_c is not null and _b is not null").groupBy("team", "window_end").agg(F.avg(F.col("_c") - F.col("_b")).alias("paired_delta"), F.count("*").alias("metrics"))


def rate_comparisons(rows: DataFrame, baseline: str = "league", samples: int = 2000, seed: int = 0) -> DataFrame:
    """E3 of each model's error less the league rate's on the same season, team and window, clustered by team."""
    key = ["target_season", "team", "window_end"]
    deltas = scope_deltas(rows.select(*key, "model", "error"), key, "model", "error", baseline)
    found = paired_cluster_bootstrap(deltas.withColumn("scope", F.concat_ws("|", F.col("window_end").cast("string"), "model")), "scope", "team", "delta", samples=samples, seed=seed)
    parts = F.split("scope", r"\|")
    return found.withColumn("window_end", parts[0].cast("int")).withColumn("challenger", parts[1]).drop("scope")


def segmented(rows: DataFrame, holdout: int, key: str) -> DataFrame:
    """A rate backtest's rows by metric (``key``, and ALL) and segment: seasons before the holdout, and the holdout."""
    segment = F.when(F.col("target_season") == holdout, "holdout").when(F.col("target_season") < holdout, "development")
    return rows.withColumn("segment", segment).filter("segment is not null").withColumn("metric", F.explode(F.array(F.lit("ALL"), F.col(key).cast("string"))))


def segment_comparisons(rows: DataFrame, holdout: int, key: str, baseline: str = "league", samples: int = 2000, seed: int = 0) -> DataFrame:
    """E3 of each model's error less the baseline's by metric, segment and window, clustered by season and team."""
    unit = ["target_season", "team", key, "window_end"]
    deltas = segmented(scope_deltas(rows.select(*unit, "model", "error"), unit, "model", "error", baseline), holdout, key)
    cluster = F.concat_ws("|", F.col("target_season").cast("string"), F.col("team").cast("string"))
    deltas = deltas.withColumn("cluster", cluster).withColumn("scope", F.concat_ws("|", "metric", "segment", F.col("window_end").cast("string"), "model"))
    found = paired_cluster_bootstrap(deltas, "scope", "cluster", "delta", samples=samples, seed=seed)
    parts = F.split("scope", r"\|")
    return found.select(parts[0].alias("metric"), parts[1].alias("segment"), parts[2].cast("int").alias("window_end"), parts[3].alias("challenger"), *found.columns[1:])


def segment_evaluations(rows: DataFrame, holdout: int, key: str) -> DataFrame:
    """Mean error of each metric, segment, window and model, as ``two_stage_gate`` takes it."""
    own = segmented(rows, holdout, key).filter("metric <> 'ALL'")
    return own.groupBy("metric", "segment", "window_end", "model").agg(F.avg("error").alias("error"))


def rate_decision(rows: DataFrame, comparisons: DataFrame, holdout: int, key: str, baseline: str = "league", windows: Sequence[int] = WINDOWS, min_wins: int = 2) -> DataFrame:
    """E13 in two stages for each metric: the model that development rows choose, and whether the holdout season promotes it.

    ``comparisons`` is what ``segment_comparisons`` returns. The metric ALL is compared but not decided.
    """
    return two_stage_gate(segment_evaluations(rows, holdout, key), comparisons.filter("metric <> 'ALL'"), baseline, windows, min_wins)


def selected_calibration(rows: DataFrame, decision: DataFrame, holdout: int, key: str, window: int = WINDOWS[-1], coverage: float = 0.90) -> DataFrame:
    """The radius of each metric's selected model over development rows of one window, and how often the holdout lies within it.

    Intervals end at 0 below, so their width can be less than two radii.
    """
    own = segmented(rows, holdout, key).filter((F.col("metric") != "ALL") & (F.col("window_end") == window))
    own = own.join(decision.select("metric", F.col("selected").alias("model")), ["metric", "model"])
    radius = conformal_radius(own.filter("segment = 'development'"), ["metric", "model"], "error", coverage)
    low, high = F.greatest(F.lit(0.0), F.col("forecast") - F.col("radius")), F.col("forecast") + F.col("radius")
    held = own.filter("segment = 'holdout'").join(radius.withColumnRenamed("n", "development_rows"), ["metric", "model"])
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    out = held.groupBy("metric", "model", "development_rows", "radius").agg(F.count("*").alias("rows"), count(F.col("actual") < low).alias("below"), count(F.col("actual") > high).alias("above"), F.avg(high - low).alias("mean_width"))
    return out.withColumn("rate", (F.col("rows") - F.col("below") - F.col("above")) / F.col("rows"))


def season_scopes(rows: DataFrame, season: str = "season") -> DataFrame:
    """``rows`` in each scope that they count in: pooled, every leave-one-season-out scope but their own, and their season alone.

    The seasons of a set of backtests are few; more than 100 are an error.
    """
    seasons = sorted(r[0] for r in rows.select(season).distinct().limit(101).collect())
    if len(seasons) > 100:
        raise QualityError("too many seasons")
    out = [F.when(F.col(season) != s, F.lit(f"without_{s}")) for s in seasons]
    scopes = F.array_compact(F.array(F.lit("pooled"), F.concat(F.lit("season_"), F.col(season).cast("string")), *out))
    return rows.withColumn("scope", F.explode(scopes))


def transition_evaluation(rows: DataFrame, holdout: int, candidate: str = "caller_aware", baseline: str = "shrunken", samples: int = 2000, seed: int = 0, exact_to: int = MOST_EXACT, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Paired effects by scope and window with their interval, and the holdout's coverage.

    ``rows`` is what E18 returns for several seasons, with season. Effects of a team over seasons are
    drawn together; with up to ``exact_to`` teams all resamples are listed (E4), else drawn (E3). Radii
    are of the seasons before the holdout, by window and metric, in units of the metric's tolerance.
    """
    key = ["season", "team", "window_end", "metric"]
    deltas = scope_deltas(rows.filter(F.col("model").isin(candidate, baseline)).select(*key, "model", "error"), key, "model", "error", baseline)
    team = deltas.groupBy("season", "team", "window_end").agg(F.avg("delta").alias("delta"))
    scoped = season_scopes(team).withColumn("scope", F.concat_ws("|", "scope", F.col("window_end").cast("string")))
    effects = paired_cluster_bootstrap(scoped, "scope", "team", "delta", samples=samples, seed=seed, exact_to=exact_to, level=level, pooled=True)
    own = rows.filter(F.col("model") == candidate)
    radius = conformal_radius(own.filter(F.col("season") < holdout), ["window_end", "metric"], "error")
    held = own.filter(F.col("season") == holdout).join(radius, ["window_end", "metric"]).withColumn("covered", F.col("error") <= F.col("radius"))
    return effects, held.groupBy("window_end").agg(F.count("*").alias("rows"), F.avg(F.col("covered").cast("double")).alias("rate"), F.avg(2 * F.col("radius")).alias("mean_width"))


def transition_decision(effects: DataFrame, holdout: int, min_seasons: int = 3, digits: int = 6) -> DataFrame:
    """Whether the candidate is promoted, one row with a column for each rule.

    Every season's mean effect must be below 0 in every window, and so must the whole interval of the
    pooled seasons and of the holdout season; ``min_seasons`` are asked for. That every
    leave-one-season-out interval, and that without the holdout, lies below 0 is told beside it. Effects
    are compared as rounded to ``digits``.
    """
    scope = F.element_at(F.split("scope", r"\|"), 1)
    rows = effects.select(scope.alias("s"), F.round("mean_delta", digits).alias("mean"), F.round("high", digits).alias("high"))
    single, held = F.col("s").startswith("season_"), F.col("s") == f"season_{holdout}"
    every = lambda which, rule: F.coalesce(F.every(F.when(which, rule)), F.lit(False))
    out = rows.agg(
        F.countDistinct(F.when(single, F.col("s"))).alias("seasons"), every(single, F.col("mean") < 0).alias("every_season_improves"), every(F.col("s") == "pooled", F.col("high") < 0).alias("pooled_below_zero"),
        every(held, F.col("high") < 0).alias("holdout_below_zero"), every(F.col("s").startswith("without_"), F.col("high") < 0).alias("leave_one_out_below_zero"), every(F.col("s") == f"without_{holdout}", F.col("high") < 0).alias("development_below_zero"),
    )
    return out.withColumn("promoted", (F.col("seasons") >= min_seasons) & F.col("every_season_improves") & F.col("pooled_below_zero") & F.col("holdout_below_zero"))
