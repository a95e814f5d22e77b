"""Forecast jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.functions.clean import depth_weight, lookup, normal_cdf, safe_ratio, score_band, snake_owner
from opportunity.functions.stored import stored
from opportunity.operators.aggregates import weighted_mean
from opportunity.operators.windows import TIE_DIGITS, average_rank_percentile, cume_percentile, drop_to_kth_next, keep_best, ordinal_percentile, rank_in, share_in_group
from opportunity.plans.draws import room_draws, with_bits
from opportunity.plans.ownership import checked_ownership, ownership_states  # noqa: F401  F23 in full
from opportunity.quality import QualityError, assert_rule
from opportunity.stats import laplace_mean, shrunk_rate_multiplier, wilson_bounds

#: Flex slots that a league may have.
MOST_FLEX = 50

RESOURCES = ("QB_DROPBACKS", "QB_RUSH_OPPORTUNITIES", "RB_CARRIES", "RB_TARGETS", "WR_TARGETS", "TE_TARGETS")
# Fixed values.
HISTORY_WEIGHT = {"QB_DROPBACKS": 0.0, "QB_RUSH_OPPORTUNITIES": 0.0, "RB_CARRIES": 0.45, "RB_TARGETS": 0.50, "WR_TARGETS": 0.55, "TE_TARGETS": 0.55}
INTERVAL_WIDTH = {"QB_DROPBACKS": 0.14, "QB_RUSH_OPPORTUNITIES": 0.20, "RB_CARRIES": 0.20, "RB_TARGETS": 0.18, "WR_TARGETS": 0.18, "TE_TARGETS": 0.19}


def _by_resource(values: dict[str, float], resource: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(resource == name, F.lit(value)).otherwise(out)
    return out


def caller_fingerprints(anchors: DataFrame, destination: DataFrame, league: DataFrame, caller_weight: float = 0.5, destination_weight: float = 0.3, decay: float = 0.75) -> DataFrame:
    """a caller's metrics as an age-weighted mean of anchor seasons, blended with team and league.

    ``anchors`` has team, metric, age and value; the others metric (and team) and value.
    """
    own = anchors.groupBy("team", "metric").agg(weighted_mean(F.col("value"), F.pow(F.lit(decay), F.col("age"))).alias("caller_value"), F.count("value").alias("anchors"))
    joined = destination.select("team", "metric", F.col("value").alias("team_value")).join(own, ["team", "metric"], "left").join(league.select("metric", F.col("value").alias("league_value")), "metric")
    rest = 1 - caller_weight - destination_weight
    blend = caller_weight * F.col("caller_value") + destination_weight * F.col("team_value") + rest * F.col("league_value")
    alone = (destination_weight * F.col("team_value") + rest * F.col("league_value")) / (destination_weight + rest)
    return joined.select("team", "metric", F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce(blend, alone).alias("forecast"))


# Weights of caller, destination and league by the caller's case.
CALLER_CASES = {
    "same": (0.65, 0.30, 0.05),
    "moved": (0.70, 0.20, 0.10),
    "staff_with_anchors": (0.40, 0.50, 0.10),
    "staff": (0.00, 0.80, 0.20),
    "anchors": (0.65, 0.20, 0.15),
    "new_high_continuity": (0.00, 0.80, 0.20),
    "new_half_continuity": (0.00, 0.60, 0.40),
    "new": (0.00, 0.35, 0.65),
}
# Fixed values.
CERTAINTY_LABELS = ((80, "high"), (65, "medium-high"), (50, "medium"), (35, "low-medium"))


def caller_cases(teams: DataFrame) -> DataFrame:
    """case, caller component and blend weights of each team.

    ``teams`` has same, moved, on_prior_staff, anchors (how many), episodes (whether there is any
    evidence) and destination_continuity (0-1).
    """
    anchored, near = F.col("anchors") > 0, F.col("destination_continuity")
    case = (
        F.when(F.col("same"), "same").when(F.col("moved"), "moved")
        .when(F.col("on_prior_staff") & anchored, "staff_with_anchors").when(F.col("on_prior_staff"), "staff").when(anchored, "anchors")
        .when(near >= 0.75, "new_high_continuity").when(near >= 0.50, "new_half_continuity").otherwise("new")
    )
    known = {"same": 1.0, "moved": 0.75, "staff_with_anchors": 0.65, "staff": 0.60, "anchors": 0.50}
    component = F.coalesce(lookup(known, F.col("case")), F.when(F.col("episodes"), 0.35).otherwise(0.15))
    weights = [lookup({c: w[k] for c, w in CALLER_CASES.items()}, F.col("case")).alias(n) for k, n in enumerate(("caller_weight", "destination_weight", "league_weight"))]
    return teams.withColumn("case", case).select("*", component.alias("caller_component"), *weights)


def caller_style_forecasts(teams: DataFrame, anchors: DataFrame, destination: DataFrame, specs: DataFrame, decay: float = 0.75) -> DataFrame:
    """F1 in full: forecast, stability and certainty of each team and metric.

    ``teams`` is what ``caller_cases`` takes, with identity (0-1), scheme_identity (0-1), staff (0-1) and
    head_coach_kept; ``anchors`` has team, season, metric, age and value; ``destination`` team, metric and
    value; ``specs`` metric, tolerance, low, high (null: no bound), and may have team signals in a
    table of their own, joined as column ``signal`` (null: none) by team and metric.
    """
    cases = caller_cases(teams)
    weight = F.pow(F.lit(decay), F.col("age"))
    own = anchors.join(specs.select("metric", "tolerance").distinct(), "metric").withColumn("_w", weight)
    means = own.groupBy("team", "metric").agg(weighted_mean(F.col("value"), F.col("_w")).alias("fingerprint"), F.count("value").alias("count"), F.first("tolerance").alias("_tolerance"))
    spread = own.join(means, ["team", "metric"]).groupBy("team", "metric").agg(weighted_mean(F.abs(F.col("value") - F.col("fingerprint")), F.col("_w")).alias("_mad"))
    stable = means.join(spread, ["team", "metric"]).withColumn("stability", F.when(F.col("count") == 0, 0.20).when(F.col("count") == 1, 0.45).otherwise(1 / (1 + F.col("_mad") / F.col("_tolerance")))).drop("_mad", "_tolerance")
    strength = anchors.select("team", "season", "age").distinct().groupBy("team").agg(F.least(F.lit(1.0), F.sum(weight) / 2.2).alias("anchor_strength"))
    overall = stable.filter("fingerprint is not null").groupBy("team").agg(F.avg("stability").alias("overall"))
    scored = cases.join(strength, "team", "left").join(overall, "team", "left").fillna({"anchor_strength": 0.0, "overall": 0.20})
    coach = F.col("head_coach_kept").cast("double")
    c = F.col
    broad = 100 * (0.20 * c("identity") + 0.45 * c("scheme_identity") + 0.15 * c("anchor_strength") + 0.10 * c("destination_continuity") + 0.05 * c("staff") + 0.05 * coach)
    exact = 100 * (0.10 * c("identity") + 0.15 * c("caller_component") + 0.18 * c("anchor_strength") + 0.12 * c("staff") + 0.08 * coach + 0.12 * c("overall") + 0.15 * c("destination_continuity") + 0.10 * c("scheme_identity"))
    scored = scored.select("team", "case", "caller_weight", "destination_weight", "league_weight", broad.alias("broad"), F.when(c("same"), exact).otherwise(F.least(exact, F.lit(79.0))).alias("exact"))
    league = destination.groupBy("metric").agg(F.median("value").alias("league"))
    joined = scored.join(destination.withColumnRenamed("value", "destination"), "team").join(stable, ["team", "metric"], "left").join(league, "metric").join(specs, ["team", "metric"] if "team" in specs.columns else ["metric"])
    parts = [(c("fingerprint"), c("caller_weight")), (c("destination"), c("destination_weight")), (c("league"), c("league_weight"))]
    mass = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    blend = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in parts), F.lit(0.0)) / mass
    signal = F.coalesce("signal", F.lit(0.0)) if "signal" in specs.columns else F.lit(0.0)
    moved = blend + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signal)) * c("tolerance") * 0.5
    value = F.least(F.coalesce("high", moved), F.greatest(F.coalesce("low", moved), moved))
    return joined.select(
        "team", "metric", "case", F.coalesce("count", F.lit(0)).alias("anchors"), F.coalesce("stability", F.lit(0.20)).alias("stability"), value.alias("forecast"), "broad", score_band(c("broad"), CERTAINTY_LABELS, "low").alias("broad_label"),
        "exact", score_band(c("exact"), CERTAINTY_LABELS, "low").alias("exact_label"), (0.70 * c("exact") + 30 * F.coalesce("stability", F.lit(0.20))).alias("certainty"),
    )


# Features of each position's outlook.
OUTLOOK_WEIGHTS = {
    "QB": {"pass_plays": 0.55, "neutral_pass": 0.20, "air_yards": 0.15, "play_action": 0.10},
    "RB": {"rush_plays": 0.55, "rb_share": 0.35, "plays": 0.10},
    "WR": {"pass_plays": 0.50, "wr_share": 0.35, "air_yards": 0.15},
    "TE": {"pass_plays": 0.40, "te_share": 0.60},
}


def position_outlook(forecasts: DataFrame, weights: dict[str, dict[str, float]] = OUTLOOK_WEIGHTS) -> DataFrame:
    """F2 in full: score, label, drivers and league rank of each team and position.

    ``forecasts`` has team, metric and forecast (F1). Metrics are pivoted, plays are parted by the pass
    rate, each feature gets its percentile over the teams, and the two features that move the score
    most are the drivers.
    """
    names = ["plays_per_game", "pass_rate", "neutral_early_down_pass_rate", "play_action_rate", "mean_air_yards", "rb_target_share", "wr_target_share", "te_target_share"]
    wide = forecasts.filter(F.col("metric").isin(*names)).groupBy("team").pivot("metric", names).agg(F.first("forecast"))
    plays, rate = F.col("plays_per_game"), F.col("pass_rate")
    features = {
        "plays": plays, "pass_plays": plays * rate, "rush_plays": plays * (1 - rate), "neutral_pass": F.col("neutral_early_down_pass_rate"), "play_action": F.col("play_action_rate"),
        "air_yards": F.col("mean_air_yards"), "rb_share": F.col("rb_target_share"), "wr_share": F.col("wr_target_share"), "te_share": F.col("te_target_share"),
    }
    long = wide.select("team", *[v.alias(n) for n, v in features.items()]).unpivot("team", list(features), "feature", "value")
    ranked = average_rank_percentile(long, ["feature"], "value")
    table = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(f).alias("feature"), F.lit(w).alias("weight")) for p, own in weights.items() for f, w in own.items()])
    rows = ranked.withColumn("d", F.explode(F.filter(table, lambda d: d["feature"] == F.col("feature")))).select("team", "feature", "percentile", "d.position", "d.weight")
    driver = F.struct((-F.abs(F.col("percentile") - 0.5) * F.col("weight")).alias("pull"), F.concat(F.col("feature"), F.when(F.col("percentile") >= 0.5, ":high").otherwise(":low")).alias("name"))
    out = rows.groupBy("team", "position").agg((100 * F.sum(F.col("weight") * F.col("percentile"))).alias("score"), F.array_sort(F.collect_list(driver)).alias("_d"))
    score = F.col("score")
    label = F.when(score >= 80, "strongly_favorable_opportunity").when(score >= 65, "favorable_opportunity").when(score > 35, "neutral_opportunity").when(score > 20, "unfavorable_opportunity").otherwise("strongly_unfavorable_opportunity")
    named = out.select("team", "position", "score", label.alias("label"), F.array_join(F.transform(F.slice("_d", 1, 2), lambda d: d["name"]), "|").alias("drivers"))
    return rank_in(named, ["position"], [F.desc(F.round("score", 1)), F.col("team")], "league_rank")


def position_environments(metrics: DataFrame, features: dict[str, float]) -> DataFrame:
    """weighted mean of feature percentiles per team, with rank; ``metrics`` has team and the features."""
    scored = metrics
    total = F.lit(0.0)
    for name, weight in features.items():
        ranked = average_rank_percentile(metrics.select("team", name).withColumn("_g", F.lit(1)), ["_g"], name)
        scored = scored.join(ranked.select("team", F.col("percentile").alias(f"{name}_percentile")), "team")
        total = total + weight * F.coalesce(F.col(f"{name}_percentile"), F.lit(0.5))
    scored = scored.withColumn("score", 100 * total / sum(features.values()))
    return rank_in(scored, [], [F.desc("score"), F.col("team")])


def resource_forecasts(style: DataFrame, factors: DataFrame, by: str | None = None) -> DataFrame:
    """six pools per team and game, long.

    ``style`` has team, plays_per_game, pass_rate, qb_scramble_rate, designed_qb_run_share and the
    three target shares; ``factors`` one row, or one for each value of ``by``. Shares that sum above 1 are scaled to 1; above 1.05
    the row is invalid and its pools are null.
    """
    joined = style.join(factors, by) if by else style.crossJoin(F.broadcast(factors))  # one row on the right
    total = F.col("rb_target_share") + F.col("wr_target_share") + F.col("te_target_share")
    scale = F.when(total > 1.05, F.lit(None).cast("double")).when(total > 1, total).otherwise(1.0)
    passes, rushes = F.col("plays_per_game") * F.col("pass_rate"), F.col("plays_per_game") * (1 - F.col("pass_rate"))
    targets = passes * F.col("target_per_pass_play")
    pools = {
        "QB_DROPBACKS": passes * F.col("qb_dropbacks_per_pass_play"),
        "QB_RUSH_OPPORTUNITIES": passes * F.col("qb_scramble_rate") + rushes * F.col("designed_qb_run_share"),
        "RB_CARRIES": rushes * (1 - F.col("designed_qb_run_share")) * F.col("rb_carries_per_non_qb_rush_play"),
        "RB_TARGETS": targets * F.col("rb_target_share") / scale,
        "WR_TARGETS": targets * F.col("wr_target_share") / scale,
        "TE_TARGETS": targets * F.col("te_target_share") / scale,
    }
    return joined.select("team", *[v.alias(k) for k, v in pools.items()]).unpivot("team", list(pools), "resource", "pool")


def checked_resources(style: DataFrame, factors: DataFrame) -> DataFrame:
    """F4 with its error: target shares that sum above 1.05."""
    assert_rule(style, F.col("rb_target_share") + F.col("wr_target_share") + F.col("te_target_share") <= 1.05, "target shares sum above 1.05")
    return resource_forecasts(style, factors)


def role_priors(rooms: DataFrame, history: DataFrame, pools: DataFrame) -> DataFrame:
    """shares of each room from depth and history, with a band, pool share and evidence.

    ``rooms`` has team, resource, position, player_id and depth_rank; ``history`` player_id, team,
    share, weighted_games and same_team; ``pools`` team, resource and pool.
    """
    room = ["team", "resource"]
    rows = rooms.withColumn("depth", depth_weight(F.col("position"), F.col("depth_rank"))).join(history, ["player_id", "team"], "left")
    rows = share_in_group(rows.withColumn("hist", F.coalesce("share", F.lit(0.0))).drop("share"), room, "depth").withColumnRenamed("share", "depth_prior")
    rows = share_in_group(rows, room, "hist").withColumn("hist_share", F.coalesce("share", "depth_prior")).drop("share")
    games = F.col("weighted_games")
    trust = F.least(F.lit(0.80), games / (games + F.when(F.col("position") == "QB", 6.0).otherwise(8.0)))
    trust = F.coalesce(trust * F.when(F.col("same_team"), 1.0).otherwise(0.45), F.lit(0.0))
    rows = rows.withColumn("reliability", trust).withColumn("_h", _by_resource(HISTORY_WEIGHT, F.col("resource")))
    signal = F.col("reliability") * F.col("hist_share") + (1 - F.col("reliability")) * F.col("depth_prior")
    rows = share_in_group(rows.withColumn("raw", F.col("_h") * signal + (1 - F.col("_h")) * F.col("depth_prior")), room, "raw")
    evidence = F.least(F.lit(95.0), 30 + 40 * F.col("reliability") + F.when(F.col("depth_rank").isNotNull(), 20).otherwise(0) + F.when(F.coalesce(F.col("same_team"), F.lit(False)), 10).otherwise(0))
    rows = rows.withColumn("evidence", evidence).join(pools, room)
    width = _by_resource(INTERVAL_WIDTH, F.col("resource")) * (1.25 - F.col("evidence") / 100)
    return rows.select(
        *room, "position", "player_id", "share", F.greatest(F.lit(0.0), F.col("share") - width).alias("share_low"), F.least(F.lit(1.0), F.col("share") + width).alias("share_high"),
        (F.col("share") * F.col("pool")).alias("opportunities"), "evidence", score_band(F.col("evidence")).alias("evidence_label"),
    )


def latent_roles(active: DataFrame, everyone: DataFrame, room: Sequence[str]) -> DataFrame:
    """actives keep their active share of the active mass, the others their own share; sums to 1.

    ``active`` has the room, player_id and active_share; ``everyone`` the room, player_id and share.
    """
    rows = everyone.join(active, [*room, "player_id"], "left")
    mass = rows.groupBy(*room).agg(F.sum(F.when(F.col("active_share").isNotNull(), F.col("share"))).alias("_mass"))
    weight = F.when(F.col("active_share").isNotNull(), F.col("active_share") * F.col("_mass")).otherwise(F.col("share"))
    return rows.join(mass, list(room)).withColumn("latent", weight).drop("_mass")


def weekly_availability(rows: DataFrame, z: float = 1.645) -> DataFrame:
    """F8: availability of what ``cohort_fallback`` returns; byes and weeks that must be missed are 0.

    ``rows`` has trials, successes, bye and min_missed (or null) beside week.
    """
    low, high = wilson_bounds(F.col("successes"), F.col("trials"), z)
    out = F.col("bye") | F.coalesce(F.col("week") <= F.col("min_missed"), F.lit(False))
    zero = lambda c: F.when(out, 0.0).otherwise(c)
    return rows.withColumn("p_low", zero(low)).withColumn("p_mean", zero(laplace_mean(F.col("successes"), F.col("trials")))).withColumn("p_high", zero(high))


def availability_inputs(players: DataFrame, weeks: Sequence[int], schedule: DataFrame, minimums: DataFrame) -> DataFrame:
    """F8: each player (player_id, team, family, position) with each week, whether the team has a bye, and the games missed at least.

    ``schedule`` has team and week; ``minimums`` player_id and min_missed. What ``cohort_fallback`` then
    takes has family and position.
    """
    each = players.withColumn("week", F.explode(F.array(*[F.lit(w) for w in weeks])))
    games = schedule.select("team", "week", F.lit(True).alias("_game")).distinct()
    joined = each.join(games, ["team", "week"], "left").join(minimums.select("player_id", "min_missed"), "player_id", "left")
    return joined.withColumn("bye", F.col("_game").isNull()).drop("_game")


def availability_support(rows: DataFrame, strong: int = 150, moderate: int = 30) -> DataFrame:
    """F8: what supports a probability, and why it is 0 where a rule says so."""
    missed = F.coalesce(F.col("week") <= F.col("min_missed"), F.lit(False))
    reason = F.when(missed & F.col("bye"), "rule_minimum_and_bye").when(missed, "rule_minimum_absence").when(F.col("bye"), "scheduled_bye").otherwise("")
    return rows.withColumn("support", F.when(F.col("trials") >= strong, "strong").when(F.col("trials") >= moderate, "moderate").otherwise("weak")).withColumn("constraint", reason)


def role_scenarios(roles: DataFrame, availability: DataFrame, draws: int = 5000, seed: int = 0) -> DataFrame:
    """active draws per player and week, and shares among the active, summed over draws.

    ``roles`` has team, resource, player_id and weight; ``availability`` team, week, player_id and
    p. An empty room leaves the draw unallocated, as a row of ``__UNALLOCATED__``. Draws are bit strings
    (see ``draws``), written to the work folder while the plan is built.
    """
    live = with_bits(availability.select("team", "week", "player_id", "p"), draws, seed)
    found, filled = room_draws(live.join(roles.select("team", "resource", "player_id", "weight"), ["team", "player_id"]), draws)
    out = found.filter("active_draws > 0").select("team", "week", "resource", F.col("player_id").cast("string").alias("player_id"), "mean_share", "active_draws")
    rooms = availability.select("team", "week").distinct().join(roles.select("team", "resource").distinct(), "team")
    return out.unionByName(_unallocated(rooms, filled, draws).select("team", "week", "resource", "player_id", "mean_share", F.col("_empty").cast("long").alias("active_draws")))


def _unallocated(rooms: DataFrame, filled: DataFrame, draws: int) -> DataFrame:
    """Rooms with draws in which no one of them is active."""
    empty = rooms.join(filled, ["team", "week", "resource"], "left").withColumn("_empty", draws - F.coalesce("filled", F.lit(0))).filter("_empty > 0")
    return empty.withColumn("player_id", F.lit("__UNALLOCATED__")).withColumn("mean_share", F.col("_empty") / draws)


def scenario_shares(roles: DataFrame, availability: DataFrame, draws: int = 5000, seed: int = 0) -> DataFrame:
    """F9 with percentiles: mean, p10, p50 and p90 of every candidate's share over all draws.

    Tables as in ``role_scenarios``; ``availability`` may have scheduled. A draw without the player
    counts as 0. A week without a game gives shares of 0 and leaves nothing unallocated.
    """
    if "scheduled" not in availability.columns:
        availability = availability.withColumn("scheduled", F.lit(True))
    key, measures = ["team", "week", "resource"], ["mean_share", "p10", "p50", "p90"]
    live = with_bits(availability.select("team", "week", "player_id", "p", "scheduled"), draws, seed).join(roles, ["team", "player_id"])
    found, filled = room_draws(live.filter("scheduled").select(*key, "player_id", "weight", "bits"), draws)
    name = F.col("player_id").cast("string").alias("player_id")
    idle = availability.filter("not coalesce(scheduled, false)").select("team", "week", "player_id").join(roles, ["team", "player_id"])
    out = found.select(*key, name, *measures).unionByName(idle.select(*key, name, *[F.lit(0.0).alias(m) for m in measures]))
    rooms = availability.filter("scheduled").select("team", "week", "player_id").join(roles, ["team", "player_id"]).select(*key).distinct()
    none = _unallocated(rooms, filled, draws).select(*key, "player_id", "mean_share", *[F.lit(None).cast("double").alias(p) for p in ("p10", "p50", "p90")])
    return out.unionByName(none)


def scenario_opportunities(shares: DataFrame, pools: DataFrame) -> DataFrame:
    """expected opportunities and their percentiles, of what ``scenario_shares`` returns and the pools per game (team, resource, pool)."""
    joined = shares.join(pools, ["team", "resource"])
    names = {"mean_share": "expected", "p10": "opportunities_p10", "p50": "opportunities_p50", "p90": "opportunities_p90"}
    return joined.select(*shares.columns, *[(F.col("pool") * F.col(share)).alias(name) for share, name in names.items()])


def high_value_priors(roles: DataFrame, events: DataFrame, season: int, lookback: int = 3, priors: Sequence[int] = (12, 24, 48), primary: int = 24) -> DataFrame:
    """latent role shares times E8 multipliers at each prior strength, scaled to 1 in each room.

    ``roles`` has metric, team, player_id, weight and active; ``events`` metric, player_id, season,
    team, high and base. ``active_share`` is the primary share among the active.
    """
    key = ["metric", "team", "player_id"]
    # The keys of E8 hold the metric, and the role's team, as a player may have roles in several.
    own = events.join(roles.select("metric", "player_id", F.col("team").alias("_role")), ["metric", "player_id"])
    team, player = F.struct("team", "metric"), F.struct("metric", F.col("_role").alias("team"), "player_id")
    history = own.select(player.alias("player_id"), "season", team.alias("team"), "high", "base")
    teams = events.groupBy("season", team.alias("team")).agg(F.sum("high").alias("team_high"), F.sum("base").alias("team_base"))
    targets = roles.withColumn("_role", F.col("team")).select(player.alias("player_id"), F.lit(season).alias("target_season"), team.alias("team"))
    found = shrunk_rate_multiplier(history, teams, targets, lookback, priors)
    found = found.select("player_id.*", "high", "base", *[f"p{p}" for p in priors])
    out = roles.join(found, key, "left").fillna(0, ["high", "base"]).fillna(1.0, [f"p{p}" for p in priors])
    masses = {"base_share": F.col("weight"), **{f"share_p{p}": F.col("weight") * F.col(f"p{p}") for p in priors}}
    masses["active_share"] = F.when(F.col("active"), masses[f"share_p{primary}"])
    totals = out.groupBy("metric", "team").agg(*[F.sum(mass).alias(f"_{name}") for name, mass in masses.items()])
    out = out.join(totals, ["metric", "team"]).withColumns({name: safe_ratio(mass, F.when(F.col(f"_{name}") != 0, F.col(f"_{name}"))) for name, mass in masses.items()}).drop(*totals.columns[2:])
    main = F.col(f"share_p{primary}")
    shares = [F.col(f"share_p{p}") for p in priors]
    support = F.when(F.col("base") <= 0, "none").when(F.col("base") < 24, "limited").when(F.col("base") < 48, "moderate").otherwise("strong")
    return out.withColumn("share_low", F.least(*shares)).withColumn("share_high", F.greatest(*shares)).withColumn("delta", main - F.col("base_share")).withColumn("history_support", support)


def high_value_reviews(priors: DataFrame, primary: int = 24, material: float = 0.05, large: float = 0.10) -> DataFrame:
    """metric, team, player_id and issue of what needs a look; a room without active players has no player_id."""
    much = F.col("base_share") >= material
    issue = F.array(
        F.when((F.col("base") <= 0) & much, "role_without_history"),
        F.when((F.col("base") > 0) & (F.col("base") < primary) & much, "role_with_limited_history"),
        F.when(F.abs("delta") >= large, "large_adjustment"),
    )
    players = priors.select("metric", "team", "player_id", F.explode(F.array_compact(issue)).alias("issue"))
    rooms = priors.groupBy("metric", "team").agg(F.coalesce(F.bool_or("active"), F.lit(False)).alias("_any")).filter("not _any")
    return players.unionByName(rooms.select("metric", "team", F.lit(None).cast(priors.schema["player_id"].dataType).alias("player_id"), F.lit("no_active_candidate").alias("issue")))


def high_value_scenarios(priors: DataFrame, availability: DataFrame, draws: int, seed: int, primary: int = 24) -> DataFrame:
    """``scenario_shares`` of the primary shares, with the metric in place of the resource."""
    roles = priors.select("team", F.col("metric").alias("resource"), "player_id", F.col(f"share_p{primary}").alias("weight"))
    return scenario_shares(roles, availability, draws, seed).withColumnRenamed("resource", "metric")


def event_pools(pools: DataFrame, rates: DataFrame, pool_radius: float, rate_radius: float) -> DataFrame:
    """expected events of a pool at a rate, with the envelope of both radii."""
    joined = pools.join(rates, "team")
    low = F.greatest(F.lit(0.0), F.col("pool") - pool_radius) * F.greatest(F.lit(0.0), F.col("rate") - rate_radius)
    high = (F.col("pool") + pool_radius) * F.least(F.lit(1.0), F.col("rate") + rate_radius)
    return joined.withColumn("events", F.col("pool") * F.col("rate")).withColumn("events_low", low).withColumn("events_high", high)


def raw_rate_reviews(rates: DataFrame, multiple: float = 1.0) -> DataFrame:
    """teams whose raw rate is ``multiple`` radii or more off the selected one; ``rates`` has team, metric, base, raw_rate, rate and radius."""
    off = (F.col("base") > 0) & (F.abs(F.col("raw_rate") - F.col("rate")) >= multiple * F.col("radius"))
    return rates.filter(off).select("team", "metric", "raw_rate", "rate", "radius", F.lit("raw_team_history_outside_rate_calibration_radius").alias("issue"))


def weekly_event_counts(shares: DataFrame, pools: DataFrame, totals: DataFrame) -> DataFrame:
    """F13 in full: season events of each player with low and high, over weeks with a game.

    ``shares`` has team, metric, week, player_id, share, share_low, share_high and scheduled; ``pools``
    team, metric, events, events_low and events_high a game; ``totals`` team, metric, week and share_sum,
    to which the shares of a week are scaled. A bye gives 0.
    """
    key = ["team", "metric", "week"]
    scaled = share_in_group(shares.withColumnRenamed("share", "_s"), key, "_s").join(totals, key)
    joined = scaled.join(pools, ["team", "metric"])
    ratio = safe_ratio(F.col("share") * F.col("share_sum"), F.col("_s"))
    plays = lambda value: F.when(F.col("scheduled"), value).otherwise(0.0)
    values = {"events": F.col("events") * F.coalesce(F.col("share"), F.lit(0.0)) * F.col("share_sum"), "low": F.col("events_low") * F.coalesce(F.col("share_low") * ratio, F.lit(0.0)), "high": F.col("events_high") * F.coalesce(F.col("share_high") * ratio, F.lit(0.0))}
    return joined.groupBy("team", "metric", "player_id").agg(*[F.sum(plays(v)).alias(f"season_{n}") for n, v in values.items()])


def active_event_counts(priors: DataFrame, pools: DataFrame, priors_used: Sequence[int] = (12, 24, 48), primary: int = 24) -> DataFrame:
    """events a game of each player if those now active play: shares at each prior among the active, and the pool's envelope.

    ``priors`` is what ``high_value_priors`` returns; ``pools`` has team, metric, events, events_low and
    events_high. Others have 0.
    """
    active = lambda p: F.when(F.col("active"), F.col(f"share_p{p}"))
    totals = priors.groupBy("team", "metric").agg(*[F.sum(active(p)).alias(f"_t{p}") for p in priors_used])
    rows = priors.join(totals, ["team", "metric"]).join(pools, ["team", "metric"])
    shares = {p: F.coalesce(safe_ratio(active(p), F.when(F.col(f"_t{p}") > 0, F.col(f"_t{p}"))), F.lit(0.0)) for p in priors_used}
    low, high = F.least(*shares.values()), F.greatest(*shares.values())
    return rows.select("team", "metric", "player_id", *[v.alias(f"active_p{p}") for p, v in shares.items()], (F.col("events_low") * low).alias("low"), (F.col("events") * shares[primary]).alias("events"), (F.col("events_high") * high).alias("high"))


def player_event_counts(shares: DataFrame, pools: DataFrame) -> DataFrame:
    """weekly events per player: the pool by share, scaled to the room's sum; season sums."""
    scaled = share_in_group(shares.withColumnRenamed("share", "_s"), ["team", "week"], "_s")
    return scaled.join(pools, "team").withColumn("expected", F.col("events") * F.coalesce("share", F.lit(0.0))).groupBy("team", "player_id").agg(F.sum("expected").alias("season_events"))


def season_watchlist(trends: DataFrame, owners: DataFrame, rows: int | None = None) -> DataFrame:
    """score of each player and its lead over the weakest own player of the position.

    ``trends`` has player_id, position, late, trend and unavailable; ``owners`` league_id,
    player_id, and mine. Percentiles are of players with a late game; the others score 0. ``rows`` is how
    many free players of a position each league is offered, all if None.
    """
    seen = trends.filter("not unavailable")
    level = cume_percentile(seen, ["position"], "late").select("player_id", F.col("percentile").alias("level"))
    slope = cume_percentile(seen, ["position"], "trend").select("player_id", F.col("percentile").alias("slope"))
    scored = trends.join(level, "player_id", "left").join(slope, "player_id", "left").withColumn("score", F.coalesce(0.7 * F.col("level") + 0.3 * F.col("slope"), F.lit(0.0)))
    own = owners.filter("mine").join(scored.select("player_id", "position", "score", "unavailable"), "player_id")
    weakest = own.groupBy("league_id", "position").agg(F.min(F.struct("unavailable", "score"))["score"].alias("base"))
    board = league_shortlist(scored.select("player_id", "position", "score"), owners, rows).join(weakest, ["league_id", "position"], "left")
    return board.select("league_id", "player_id", "position", "score", (F.col("score") - F.coalesce("base", F.lit(0.0))).alias("delta"), "list")


def league_shortlist(scored: DataFrame, owners: DataFrame, rows: int | None = None) -> DataFrame:
    """each league's free players (list ``waiver``), the ``rows`` best of each position, and all that others own (``trade``).

    ``scored`` has player_id, position and score; ``owners`` league_id, player_id and mine. Players are ranked
    once for each position, for all leagues; a league reads the ranks up to ``rows`` and as many more as it
    owns of the position, less those owned, so its rows grow with what is asked for. Without ``rows`` all
    ranks are asked for. Ranks are written to the work folder while the plan is built.
    """
    ranked = stored(rank_in(scored, ["position"], [F.desc("score"), F.col("player_id")], "_place"), "position-ranks")
    names = [c for c in ranked.columns if c != "_place"]
    held = owners.select("league_id", "player_id", "mine").join(ranked, "player_id")
    sizes = ranked.groupBy("position").agg(F.max("_place").alias("_all")).agg(F.collect_list(F.struct("position", "_all")).alias("_sizes"))
    counts = held.groupBy("league_id", "position").agg(F.count("*").alias("_held"))
    # Every league asks for every position: few, so they are one row.
    asked = owners.select("league_id").distinct().crossJoin(F.broadcast(sizes)).select("league_id", F.inline("_sizes")).join(counts, ["league_id", "position"], "left")
    upto = F.col("_all") if rows is None else F.least(F.col("_all"), F.lit(rows) + F.coalesce("_held", F.lit(0)))
    ranks = asked.select("league_id", "position", F.explode(F.sequence(F.lit(1).cast("long"), upto)).alias("_place"))
    free = ranks.join(ranked, ["position", "_place"]).join(held.select("league_id", "player_id"), ["league_id", "player_id"], "left_anti")
    if rows is not None:
        place = F.row_number().over(Window.partitionBy("league_id", "position").orderBy("_place"))
        free = free.withColumn("_n", place).filter(F.col("_n") <= rows)
    waiver = free.select("league_id", *names, F.lit("waiver").alias("list"))
    return waiver.unionByName(held.filter("not mine").select("league_id", *names, F.lit("trade").alias("list")))



def market_board(board: DataFrame, weight: float = 6.0) -> DataFrame:
    """base score by draft position plus a capped adjustment by opportunity percentile, and ranks.

    ``board`` has player_id, position, adp and opportunity.
    """
    placed = ordinal_percentile(board, ["position"], [F.col("opportunity"), F.col("player_id")])
    base = 100 - 0.35 * (F.col("adp") - 1)
    score = base + F.least(F.lit(weight), F.greatest(F.lit(-weight), (F.col("percentile") - 50) / 50 * weight))
    ranked = rank_in(placed.withColumn("score", score), ["position"], [F.desc("score"), F.col("player_id")], "position_rank")
    return ranked


def replacement_levels(players: DataFrame, teams: int, starters: dict[str, int], flex: Sequence[tuple[Sequence[str], int]]) -> DataFrame:
    """F16: starters of each position in a league, and the points of the last one.

    A flex slot takes the best of those that are left, of its positions; equal points go to the
    later position by name. So each slot is a ranking, and the loop is over the few slots.
    """
    want = F.lit(0)
    for position, count in starters.items():
        want = F.when(F.col("position") == position, teams * count).otherwise(want)
    rows = rank_in(players, ["position"], [F.desc("points"), F.col("player_id")], "_place").withColumn("_used", F.col("_place") <= want)
    for eligible, count in flex:
        free = rows.filter(~F.col("_used") & F.col("position").isin(*eligible))
        best = free.orderBy(F.desc("points"), F.desc("position"), "_place").limit(teams * count).select("player_id", F.lit(True).alias("_taken"))
        rows = rows.join(best, "player_id", "left").withColumn("_used", F.col("_used") | F.coalesce("_taken", F.lit(False))).drop("_taken")
    used = rows.filter("_used").groupBy("position").agg(F.count("*").alias("demand"), F.min("points").alias("replacement"))
    return players.select("position").distinct().join(used, "position", "left").select("position", F.coalesce("demand", F.lit(0)).alias("demand"), F.coalesce("replacement", F.lit(0.0)).alias("replacement"))


def league_replacement_levels(players: DataFrame, slots: DataFrame, flex: DataFrame) -> DataFrame:
    """F16 for many leagues: league_id, position, demand and replacement, as ``draft_scores`` takes them.

    ``players`` has league_id, player_id, position and points; ``slots`` league_id, position and starters (of
    all teams together); ``flex`` league_id, slot (their order), eligible (positions) and picks (of all
    teams together). A flex slot takes the best that are left of its positions, equal points the later
    position by name. Fixed starters count as demand even where players are fewer; without players or
    demand the level is 0. Ranks by league and position are written to the work folder while the plan is built.
    """
    spots = slots.groupBy("league_id", "position").agg(F.sum("starters").alias("_want"))
    extra = flex.groupBy("league_id").agg(F.sum("picks").alias("_extra"))
    rows = rank_in(players.select("league_id", "player_id", "position", "points"), ["league_id", "position"], [F.desc("points"), F.col("player_id")], "_place")
    rows = stored(rows.join(spots, ["league_id", "position"], "left").join(extra, "league_id", "left").fillna(0, ["_want", "_extra"]), "league-ranks")
    # Whoever stands behind all fixed and flex picks of his league is never taken: what is left is as small as the league.
    near = rows.filter(F.col("_place") <= F.col("_want") + F.col("_extra")).withColumn("_taken", F.col("_place") <= F.col("_want"))
    order = sorted(r[0] for r in flex.select("slot").distinct().limit(MOST_FLEX + 1).collect())
    if len(order) > MOST_FLEX:
        raise QualityError(f"more than {MOST_FLEX} flex slots")
    for slot in order:
        own = flex.filter(F.col("slot") == slot).select("league_id", F.col("eligible").alias("_eligible"), F.col("picks").alias("_picks"))
        near = near.join(own, "league_id", "left")
        free = ~F.col("_taken") & F.coalesce(F.array_contains("_eligible", F.col("position")), F.lit(False))
        place = F.row_number().over(Window.partitionBy("league_id", free).orderBy(F.desc("points"), F.desc("position"), "_place"))
        near = near.withColumn("_taken", F.col("_taken") | (free & (place <= F.col("_picks")))).drop("_eligible", "_picks")
    filled = near.groupBy("league_id", "position").agg(F.sum(F.when(F.col("_taken") & (F.col("_place") > F.col("_want")), 1).otherwise(0)).alias("_flex"))
    counts = rows.groupBy("league_id", "position").agg(F.count("*").alias("_n"))
    both = spots.join(counts, ["league_id", "position"], "full_outer").join(filled, ["league_id", "position"], "left").fillna(0, ["_want", "_n", "_flex"])
    both = both.select("league_id", "position", (F.col("_want") + F.col("_flex")).cast("long").alias("demand"), "_n")
    last = near.select("league_id", "position", F.col("_place").alias("_last"), F.col("points").alias("_points"))
    out = both.withColumn("_last", F.least("demand", "_n")).join(last, ["league_id", "position", "_last"], "left")
    return out.select("league_id", "position", "demand", F.coalesce("_points", F.lit(0.0)).alias("replacement"))


def draft_recommendations(players: DataFrame, levels: DataFrame, picks_until_next: int) -> DataFrame:
    """points over replacement and scarcity of each available player, and the rank of their sum."""
    total = levels.agg(F.greatest(F.lit(1), F.sum("demand")).alias("_demand"))
    share = levels.crossJoin(F.broadcast(total)).withColumn("k", F.greatest(F.lit(1), F.ceil(picks_until_next * F.col("demand") / F.col("_demand"))))
    joined = players.join(share.select("position", "replacement", "k"), "position")
    scored = drop_to_kth_next(joined, ["position"], "player_id", "points", "k").withColumnRenamed("drop", "scarcity")
    scored = scored.withColumn("vorp", F.col("points") - F.col("replacement")).withColumn("score", F.col("vorp") + 0.5 * F.col("scarcity"))
    return scored.select("player_id", "position", "vorp", "scarcity", "score")


def survival_estimates(board: DataFrame, target: Column) -> DataFrame:
    """chance that a player is left at a pick: a normal bounded by the observed range, shrunk by sample size.

    ``board`` has adp, stdev, high, low and drafts.
    """
    deviation = F.greatest(F.lit(1.0), F.col("stdev"))
    top = F.greatest(F.lit(1.0), F.least("high", "low"))
    bottom = F.greatest(top, F.greatest("high", "low"))
    z = lambda pick: normal_cdf((pick - F.col("adp")) / deviation)
    at, lower, upper = z(target - 0.5), z(top - 0.5), z(bottom + 0.5)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (upper - at) / F.greatest(F.lit(1e-6), upper - lower)))
    trust = F.col("drafts") / (F.col("drafts") + 50)
    return board.withColumn("survival", F.least(F.lit(0.995), F.greatest(F.lit(0.005), trust * bounded + (1 - trust) * (1 - at))))


def opponent_demand(drafts: DataFrame, weights: DataFrame, teams: int) -> DataFrame:
    """mean demand of the owners who pick before one's next turn, over the league's mean, clipped.

    ``drafts`` has draft_id, current and next; ``weights`` draft_id, owner and demand.
    """
    between = drafts.filter(F.col("next") > F.col("current") + 1).withColumn("pick", F.explode(F.sequence(F.col("current") + 1, F.col("next") - 1)))
    between = between.withColumn("owner", snake_owner(F.col("pick"), F.lit(teams))).join(weights, ["draft_id", "owner"])
    league = weights.groupBy("draft_id").agg(F.avg("demand").alias("_mean"))
    out = between.groupBy("draft_id").agg(F.avg("demand").alias("_own"), F.count("*").alias("picks")).join(league, "draft_id")
    return out.select("draft_id", "picks", F.least(F.lit(1.90), F.greatest(F.lit(0.45), safe_ratio(F.col("_own"), F.col("_mean")))).alias("pressure"))


def tier_cliffs(board: DataFrame) -> DataFrame:
    """players left in each tier and the drop to the best of the next one; ``board`` has position, tier and points."""
    tiers = board.groupBy("position", "tier").agg(F.count("*").alias("remaining"), F.max("points").alias("best"), F.min("points").alias("last"))
    following = F.lead("best").over(Window.partitionBy("position").orderBy("tier"))
    return tiers.withColumn("drop", F.col("last") - following)


def coaching_census(registry: DataFrame, staff: DataFrame) -> DataFrame:
    """head coaches, coordinators and whether the caller is on the staff, per team; ``valid`` if one, one and yes."""
    counts = staff.groupBy("team").agg(F.sum(F.when(F.col("title") == "head_coach", 1).otherwise(0)).alias("heads"), F.sum(F.when(F.col("title") == "coordinator", 1).otherwise(0)).alias("coordinators"))
    present = staff.select("team", F.col("person").alias("caller"), F.lit(True).alias("on_staff")).distinct()
    joined = registry.join(counts, "team", "left").join(present, ["team", "caller"], "left").withColumn("on_staff", F.coalesce("on_staff", F.lit(False)))
    return joined.withColumn("valid", F.coalesce((F.col("heads") == 1) & (F.col("coordinators") == 1) & F.col("on_staff"), F.lit(False)))


def checked_census(registry: DataFrame, staff: DataFrame) -> DataFrame:
    """F22 in full: the caller's titles of each team; any team that breaks a rule is an error.

    ``registry`` has team, head_coach, coordinator, caller and confirmation; ``staff`` team, person,
    side and title. A team has one head coach and one offensive coordinator, whose names are the
    registry's, and its caller is on the staff and not unresolved.
    """
    people = staff.groupBy("team").agg(
        F.sort_array(F.collect_set(F.when(F.col("side") == "head_coach", F.col("person")))).alias("heads"),
        F.sort_array(F.collect_set(F.when((F.col("side") == "offense") & F.lower("title").rlike("offens(?:iv)?e coordinator"), F.col("person")))).alias("coordinators"),
    )
    titles = staff.groupBy("team", F.col("person").alias("caller")).agg(F.array_join(F.sort_array(F.collect_set("title")), " | ").alias("caller_title"))
    joined = registry.join(people, "team", "full_outer").join(titles, ["team", "caller"], "left")
    one = lambda names, name: (F.size(names) == 1) & (F.get(names, F.lit(0)) == F.col(name))
    rules = {"head coach": one("heads", "head_coach"), "coordinator": one("coordinators", "coordinator"), "caller on staff": F.col("caller_title").isNotNull(), "caller": F.col("confirmation") != "unresolved"}
    for name, rule in rules.items():
        assert_rule(joined, rule, f"a team breaks the rule: {name}")
    return joined.select("team", "head_coach", "coordinator", "caller", "caller_title", "confirmation")


def ownership_replay(transactions: DataFrame) -> DataFrame:
    """current owner of each player of each league.

    ``transactions`` has league_id, seq, kind (add, drop or undo), player_id and owner. An undo
    takes back the last change that still stands: the changes are brackets, and a change stands
    if, from it on, undos never outnumber changes.
    """
    signed = transactions.withColumn("_step", F.when(F.col("kind") == "undo", -1).otherwise(1))
    later = Window.partitionBy("league_id").orderBy("seq")
    signed = signed.withColumn("_level", F.sum("_step").over(later.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.min("_level").over(later.rowsBetween(1, Window.unboundedFollowing))
    kept = signed.filter("kind <> 'undo'").join(signed.select("league_id", "seq", lowest.alias("_lowest")), ["league_id", "seq"])
    kept = kept.filter(F.col("_lowest").isNull() | (F.col("_lowest") >= F.col("_level")))
    last = keep_best(kept.select("league_id", "player_id", "seq", "kind", "owner"), ["league_id", "player_id"], [-F.col("seq")])
    return last.filter("kind = 'add'").select("league_id", "player_id", "owner")


def availability_queue(roster: DataFrame, depth: DataFrame, market: DataFrame, games: DataFrame, affiliated: Sequence[str]) -> DataFrame:
    """affiliated players who are not active and have depth, market or history evidence.

    ``roster`` has player_id, team, position and status; ``depth`` player_id, team, position and
    depth_rank; ``market`` player_id and adp; ``games`` player_id and games. ``queue_rank`` puts the
    earliest market position first and those without one last.
    """
    rows = roster.filter(F.col("status").isin(*affiliated) & (F.col("status") != "ACT"))
    rows = rows.join(depth, ["player_id", "team", "position"], "left").join(market, "player_id", "left").join(games, "player_id", "left")
    kept = rows.filter(F.col("depth_rank").isNotNull() | F.col("adp").isNotNull() | (F.col("games") > 0))
    return rank_in(kept, ["team"], [F.asc_nulls_last("adp"), F.col("player_id")], "queue_rank")


def personal_score(position: Column, modeled: Column, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """what one's own weights (0-200 by position and metric, 100 is neutral) add for metrics of 0-100; 0 for a player who is not modelled."""
    out = F.lit(0.0)
    for name, own in weights.items():
        moved = sum(((F.col(m) - 50) / 50 * ((w - 100) / 100) * 2 for m, w in own.items()), F.lit(0.0))
        out = F.when(position == name, moved).otherwise(out)
    return F.when(F.coalesce(modeled, F.lit(False)), out).otherwise(0.0)


def live_board(board: DataFrame) -> DataFrame:
    """draft score with personal weights, need, scarcity, urgency, opponent demand, position run and penalties.

    ``board`` has draft_id, player_id, position, draft_score, status (of ``lineup_status``), round,
    drop (to the player likely to be left), survival (0-100), pressure, run (recent picks of the
    position) and over (players of the position beyond its slots). It may have personal (``personal_score``)
    and same_bye (own players of the position with the same bye, if that counts yet).
    """
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("round") - 1) / 12))
    need = F.when(F.col("status") == "starter", 0.45 + progress * 1.2).when(F.col("status") == "flex", 0.25 + progress * 0.65).otherwise(0.0)
    scarcity = F.least(F.lit(2.4), F.col("drop") * 0.55)
    urgency = F.greatest(F.lit(-1.4), F.least(F.lit(1.4), (50 - F.col("survival")) / 50 * 1.4))
    opponent = F.greatest(F.lit(-0.8), F.least(F.lit(0.8), (F.col("pressure") - 1) * 0.9))
    run = F.least(F.lit(1.28), F.col("run") * 0.16)
    early = F.when(F.col("position").isin("K", "DST") & (F.col("round") < 12), (12 - F.col("round")) * 0.65).otherwise(0.0)
    bench = F.when(F.col("status") == "bench", F.greatest(F.lit(1), F.col("over") + 1) * 0.8).otherwise(0.0)
    more = F.col("personal") if "personal" in board.columns else F.lit(0.0)
    bye = F.col("same_bye") * 0.5 if "same_bye" in board.columns else F.lit(0.0)
    scored = board.withColumn("total", F.col("draft_score") + more + need + scarcity + urgency + opponent + run - early - bench - bye)
    return rank_in(scored, ["draft_id"], [F.desc(F.round("total", TIE_DIGITS)), F.col("player_id")])
