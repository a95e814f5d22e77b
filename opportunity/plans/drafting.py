"""F15, F17, F18 and F20 with all their terms, and F14's scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opportunity.functions.clean import lookup
from opportunity.functions.stored import stored
from opportunity.operators.ranges import places_in
from opportunity.operators.windows import TIE_DIGITS, cume_percentile, drop_to_kth_next, ordinal_percentile, rank_in
from opportunity.plans.forecast import league_shortlist, survival_estimates

# Points a percentile point over 50 of each rating.
BOARD_WEIGHTS = {"opportunity": 0.08, "high_value": 0.04, "environment": 0.03, "evidence": 0.015}
# Last position rank of each tier.
TIER_CUTS = {"QB": (5, 12, 20), "RB": (12, 30, 50), "WR": (12, 30, 55), "TE": (5, 12, 20), "K": (8, 16, 24), "DST": (8, 16, 24)}
# Parts of the context signal by position, of the team and of the player, and the weight of both.
CONTEXT = {
    "WR": (
        {"pass_volume_rating": 0.30, "qb_play_rating": 0.27, "play_caller_rating": 0.18, "pace_rating": 0.10, "scoring_environment_rating": 0.10, "pass_blocking_rating": 0.05},
        {"opportunity_rating": 0.32, "high_value_usage_rating": 0.20, "efficiency_rating": 0.14, "competition_rating": 0.12, "role_security": 0.14, "upside_rating": 0.08},
        0.55,
    ),
    "RB": (
        {"rush_volume_rating": 0.30, "run_blocking_rating": 0.28, "positive_game_script_rating": 0.16, "scoring_environment_rating": 0.12, "play_caller_rating": 0.09, "pace_rating": 0.05},
        {"opportunity_rating": 0.33, "high_value_usage_rating": 0.20, "receiving_role_rating": 0.16, "competition_rating": 0.11, "role_security": 0.12, "efficiency_rating": 0.08},
        0.55,
    ),
    "QB": (
        {"play_caller_rating": 0.24, "pass_blocking_rating": 0.19, "pass_volume_rating": 0.18, "pace_rating": 0.14, "scoring_environment_rating": 0.14, "continuity_rating": 0.11},
        {"efficiency_rating": 0.25, "rushing_floor_rating": 0.22, "opportunity_rating": 0.18, "role_security": 0.15, "high_value_usage_rating": 0.10, "upside_rating": 0.10},
        0.52,
    ),
}
# The same for kickers and team defences, in one sum.
OTHER_CONTEXT = {"scoring_environment_rating": 0.50, "role_security": 0.30, "efficiency_rating": 0.20}


def draft_board(board: DataFrame, weights: Mapping[str, float] = BOARD_WEIGHTS, cuts: Mapping[str, tuple[int, int, int]] = TIER_CUTS) -> DataFrame:
    """draft score, model rank, position rank, change against the market and tier of each player.

    ``board`` has player_id, position, adp and the ratings opportunity, high_value, environment and
    evidence (raw opportunity, the others 0-100); a null rating is 50, and a player without raw
    opportunity stays at the market's score.
    """
    known = board.filter(F.col("opportunity").isNotNull())
    placed = ordinal_percentile(known.select("player_id", "position", "opportunity"), ["position"], [F.col("opportunity"), F.col("player_id")])
    rows = board.join(placed.select("player_id", F.col("percentile").alias("_opportunity")), "player_id", "left")
    rating = {"opportunity": F.col("_opportunity"), **{n: F.col(n) for n in weights if n != "opportunity"}}
    shift = F.lit(0.0)
    for name, weight in weights.items():
        shift = shift + weight * (F.coalesce(rating[name], F.lit(50.0)) - 50)
    score = 100 - 0.35 * (F.col("adp") - 1) + F.when(F.col("_opportunity").isNotNull(), shift).otherwise(0.0)
    # Hundredths are rounded as whole numbers: 79.44499999999999 is half a hundredth that a sum has left short.
    score = F.round(100 * score) / 100
    rows = rows.withColumn("score", score).drop("_opportunity")
    order = [("score", False), ("adp", True), ("player_id", True)]
    rows = places_in(rows, {"adp_rank": ([], [("adp", True), ("player_id", True)]), "model_rank": ([], order), "position_rank": (["position"], order)})
    tier = F.lit(1)
    for k in range(3):
        bound = lookup({p: c[k] for p, c in cuts.items()}, F.col("position"))
        tier = tier + F.when(F.col("position_rank") > bound, 1).otherwise(0)
    return rows.withColumn("rank_delta", F.col("adp_rank") - F.col("model_rank")).withColumn("tier", tier)


def context_signal(ratings: Mapping[str, Column], position: Column, injury_risk: Column) -> Column:
    """centred context of a player and its team by position; a missing rating is neutral."""
    centred = lambda parts: sum(((F.coalesce(ratings[n], F.lit(0.5)) - 0.5) * w for n, w in parts.items()), F.lit(0.0))
    out = centred(OTHER_CONTEXT)
    for name, (team, player, share) in CONTEXT.items():
        own = position.isin("WR", "TE") if name == "WR" else position == name
        out = F.when(own, share * centred(team) + (1 - share) * centred(player)).otherwise(out)
    return out - 0.35 * injury_risk


def adp_signal(adp: Column, current: Column, following: Column) -> Column:
    """2 to 8 for a player past his market position, down to -8 for one far from it; 0 without one."""
    gap = F.greatest(F.lit(1.0), (following - current).cast("double"))
    late = F.least(F.lit(8.0), 2 + 6 * (current - adp) / gap)
    soon = 2 * (following - adp) / gap
    far = -F.least(F.lit(8.0), 6 * (adp - following) / gap)
    return F.when(adp.isNull(), 0.0).when(adp <= current, late).when(adp <= following, soon).otherwise(far)


def draft_scores(players: DataFrame, leagues: DataFrame, levels: DataFrame, strategy: Mapping[str, float]) -> DataFrame:
    """every term of the score of each available player of each league, and the rank of the sum.

    ``players`` has league_id, player_id, position, points, floor, ceiling, adp, context (see
    ``context_signal``), variance, status (of ``lineup_status``), run (W12's pressure), surplus
    (players of the position beyond its slots, with this one) and same_bye (own players of the
    position with the same bye, if that counts yet). ``leagues`` has league_id, teams, rounds, current
    and following (one's next pick); ``levels`` league_id, position, demand and replacement (F16).
    """
    s = strategy
    totals = levels.groupBy("league_id").agg(F.greatest(F.lit(1), F.sum("demand")).alias("_demand"))
    rows = players.join(leagues, "league_id").join(levels, ["league_id", "position"]).join(totals, "league_id")
    turns = F.greatest(F.lit(1), F.col("following") - F.col("current"))
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.ceil(turns * F.col("demand") / F.col("_demand"))))
    rows = drop_to_kth_next(rows, ["league_id", "position"], "player_id", "points", "_k").withColumnRenamed("drop", "_scarcity")
    turn = F.ceil(F.col("current") / F.col("teams"))
    progress = F.least(F.lit(1.0), (turn - 1) / F.greatest(F.lit(1), F.col("rounds") - 1))
    fits, bench = F.col("status").isin("starter", "flex"), F.col("status") == "bench"
    vorp = F.col("points") - F.col("replacement")
    above = F.greatest(vorp, F.lit(0.0))
    need = F.when(F.col("status") == "starter", above).when(F.col("status") == "flex", 0.65 * above).otherwise(-F.greatest(F.lit(2.0), 0.12 * above))
    wait = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("following") - F.col("current") - 1) / F.greatest(F.lit(1), F.col("teams"))))
    early = F.when(F.col("position").isin("K", "DST") & (turn < s["specialist_round"]), (s["specialist_round"] - turn) * s["early_specialist_penalty"]).otherwise(0.0)
    terms = {
        "vorp_term": vorp * s["vorp_weight"],
        "need_term": need * s["starter_need_weight"] * F.when(fits, 1 + s["late_need_boost"] * progress).otherwise(1.0),
        "scarcity_term": F.col("_scarcity") * s["scarcity_weight"] * (1 + s["position_run_boost"] * F.col("run")),
        "adp_term": adp_signal(F.col("adp"), F.col("current"), F.col("following")) * s["adp_weight"] * (1 + s["long_turn_adp_boost"] * wait),
        "context_term": F.col("context") * s["analytics_weight"] + F.when(F.col("position") == "QB", (0.5 - F.col("variance")) * s["qb_variance_penalty"]).otherwise(0.0),
        "range_term": (F.col("ceiling") - F.col("points")) * s["upside_weight"] * F.when(bench, 1.2).otherwise(1.0) - (F.col("points") - F.col("floor")) * s["downside_weight"],
        "penalty_term": -early - F.when(bench, 2.0 * F.greatest(F.lit(0), F.col("surplus"))).otherwise(0.0) - 1.5 * F.col("same_bye"),
    }
    total = F.lit(0.0)
    for name in terms:
        total = total + F.col(name)
    scored = rows.select("league_id", "player_id", "position", vorp.alias("vorp"), *[t.alias(n) for n, t in terms.items()]).withColumn("score", total)
    return rank_in(scored, ["league_id"], [F.desc("score"), F.desc("vorp"), F.col("player_id")])


def adjusted_survival(board: DataFrame, target: Column) -> DataFrame:
    """``survival_estimates`` raised to the opponents' ``pressure`` on the position, within 0.005 and 0.995."""
    raised = F.pow(F.col("survival"), F.col("pressure"))
    return survival_estimates(board, target).withColumn("survival", F.least(F.lit(0.995), F.greatest(F.lit(0.005), raised)))


def tier_outlook(board: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """what is left of each player's tier, the position's expected picks, the drop to the next tier, the fallback and a level.

    ``board`` has player_id, position, tier, score, picks (until one's next), pressure and survival
    (0-100); ``shares`` the share of all picks that each position takes. The fallback is the next player
    of the position, by tier, score and id.
    """
    tiers = board.groupBy("position", "tier").agg(F.count("*").alias("remaining"), F.min("score").alias("_floor"), F.max("score").alias("_best"))
    above = tiers.select("position", F.col("tier").alias("_tier"), F.col("_best").alias("_next"))
    # A position has few tiers.
    later = tiers.select("position", "tier").join(above, "position").filter(F.col("_tier") > F.col("tier")).groupBy("position", "tier").agg(F.min(F.struct("_tier", "_next"))["_next"].alias("_next"))
    placed = rank_in(board, ["position"], [F.col("tier"), F.desc("score"), F.col("player_id")], "_place")
    following = placed.select("position", (F.col("_place") - 1).alias("_place"), F.col("player_id").alias("fallback"))
    rows = placed.join(following, ["position", "_place"], "left").join(tiers.drop("_best"), ["position", "tier"]).join(later, ["position", "tier"], "left")
    expected = F.greatest(F.lit(1), F.ceil(F.col("picks") * lookup(dict(shares), F.col("position")) * F.col("pressure"))).cast("long")
    drop = F.coalesce(F.greatest(F.lit(0.0), F.col("_floor") - F.col("_next")), F.lit(0.0))
    gone = expected >= F.col("remaining")
    level = F.when((F.col("survival") <= 25) | (gone & (drop >= 1)), "critical").when((F.col("survival") <= 50) | gone, "warning").otherwise("safe")
    return rows.select("player_id", "position", "tier", "remaining", expected.alias("expected_picks"), drop.alias("drop"), "fallback", level.alias("level"))


def season_scores(trends: DataFrame) -> DataFrame:
    """``trends`` (W9, with position, games of both halves and late_share) with their score (0-100).

    The level is the percentile of late volume, for WR and TE averaged with that of late target
    share. A player without an early game has no trend and takes the level for it; one without a
    late game scores 0 and is no peer. Means are compared as rounded to the digits of ties, as their
    last bits depend on the order of rows.
    """
    seen = trends.filter("not unavailable").withColumns({c: F.round(c, TIE_DIGITS) + F.lit(0.0) for c in ("late", "late_share", "trend")})
    seen = stored(seen.select("player_id", "position", "late", "early", "late_share", "trend"), "season-means")
    rank = lambda column, name: cume_percentile(seen.filter(F.col(column).isNotNull()), ["position"], column).select("player_id", F.col("percentile").alias(name))
    trend = seen.withColumn("trend", F.when(F.col("early").isNotNull(), F.col("trend")))
    slope = cume_percentile(trend.filter("trend is not null"), ["position"], "trend").select("player_id", F.col("percentile").alias("_slope"))
    rows = trends.join(rank("late", "_volume"), "player_id", "left").join(rank("late_share", "_share"), "player_id", "left").join(slope, "player_id", "left")
    level = F.when(F.col("position").isin("WR", "TE") & F.col("_share").isNotNull(), (F.col("_volume") + F.col("_share")) / 2).otherwise(F.col("_volume"))
    score = F.when(F.col("unavailable"), 0.0).otherwise(0.7 * level + 0.3 * F.coalesce("_slope", level))
    return rows.withColumn("score", score).drop("_volume", "_share", "_slope")


def season_board(scores: DataFrame, owners: DataFrame, rows: int | None = None) -> DataFrame:
    """each league's players that others own or no one owns, against one's weakest peer, with a reason.

    ``owners`` has league_id, player_id and mine. The peer is the weakest available own player of the
    position, or of the unavailable ones where there is no other. ``rows`` is how many free players of a
    position each league is offered, the best ones (see ``league_shortlist``); all if None.
    """
    own = owners.filter("mine").join(scores.select("player_id", "position", "score", "unavailable"), "player_id")
    peer = own.groupBy("league_id", "position").agg(F.min(F.struct("unavailable", "score", "player_id")).alias("_peer"))
    board = league_shortlist(scores.select("player_id", "position", "score", "unavailable"), owners, rows).join(peer, ["league_id", "position"], "left")
    delta = F.col("score") - F.coalesce(F.col("_peer.score"), F.lit(0.0))
    reason = F.when(F.col("unavailable"), "unavailable").when(F.col("_peer").isNull(), "empty_position").when(delta > 0, "upgrade").otherwise("depth_only")
    return board.select("league_id", "player_id", "position", "score", delta.alias("delta"), "list", F.col("_peer.player_id").alias("compare_with"), reason.alias("reason"))
