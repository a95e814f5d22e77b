"""team environments from measured anchors and reviewed evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opportunity.functions.clean import lookup, safe_ratio, score_band
from opportunity.operators.aggregates import unpivoted, weighted_mean
from opportunity.operators.windows import keep_best, midrank_percentile
from opportunity.quality import QualityError

# Points of each part of the structural certainty, of 1 in all.
CERTAINTY_WEIGHTS = {
    "playcaller_confirmed": 0.15,
    "same_playcaller": 0.20,
    "playcalling_experience": 0.15,
    "head_coach_continuity": 0.10,
    "scheme_continuity": 0.15,
    "offensive_staff_continuity": 0.10,
    "personnel_continuity": 0.10,
    "evidence_agreement": 0.05,
}
# Fixed values.
CONTINUITY_VALUES = {
    "returning_same_role": 1.0,
    "returning_changed_role": 0.60,
    "returning_after_gap": 0.40,
    "new_to_team": 0.0,
    "unknown": 0.25,
}
# Fixed values.
CONFIRMATION_VALUES = {"official": 1.0, "reported": 0.85, "inferred": 0.45, "unknown": 0.0}
# Metric, weight and direction of each position's environment.
POSITION_METRICS = {
    "QB": (
        ("neutral_early_down_pass_rate", 0.25, 1), ("pass_rate", 0.15, 1), ("plays_per_game", 0.15, 1), ("red_zone_pass_rate", 0.10, 1),
        ("deep_attempt_rate", 0.10, 1), ("qb_scramble_rate", 0.15, 1), ("epa_per_play", 0.10, 1),
    ),
    "RB": (
        ("neutral_early_down_pass_rate", 0.25, -1), ("red_zone_pass_rate", 0.20, -1), ("plays_per_game", 0.15, 1), ("rb_target_share", 0.20, 1),
        ("success_rate", 0.10, 1), ("designed_qb_run_share", 0.10, -1),
    ),
    "WR": (
        ("neutral_early_down_pass_rate", 0.25, 1), ("pass_rate", 0.10, 1), ("plays_per_game", 0.15, 1), ("deep_attempt_rate", 0.15, 1),
        ("wr_target_share", 0.25, 1), ("epa_per_play", 0.10, 1),
    ),
    "TE": (
        ("neutral_early_down_pass_rate", 0.15, 1), ("plays_per_game", 0.15, 1), ("te_target_share", 0.40, 1), ("red_zone_pass_rate", 0.15, 1),
        ("success_rate", 0.15, 1),
    ),
}
# Fixed values.
POSITION_LABELS = ((65, "favorable"), (55, "slightly_favorable"), (45, "mixed_neutral"), (35, "slightly_unfavorable"))
CERTAINTY_TIERS = ((80, "high"), (65, "medium_high"), (50, "medium"), (35, "low_medium"))


def structural_certainty(teams: DataFrame, staff: DataFrame, claims: DataFrame) -> DataFrame:
    """the eight parts (0-1) of each team's structural certainty, and their weighted sum (0-100).

    ``teams`` has team, scheme_continuity and returning_starters_fraction; ``staff`` team,
    continuity, influence_weight, is_head_coach, is_play_caller, completed_playcalling_seasons and
    playcaller_confirmation; ``claims`` team, certainty_effect and weight. A team has one head coach
    and one caller.
    """
    value = lookup(CONTINUITY_VALUES, F.col("continuity"))
    helper = ~F.col("is_head_coach") & ~F.col("is_play_caller")
    caller = lambda col: F.max(F.when(F.col("is_play_caller"), col))
    people = staff.groupBy("team").agg(
        caller(lookup(CONFIRMATION_VALUES, F.col("playcaller_confirmation"))).alias("playcaller_confirmed"),
        caller(F.when(F.col("continuity") == "returning_same_role", 1.0).otherwise(0.0)).alias("same_playcaller"),
        caller(F.least(F.lit(1.0), F.col("completed_playcalling_seasons") / 5)).alias("playcalling_experience"),
        F.max(F.when(F.col("is_head_coach"), value)).alias("head_coach_continuity"),
        F.coalesce(safe_ratio(F.sum(F.when(helper, value * F.col("influence_weight"))), F.sum(F.when(helper, F.col("influence_weight")))), F.lit(0.25)).alias("offensive_staff_continuity"),
    )
    agreed = claims.groupBy("team").agg(((weighted_mean(F.col("certainty_effect"), F.col("weight")) + 1) / 2).alias("evidence_agreement"))
    rows = teams.join(people, "team").join(agreed, "team", "left")
    rows = rows.withColumn("evidence_agreement", F.coalesce("evidence_agreement", F.lit(0.5))).withColumn("personnel_continuity", F.coalesce("returning_starters_fraction", F.lit(0.25)))
    total = F.lit(0.0)
    for name, weight in CERTAINTY_WEIGHTS.items():
        total = total + 100 * weight * F.col(name)
    return rows.select("team", *CERTAINTY_WEIGHTS, total.alias("structural_score"))


def style_forecasts(anchors: DataFrame, style: DataFrame, claims: DataFrame, signals: DataFrame, certainty: DataFrame, specs: DataFrame) -> DataFrame:
    """forecast, percentile and certainty of each team and metric that has a measured anchor.

    ``anchors`` has team, anchor_team, season and weight; ``style`` season, team, metric and value;
    ``claims`` team, claim_id, dimensions, certainty_effect and weight; ``signals`` team, claim_id,
    metric and signal; ``specs`` metric, dimension, tolerance, low and high (null: no bound). An
    anchor without any style row is an error.
    """
    seasons = style.select(F.col("team").alias("anchor_team"), "season").distinct()
    if lost := anchors.join(seasons, ["anchor_team", "season"], "left_anti").limit(1).collect():
        raise QualityError(f"anchor without a style row: {lost[0].asDict()}")
    known = style.filter(F.col("value").isNotNull())
    own = anchors.join(known.select(F.col("team").alias("anchor_team"), "season", "metric", "value"), ["anchor_team", "season"])
    w, v = F.col("weight"), F.col("value")
    own = own.groupBy("team", "metric").agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_x"), F.sum(w * v * v).alias("_xx"), F.count("*").alias("anchors"))
    base = F.col("_x") / F.col("_w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_xx") / F.col("_w") - base * base))
    own = own.select("team", "metric", "anchors", F.col("_w").alias("anchor_weight"), base.alias("anchor_value"), spread.alias("anchor_std"))
    league = known.groupBy("metric").agg(F.stddev_pop("value").alias("reference_std"))
    said = signals.join(claims.select("team", "claim_id", "weight"), ["team", "claim_id"]).groupBy("team", "metric").agg(weighted_mean(F.col("signal"), F.col("weight")).alias("signal"), F.least(F.lit(1.0), F.sum("weight")).alias("volume"))
    effects = claims.select("team", F.explode("dimensions").alias("dimension"), "certainty_effect", "weight").groupBy("team", "dimension").agg(weighted_mean(F.col("certainty_effect"), F.col("weight")).alias("effect"))
    rows = own.join(specs, "metric").join(league, "metric").join(said, ["team", "metric"], "left").join(effects, ["team", "dimension"], "left").join(certainty.select("team", "structural_score"), "team")
    shift = 0.20 * F.col("reference_std") * F.coalesce("signal", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))
    moved = F.col("anchor_value") + shift
    forecast = F.least(F.coalesce("high", moved), F.greatest(F.coalesce("low", moved), moved))
    stability = (1 - F.least(F.col("anchor_std") / F.col("tolerance"), F.lit(1.0))) * (0.5 + 0.5 * F.least(F.col("anchor_weight") / 3, F.lit(1.0)))
    sure = 0.80 * F.col("structural_score") + 20 * stability + 5 * F.coalesce("effect", F.lit(0.0))
    rows = rows.select("team", "metric", "dimension", "anchors", "anchor_value", "anchor_std", shift.alias("shift"), forecast.alias("value"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), sure)).alias("certainty"))
    return midrank_percentile(rows, known, ["metric"], "value")


def style_certainty(forecasts: DataFrame, keys: Sequence[str] = ("team",)) -> DataFrame:
    """mean certainty of a team's forecasts (of each dimension with it among the keys), and its tier."""
    out = forecasts.groupBy(*keys).agg(F.avg("certainty").alias("style_score"), F.count("*").alias("metrics"))
    return out.withColumn("tier", score_band(F.col("style_score"), CERTAINTY_TIERS, "low"))


def position_scores(forecasts: DataFrame, definitions: Mapping[str, Sequence[tuple[str, float, int]]] = POSITION_METRICS) -> DataFrame:
    """score (shrunk to 50 by missing metrics), certainty, coverage, label and first driver of each team and position."""
    weights = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(m).alias("metric"), F.lit(w).alias("weight"), F.lit(d).alias("direction")) for p, rows in definitions.items() for m, w, d in rows])
    total = {p: sum(w for _, w, _ in rows) for p, rows in definitions.items()}
    rows = forecasts.withColumn("d", F.explode(F.filter(weights, lambda d: d["metric"] == F.col("metric")))).select("team", "metric", "percentile", "certainty", "d.position", "d.weight", "d.direction")
    rows = rows.withColumn("share", F.when(F.col("direction") < 0, 1 - F.col("percentile")).otherwise(F.col("percentile")))
    out = rows.groupBy("team", "position").agg(
        F.sum("weight").alias("_w"), (100 * F.sum(F.col("weight") * F.col("share")) / F.sum("weight")).alias("_raw"), (F.sum(F.col("weight") * F.col("certainty")) / F.sum("weight")).alias("_sure")
    )
    lead = keep_best(rows.select("team", "position", F.abs(F.col("share") - 0.5).alias("_far"), "metric"), ["team", "position"], [-F.col("_far"), F.col("metric")])
    every = forecasts.select("team").distinct().withColumn("position", F.explode(F.array(*[F.lit(p) for p in definitions])))
    joined = every.join(out, ["team", "position"], "left").join(lead.select("team", "position", F.col("metric").alias("driver")), ["team", "position"], "left")
    coverage = F.coalesce(F.col("_w") / lookup(total, F.col("position")), F.lit(0.0))
    score = F.coalesce(50 + (F.col("_raw") - 50) * coverage, F.lit(50.0))
    label = F.when(F.col("_w").isNull(), "unknown").otherwise(score_band(score, POSITION_LABELS, "unfavorable"))
    return joined.select("team", "position", score.alias("score"), F.coalesce(F.col("_sure") * coverage, F.lit(0.0)).alias("certainty"), coverage.alias("coverage"), label.alias("label"), "driver")


def evidence_environment(evidence: Mapping[str, DataFrame], style: DataFrame, metrics: Sequence[str], specs: DataFrame, weight: Column | None = None) -> dict[str, DataFrame]:
    """certainty, forecasts, styles and positions of what ``read_evidence`` returns.

    ``style`` has season, team and the metrics. ``weight`` says how much a claim counts, its
    confidence unless given.
    """
    claims = evidence["claims"].withColumn("weight", F.col("confidence") if weight is None else weight)
    certainty = structural_certainty(evidence["teams"], evidence["staff"], claims)
    long = unpivoted(style, ["season", "team"], metrics)
    forecasts = style_forecasts(evidence["anchors"], long, claims.withColumnRenamed("id", "claim_id"), evidence["claim_signals"], certainty, specs)
    return {"certainty": certainty, "forecasts": forecasts, "styles": style_certainty(forecasts), "positions": position_scores(forecasts)}
