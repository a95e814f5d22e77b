"""No leakage: what happened in the target season must not change its forecast."""

import pytest
from pyspark.sql import functions as F

from opportunity.plans import backtests


@pytest.fixture(scope="module")
def values(spark):
    rows = [(s, w, t, r * (1 + 0.01 * w), 1) for s in range(2021, 2026) for w in range(1, 19) for t, r in (("A", 25.0), ("B", 15.0))]
    return spark.createDataFrame(rows, "season int, week int, team string, amount double, games int")


def forecasts(rows, season):
    return {(r.team, r.model): r.forecast for r in rows.filter(F.col("target_season") == season).collect()}


def test_forecasts_read_earlier_seasons_only(values):
    before = forecasts(backtests.rate_backtest(values, (2024, 2025)), 2024)
    changed = values.withColumn("amount", F.when(F.col("season") >= 2024, 999.0).otherwise(F.col("amount")))
    assert forecasts(backtests.rate_backtest(changed, (2024, 2025)), 2024) == pytest.approx(before)
    assert forecasts(backtests.rate_backtest(changed, (2024, 2025)), 2025) != pytest.approx(before)


def test_team_rates_win_where_teams_differ(values):
    rows = backtests.rate_summary(backtests.rate_backtest(values, (2023, 2024, 2025))).filter("scope = 'ALL' and window_end = 18").collect()
    errors = {r.model: r.mean_error for r in rows}
    assert errors["raw"] < errors["p4"] < errors["p17"] < errors["league"]


def test_calibration(values):
    row = backtests.holdout_calibration(backtests.rate_backtest(values, (2023, 2024, 2025)), 2025, "raw").filter("window_end = 18").first()
    assert (row.rows, row.covered) == (2, 2) and row.radius == pytest.approx(0, abs=1e-9)


def test_role_models(spark):
    rooms = spark.createDataFrame([(2024, "A", "RB_CARRIES", "RB", p, k) for k, p in enumerate("xyz", 1)], "season int, team string, resource string, position string, player_id string, depth_rank int")
    history = spark.createDataFrame([(2024, "A", "RB_CARRIES", "y", 0.5, 16.0, True)], "season int, team string, resource string, player_id string, share double, weighted_games double, same_team boolean")
    weights = backtests.role_weights(rooms, history)
    rows = {(r.model, r.player_id): r.weight for r in weights.collect()}
    assert sum(rows["depth", p] for p in "xyz") == pytest.approx(1) and rows["prior", "y"] == 1 and rows["depth", "y"] < rows["blend", "y"] < 1
    active = spark.createDataFrame([(2024, "A", w, p) for w in (1, 5) for p in "xy"], "season int, team string, week int, player_id string")
    actual = spark.createDataFrame([(2024, "A", "RB_CARRIES", 1, "y", 10.0), (2024, "A", "RB_CARRIES", 5, "x", 10.0), (2024, "A", "RB_CARRIES", 6, "q", 5.0)], "season int, team string, resource string, week int, player_id string, amount double")
    got = {(r.model, r.window_end): r for r in backtests.allocation_backtest(weights, active, actual).collect()}
    assert got["prior", 4].total_variation == pytest.approx(0) and got["prior", 4].top_hit
    assert got["depth", 4].total_variation > 0.5
    assert got["prior", 8].total_variation == pytest.approx(0.6) and got["prior", 8].coverage == pytest.approx(0.8)


def test_transition_blends(spark):
    prior = spark.createDataFrame([("A", "m", 0.6), ("B", "m", 0.4), ("C", "m", 0.5)], "team string, metric string, value double")
    actual = spark.createDataFrame([(t, 6, "m", 0.5) for t in "ABC"], "team string, window_end int, metric string, value double")
    cohorts = spark.createDataFrame([("A", "returning", None), ("B", "changed_with_anchor", "A"), ("C", "ambiguous", None)], "team string, cohort string, anchor_team string")
    rows = backtests.transition_backtest(prior, actual, cohorts, spark.createDataFrame([("m", 0.05)], "metric string, tolerance double"))
    got = {(r.team, r.model): r.forecast for r in rows.collect()}
    assert got == pytest.approx({("A", "persistence"): 0.6, ("A", "shrunken"): 0.58, ("A", "caller_aware"): 0.595, ("B", "persistence"): 0.4, ("B", "shrunken"): 0.42, ("B", "caller_aware"): 0.55})
    effects = {r.team: r.paired_delta for r in backtests.paired_team_effects(rows).collect()}
    assert effects == pytest.approx({"A": 0.3, "B": -0.6})
