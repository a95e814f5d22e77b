import os

import pytest
from test_whole_tables import DATA, same_as_sql

from opportunity.plans import forecast

ROLES = [("m", "A", 1, 3.0, True), ("m", "A", 2, 1.0, False), ("m", "B", 3, 1.0, False)]
EVENTS = [("m", 1, 2023, "A", 6.0, 12.0), ("m", 9, 2023, "A", 2.0, 28.0)]


def priors(spark):
    roles = spark.createDataFrame(ROLES, "metric string, team string, player_id int, weight double, active boolean")
    events = spark.createDataFrame(EVENTS, "metric string, player_id int, season int, team string, high double, base double")
    return forecast.high_value_priors(roles, events, 2024)


def test_priors_by_hand(spark):
    rows = {r.player_id: r for r in priors(spark).collect()}
    one = rows[1]
    for k in (12, 24, 48):
        m = (6 + k * 0.2) / (12 + k) / 0.2
        assert one[f"share_p{k}"] == pytest.approx(0.75 * m / (0.75 * m + 0.25))
    assert one.active_share == pytest.approx(1.0) and rows[2].active_share is None and rows[3].share_p24 == pytest.approx(1.0)
    assert one.share_low == one.share_p48 and one.share_high == one.share_p12
    issues = {(r.player_id, r.issue) for r in forecast.high_value_reviews(priors(spark)).collect()}
    assert issues == {(1, "role_with_limited_history"), (2, "role_without_history"), (3, "role_without_history"), (None, "no_active_candidate")}


def test_scenarios_count_absent_draws_and_byes(spark):
    weeks = spark.createDataFrame([("A", 1, 1, 1.0, True), ("A", 1, 2, 0.0, True), ("A", 2, 1, 1.0, False), ("A", 2, 2, 1.0, False), ("B", 1, 3, 0.0, True)], "team string, week int, player_id int, p double, scheduled boolean")
    found = {(r.team, r.week, r.player_id): (r.mean_share, r.p10, r.p50, r.p90) for r in forecast.high_value_scenarios(priors(spark), weeks, 10, 7).collect()}
    assert found == {
        ("A", 1, "1"): (1.0, 1.0, 1.0, 1.0), ("A", 1, "2"): (0.0,) * 4, ("A", 2, "1"): (0.0,) * 4, ("A", 2, "2"): (0.0,) * 4,
        ("B", 1, "3"): (0.0,) * 4, ("B", 1, "__UNALLOCATED__"): (1.0, None, None, None),
    }


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["f10_high_value_priors", "f10_high_value_reviews", "f11_high_value_scenarios"])
def test_as_sql(spark, name):
    _, found = same_as_sql(spark, name)
    assert found
