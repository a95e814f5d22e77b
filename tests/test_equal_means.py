"""Means that differ in their last bits only are equal."""

from opportunity.plans import drafting


def test_equal_means_share_a_percentile(spark):
    first, second = 0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1
    assert first != second
    rows = [(1, "WR", first, 0.5, 1.0, 0.2, False), (2, "WR", second, 0.5, 1.0, 0.2, False), (3, "WR", 9.0, 0.5, 1.0, 0.2, False), (4, "RB", None, 2.0, None, -2.0, True)]
    trends = spark.createDataFrame(rows, "player_id long, position string, late double, early double, late_share double, trend double, unavailable boolean")
    scores = dict(drafting.season_scores(trends).select("player_id", "score").collect())
    assert scores[1] == scores[2] and scores[4] == 0.0
