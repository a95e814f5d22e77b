"""F15's scores where half a hundredth meets the last bits of a sum."""

import duckdb

from opportunity.plans import drafting


def test_half_hundredths_are_rounded_as_in_sql(spark):
    board = spark.createDataFrame([(k, "QB", 1 + k / 10, None, None, None, None) for k in range(1, 700)], "player_id long, position string, adp double, opportunity double, high_value double, environment double, evidence double")
    got = dict(drafting.draft_board(board).select("player_id", "score").collect())
    want = dict(duckdb.sql("select k, round(100::double - 0.35::double * ((1 + k / 10) - 1), 2) from range(1, 700) t(k)").fetchall())
    assert got == want
    assert want[231] == 91.92 and want[565] == 80.22  # 91.91499999999999 and 80.225, whose hundredfold is 8022.499999999999
