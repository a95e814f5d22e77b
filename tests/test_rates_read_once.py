from opportunity.plans import backtests


def test_plays_are_not_read_again_for_each_target(spark, tmp_path):
    rows = spark.range(400).selectExpr("1996 + id % 6 as season", "id % 18 + 1 as week", "id % 4 as team", "cast(id % 7 as double) as amount", "1L + id % 3 as games")
    rows.write.parquet(f"{tmp_path}/source-of-rates")
    found = backtests.rate_backtest(spark.read.parquet(f"{tmp_path}/source-of-rates"), (1999, 2000, 2001))
    assert not any("source-of-rates" in name for name in found.inputFiles())
    assert {r.target_season for r in found.select("target_season").distinct().collect()} == {1999, 2000, 2001}
