import json

import pytest
from pyspark.sql import functions as F

from opportunity.operators.aggregates import team_style
from opportunity.operators.joins import with_positions
from opportunity.quality import QualityError
from opportunity.sources import readers, snapshots

PLAYS = """season,season_type,week,game_id,play_id,posteam,qtr,down,yardline_100,yards_gained,qb_kneel,qb_spike,qb_scramble,air_yards,epa,wp,receiver_player_id,rusher_player_id,success,pass,rush,pass_oe,shotgun,no_huddle
2024,REG,1,g1,1,SEA,1,1,50,25,0,0,0,18,1.0,0.5,w1,,1,1,0,0.1,1,0
2024,REG,1,g1,2,SEA,1,2,15,3,0,0,0,,0.2,0.5,,q1,0,0,1,-0.2,1,
2024,REG,2,g2,3,SEA,4,3,10,12,0,0,0,2,0.4,0.9,r1,,1,1,0,nan,0,0
2024,REG,2,g2,4,SEA,4,3,10,0,1,0,0,,0.0,0.9,,q1,0,0,1,,0,0
2024,POST,20,g3,5,SEA,1,1,50,5,0,0,0,3,0.1,0.5,w1,,1,1,0,0.1,1,0
"""


@pytest.fixture
def plays(spark, tmp_path):
    (tmp_path / "plays.csv").write_text(PLAYS)
    found = readers.read_plays(spark, str(tmp_path / "plays.csv"), season=2024)
    roster = spark.createDataFrame([("w1", "WR"), ("q1", "QB")], "player_id string, position string")
    found = found.withColumnRenamed("receiver_player_id", "receiver_id").withColumnRenamed("rusher_player_id", "rusher_id")
    found = with_positions(found, roster, "receiver_id", "receiver_position")
    return with_positions(found, roster, "rusher_id", "rusher_position")


def test_style_rates(plays):
    row = team_style(plays).first()
    assert (row.games, row.plays) == (2, 3)
    assert row.pass_rate == pytest.approx(2 / 3)
    assert row.neutral_early_down_pass_rate == 0.5
    assert row.neutral_pass_oe == pytest.approx(-0.05)
    assert row.red_zone_pass_rate == 0.5
    assert row.deep_attempt_rate == 0.5
    assert row.designed_qb_run_share == 1.0
    assert row.explosive_play_rate == pytest.approx(1 / 3)
    assert row.no_huddle_rate == 0.0  # the unknown one does not count
    assert (row.wr_target_share, row.unknown_target_share) == (0.5, 0.5)


def test_style_window(plays):
    row = team_style(plays, weeks=(1, 1)).first()
    assert (row.games, row.plays, row.pass_rate) == (1, 2, 0.5)


def test_other_season_is_an_error(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PLAYS.replace("2024,REG,2,g2,3", "2023,REG,2,g2,3"))
    with pytest.raises(QualityError):
        readers.read_plays(spark, str(tmp_path / "p.csv"), season=2024)


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PLAYS.replace("posteam", "team"))
    with pytest.raises(QualityError):
        readers.read_plays(spark, str(tmp_path / "p.csv"))


def test_schedule_has_two_rows_a_game(spark, tmp_path):
    (tmp_path / "s.csv").write_text("game_id,season,game_type,week,gameday,away_team,home_team\ng1,2024,REG,1,2024-09-05,LA,SEA\ng2,2024,REG,2,2024-09-12,SEA,OAK\n")
    rows, cutoffs = readers.read_schedule(spark, str(tmp_path / "s.csv"))
    assert {(r.team, r.opponent, r.home_away) for r in rows.collect()} == {("LAR", "SEA", "away"), ("SEA", "LAR", "home"), ("SEA", "LV", "away"), ("LV", "SEA", "home")}
    assert str(cutoffs.first().cutoff) == "2024-09-05"


def test_rosters_keep_one_row_and_review_the_rest(spark, tmp_path):
    (tmp_path / "r.csv").write_text("season,week,team,position,status,full_name,gsis_id,game_type\n2024,1,SEA,FB,ACT,A,1,REG\n2024,1,SEA,FB,RES,A,1,REG\n2024,1,SEA,WR,ACT,B,,REG\n2024,1,SEA,C,ACT,D,4,REG\n")
    kept, review = readers.read_weekly_rosters(spark, str(tmp_path / "r.csv"))
    assert [(r.player_id, r.position, r.status) for r in kept.collect()] == [("1", "RB", "ACT")]
    assert sorted(r.reason for r in review.collect()) == ["duplicate", "missing_id"]


def test_dated_depth_ends_before_the_cutoff(spark, tmp_path):
    (tmp_path / "d.csv").write_text("dt,team,gsis_id,pos_abb,pos_rank\n2025-09-01 00:00:00,SEA,1,QB,2\n2025-09-03 00:00:00,SEA,1,QB,1\n2025-09-04 00:00:00,SEA,2,QB,1\n")
    cutoffs = spark.createDataFrame([(2025, "2025-09-04")], "season int, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    rows = readers.read_opening_depth(spark, {"dated": str(tmp_path / "d.csv")}, cutoffs).collect()
    assert [(r.season, r.player_id, r.depth_rank) for r in rows] == [(2025, "1", 1)]


def test_adp(spark, tmp_path):
    player = {"player_id": 7, "name": "A", "position": "PK", "team": "sea", "adp": 3.5, "times_drafted": 9, "high": 1, "low": 6, "stdev": 1.0, "bye": 8}
    (tmp_path / "a.json").write_text(json.dumps({"status": "Success", "meta": {}, "players": [player]}))
    assert readers.read_adp(spark, str(tmp_path / "a.json")).first().position == "K"
    (tmp_path / "b.json").write_text(json.dumps({"players": [player | {"high": 9}]}))
    with pytest.raises(QualityError):
        readers.read_adp(spark, str(tmp_path / "b.json"))


def test_closed_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("team,pace\nSEA,\n")
    assert readers.read_closed_table(spark, str(tmp_path / "t.csv"), ["team"], {"pace": 0.5, "line": 0.5}).first().pace == 0.5
    with pytest.raises(QualityError):
        readers.read_closed_table(spark, str(tmp_path / "t.csv"), ["team"], {"line": 0.5})


def test_evidence(spark, tmp_path):
    doc = {"sources": [{"id": "s", "url": "u", "published": "2025-01-02"}], "teams": [{"team": "SEA", "claims": [{"id": "c", "source_id": "s", "confidence": 0.5, "metric_signals": {"pace": 1.0, "pass": -1.0}}]}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    tables = readers.read_evidence(spark, str(tmp_path / "e.json"))
    assert {(r.metric, r.signal) for r in tables["claim_signals"].collect()} == {("pace", 1.0), ("pass", -1.0)}


def test_news(spark, tmp_path):
    item = "<item><title>t{0}</title><link>l</link><guid>{1}</guid><pubDate>2025-01-0{0}</pubDate><source>s</source></item>"
    (tmp_path / "n.xml").write_text("<rss><channel>" + item.format(1, "a") + item.format(2, "b") + item.format(3, "b") + "<item><title>x</title></item></channel></rss>")
    assert readers.read_news(spark, str(tmp_path / "n.xml"), 5).count() == 2


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    first = snapshots.write_snapshot(df, str(tmp_path), "one")
    assert snapshots.write_snapshot(df.orderBy(F.desc("x")), str(tmp_path), "two") == first
    assert snapshots.read_verified(spark, str(tmp_path), "one", ["x"]).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshots.write_snapshot(df, str(tmp_path), "one")
    df.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/one/data")
    with pytest.raises(QualityError):
        snapshots.read_verified(spark, str(tmp_path), "one")
