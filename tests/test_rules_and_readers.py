"""Errors that checked operators raise, readers of whole documents, and jobs on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from opportunity import quality
from opportunity.functions import clean
from opportunity.operators import aggregates as agg
from opportunity.operators import joins, ranges, windows
from opportunity.plans import drafting, environment, evaluations, forecast
from opportunity.quality import QualityError
from opportunity.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_charting_errors(spark):
    plays = frame(spark, [("g", "1"), ("g", "2")], "game_id string, play_id string")
    charting = frame(spark, [("g", "1", True), ("g", "1", False), ("h", "9", True), ("h", "9", True)], "game_id string, play_id string, is_motion boolean")
    with pytest.raises(QualityError):
        joins.checked_charting(plays, charting, ["game_id", "play_id"])
    with pytest.raises(QualityError):
        joins.checked_charting(plays, charting.filter("game_id = 'h'").limit(1), ["game_id", "play_id"])
    fine = charting.filter("is_motion or game_id = 'h'")
    assert joins.checked_charting(plays, fine, ["game_id", "play_id"]).filter("charted").count() == 1


def test_evidence_errors(spark):
    queue = frame(spark, [(1, "a", "A"), (2, "a", "B")], "player_id int, metric string, name string")
    record = lambda *rows: frame(spark, rows, "player_id int, metric string, name string, finding string")
    keys = ["player_id", "metric"]
    assert joins.checked_evidence(queue, record((1, "a", "A", "kept")), keys, ["name"]).filter("finding = 'unreviewed'").count() == 1
    for bad in (record((3, "a", "C", "kept")), record((1, "a", "A", "x"), (1, "a", "A", "y")), record((1, "a", "Z", "kept"))):
        with pytest.raises(QualityError):
            joins.checked_evidence(queue, bad, keys, ["name"])


def test_episode_errors(spark):
    episodes = lambda *rows: frame(spark, rows, "caller_key string, team string, season int")
    census, current, style = episodes(("c", "A", 2023), ("c", "B", 2024)), episodes(("c", "C", 2025)), frame(spark, [("A", 2023), ("D", 2022)], "team string, season int")
    good = joins.checked_episodes(census, current, episodes(("c", "B", 2024)), episodes(("c", "D", 2022)), style)
    assert {(r.team, r.weight) for r in good.collect()} == {("A", 1.0), ("B", 0.0), ("D", 1.0)}
    none = episodes(("c", "A", 2023)).limit(0)
    for excluded, added in ((episodes(("c", "Z", 2020)), none), (none, episodes(("c", "A", 2023))), (none, none)):
        with pytest.raises(QualityError):
            joins.checked_episodes(census, current, excluded, added, style)


def test_more_errors(spark):
    rows = frame(spark, [("a", 0.0), ("b", 1.0)], "room string, x double")
    with pytest.raises(QualityError):
        windows.checked_share(rows, ["room"], "x")
    totals = frame(spark, [("a", 0.0), ("b", 2.0)], "room string, total double")
    with pytest.raises(QualityError):
        quality.assert_reconciled(rows, totals, ["room"], "x", "total")
    quality.assert_reconciled(rows, totals.filter("room = 'a'"), ["room"], "x", "total")
    quality.assert_reproduces(rows, rows)
    with pytest.raises(QualityError):
        quality.assert_reproduces(rows, rows.limit(1))
    usage = frame(spark, [(2023, "A", 8.0), (2024, "B", 8.0)], "season int, team string, targets double")
    style = frame(spark, [(2023, "A", 10.0)], "season int, team string, plays double")
    pairs, bounds = {"target_per_pass_play": ("targets", "plays")}, agg.CONVERSION_BOUNDS
    with pytest.raises(QualityError):
        agg.conversion_factors(usage, style, 2024, pairs, bounds=bounds)
    assert agg.conversion_factors(usage.limit(1), style, 2024, pairs, bounds=bounds).first().target_per_pass_play == pytest.approx(0.8)
    with pytest.raises(QualityError):
        agg.conversion_factors(usage.limit(1), style.withColumn("plays", F.lit(100.0)), 2024, pairs, bounds=bounds)
    weekly, season = frame(spark, [(1,)], "player_id int"), frame(spark, [(1, True)], "player_id int, required boolean")
    with pytest.raises(QualityError):
        joins.checked_reviews(weekly, season, frame(spark, [(2, "x")], "player_id int, review string"))


def test_review_rows(spark):
    catalog = frame(spark, [("p", "x", "A"), ("q", "y", "A"), ("r", "y", "B")], "player_id string, other_id string, team string")
    snaps = frame(spark, [(2024, "A", "x", "P"), (2024, "A", "y", "Q"), (2024, "A", "z", "Z"), (2024, "A", "z", "Z")], "season int, team string, other_id string, name string")
    assert {(r.other_id, r.reason) for r in joins.snap_reviews(snaps, catalog).collect()} == {("y", "ambiguous"), ("z", "unmatched")}
    rows = frame(spark, [("p", None, "B"), (None, "x", "A"), ("p", "x", "A")], "player_id string, other_id string, team string")
    assert sorted(str(r.reason) for r in joins.resolve_identity(rows, catalog).collect()) == ["None", "None", "team_mismatch"]
    market = frame(spark, [("s", "al", "A", "WR"), ("k", "kk", "A", "K")], "source_id string, name_key string, team string, position string")
    roster = frame(spark, [("p", ["albert", "al"], "A", "WR")], "player_id string, name_keys array<string>, team string, position string")
    assert {(r.source_id, r.player_id, r.status) for r in joins.market_crosswalk(market, roster).collect()} == {("s", "p", "resolved"), ("k", None, "out_of_scope")}
    forecast_rows = frame(spark, [("A", "p", 0.6), ("A", "__UNALLOCATED__", 0.4)], "team string, player_id string, forecast double")
    actual = frame(spark, [("A", "q", 1.0)], "team string, player_id string, actual double")
    assert {r.player_id: r.row_type for r in joins.forecast_vs_actual(forecast_rows, actual, ["team", "player_id"]).collect()} == {"p": "opening", "__UNALLOCATED__": "unallocated", "q": "later_entrant"}


def test_names(spark):
    names = ["José Peña Jr.", "Łukasz O’Neil III", "Ｊｏｈｎ ﬁne", "Iv", "Ďoe  V"]
    rows = frame(spark, [(n,) for n in names], "name string").select("name", clean.identity_key(F.col("name")).alias("a"), clean.identity_end(F.col("name")).alias("b")).collect()
    assert {r.name: (r.a, r.b) for r in rows} == {
        names[0]: ("josepena", "josepena"), names[1]: ("ukaszoneil", "łukaszoneil"), names[2]: ("johnfine", "johnfine"), names[3]: ("", ""), names[4]: ("doe", "doev"),
    }


def test_ranges_of_few_keys(spark):
    rows = frame(spark, [(None if i % 7 == 0 else "a", float(i % 13), i) for i in range(200)], "k string, v double, id int")
    got = {r.id: (r._upto, r._all) for r in ranges.running_total(rows, ["k"], [F.desc("v"), F.col("id")]).collect()}
    want = {}
    for key in (None, "a"):
        own = sorted((-r.v, r.id) for r in rows.collect() if r.k == key)
        want |= {i: (n + 1, len(own)) for n, (_, i) in enumerate(own)}
    assert got == want
    got = agg.exact_percentiles(rows.filter("k = 'a'"), ["k"], "v", {"p10": 0.1, "p90": 0.9}).first()
    assert (got.p10, got.p90) == tuple(rows.filter("k = 'a'").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))).first()[0])


def test_news_in_document_order(spark, tmp_path):
    item = "<item><title>t{0}</title><link>l{0}</link>{1}<pubDate>{2}, 0{0} Sep 2025 10:00:00 GMT</pubDate><source url='u'>s</source></item>"
    body = item.format(1, "<guid>a</guid>", "Mon") + item.format(2, "", "Wed") + item.format(3, "<guid>a</guid>", "Thu") + item.format(4, "<guid>d</guid>", "Sun") + "<item><title>x</title></item>"
    (tmp_path / "n.xml").write_text(f"<rss><channel><title>feed</title>{body}</channel></rss>")
    assert sorted(r.title for r in readers.read_news(spark, str(tmp_path / "n.xml"), 2).collect()) == ["t1", "t2"]


def test_rosters_snaps_and_defences(spark, tmp_path):
    (tmp_path / "r.csv").write_text("season,team,position,full_name,gsis_id,status,pfr_id\n2024,SEA,FB,A,1,ACT,x\n2024,SEA,K,B,2,act,\n")
    assert {(r.player_id, r.position, r.status, r.other_id) for r in readers.read_roster(spark, str(tmp_path / "r.csv")).collect()} == {("1", "RB", "ACT", "x"), ("2", "OTHER", "ACT", None)}
    (tmp_path / "s.csv").write_text("season,game_id,game_type,week,player,pfr_player_id,team,offense_snaps\n2024,g,REG,1,A,x,LA,40\n2024,g,POST,20,A,x,LA,9\n")
    row = readers.read_snap_counts(spark, str(tmp_path / "s.csv")).first()
    assert (row.other_id, row.team, row.snaps) == ("x", "LAR", 40.0)
    player = {"player_id": 7, "name": "A", "position": "D/ST", "team": "sea", "adp": 3.5, "times_drafted": 9, "high": 1, "low": 6, "stdev": 1.0, "bye": 8}
    (tmp_path / "a.json").write_text(json.dumps({"players": [player | {"adp": 9.0}, player | {"player_id": 8}]}))
    assert [(r.source_player_id, r.position) for r in readers.read_adp(spark, str(tmp_path / "a.json")).collect()] == [("8", "DST"), ("7", "DST")]


def test_dated_depth_of_two_seasons(spark, tmp_path):
    (tmp_path / "d.csv").write_text("dt,team,gsis_id,pos_abb,pos_rank\n2024-09-01 00:00:00,SEA,1,QB,1\n2025-09-01 00:00:00,SEA,1,QB,2\n2025-09-02 00:00:00,SEA,2,QB,1\n2025-10-02 00:00:00,SEA,3,QB,1\n")
    cutoffs = frame(spark, [(2024, "2024-09-05"), (2025, "2025-09-04")], "season int, cutoff string").withColumn("cutoff", F.to_date("cutoff"))
    rows = readers.read_opening_depth(spark, {"dated": str(tmp_path / "d.csv")}, cutoffs).collect()
    assert sorted((r.season, r.player_id) for r in rows) == [(2024, "1"), (2025, "2")]


EVIDENCE = {
    "sources": [{"id": "s", "url": "u", "published": "2025-01-02"}],
    "teams": [
        {
            "team": "SEA", "scheme_family": "wide zone", "scheme_continuity": 0.5, "returning_starters_fraction": None,
            "staff": [
                {"name": "H", "roles": ["head coach"], "continuity": "returning_same_role", "influence_weight": 1.0, "is_head_coach": True, "is_play_caller": False},
                {"name": "C", "roles": ["coordinator"], "continuity": "new_to_team", "influence_weight": 1.0, "is_head_coach": False, "is_play_caller": True, "completed_playcalling_seasons": 2.0, "playcaller_confirmation": "reported"},
            ],
            "anchors": [{"team": "DEN", "season": 2024, "weight": 1.0, "reason": "r"}, {"team": "SEA", "season": 2024, "weight": 1.0, "reason": "r"}],
            "claims": [{"id": "c", "source_id": "s", "confidence": 0.5, "certainty_effect": 1.0, "dimensions": ["pace"], "metric_signals": {"pass_rate": 1.0}}],
        }
    ],
    "records": [{"id": "r", "season": 2025, "team": "SEA", "player_id": "p", "metrics": ["m1", "m2"], "finding": "kept", "source_ids": ["s"]}],
}


def test_evidence_environment(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(EVIDENCE))
    tables = readers.read_evidence(spark, str(tmp_path / "e.json"))
    assert {k: v.count() for k, v in tables.items()} == {"sources": 1, "teams": 1, "staff": 2, "anchors": 2, "claims": 1, "claim_signals": 1, "records": 2}
    style = frame(spark, [(2024, "DEN", 0.6), (2024, "SEA", 0.5), (2024, "LAR", 0.4)], "season int, team string, pass_rate double")
    specs = frame(spark, [("pass_rate", "pace", 0.05, 0.0, 1.0)], "metric string, dimension string, tolerance double, low double, high double")
    found = {k: v.first() for k, v in environment.evidence_environment(tables, style, ["pass_rate"], specs).items()}
    # 100 * (0.15 * 0.85 + 0 + 0.15 * 0.4 + 0.10 * 1 + 0.15 * 0.5 + 0.10 * 0.25 + 0.10 * 0.25 + 0.05 * 1)
    assert found["certainty"].structural_score == pytest.approx(46.25)
    spread = (2 / 300) ** 0.5
    assert found["forecasts"].value == pytest.approx(0.55 + 0.20 * spread * 1.0 * 0.5)
    # dispersion: deviation 0.05 equals the tolerance, so nothing is stable
    assert found["forecasts"].certainty == pytest.approx(0.8 * 46.25 + 5)
    assert found["forecasts"].percentile == pytest.approx(2 / 3)
    assert found["styles"].tier == "low_medium"
    wr = environment.position_scores(environment.evidence_environment(tables, style, ["pass_rate"], specs)["forecasts"]).filter("position = 'WR'").first()
    assert (wr.score, wr.coverage, wr.driver) == (pytest.approx(50 + (100 * 2 / 3 - 50) * 0.10), pytest.approx(0.10), "pass_rate")
    te = environment.position_scores(environment.evidence_environment(tables, style, ["pass_rate"], specs)["forecasts"]).filter("position = 'TE'").first()
    assert (te.score, te.label, te.certainty) == (50.0, "unknown", 0.0)
    with pytest.raises(QualityError):
        environment.evidence_environment(tables, style.filter("team <> 'DEN'"), ["pass_rate"], specs)


def test_event_weights_read_only_the_past(spark):
    roles = frame(spark, [(2024, "A", "m", 1, 0.5), (2024, "A", "m", 2, 0.5)], "season int, team string, metric string, player_id int, share double")
    past = [(2023, 1, "A", 1, "m", 10.0, 20.0), (2023, 1, "A", 2, "m", 0.0, 20.0)]
    schema = "season int, week int, team string, player_id int, metric string, high double, base double"
    weights = lambda rows: {(r.model, r.player_id): r.weight for r in evaluations.event_weights(roles, frame(spark, rows, schema)).collect()}
    got = weights(past)
    assert got["base", 1] == 0.5 and got["p12", 1] > got["p24", 1] > got["p48", 1] > 0.5
    rate = lambda x: (x + 24 * 0.25) / (20 + 24) / 0.25
    assert got["p24", 1] == pytest.approx(rate(10) / (rate(10) + rate(0)))
    assert weights([*past, (2024, 1, "A", 2, "m", 50.0, 50.0), (2025, 1, "A", 2, "m", 50.0, 50.0)]) == got


def test_high_value_decision(spark):
    rows = [("m", w, f"t{t}", m, 0.5 if m == "base" else 0.4, 10.0, True, 2024) for w in (4, 8, 18) for t in range(25) for m in ("base", "p12", "p24", "p48")]
    rooms = frame(spark, rows, "metric string, window_end int, team string, model string, total_variation double, events double, top_hit boolean, season int")
    comparisons = evaluations.high_value_comparisons(rooms, samples=200)
    assert comparisons.filter("high < 0").count() == 9
    decision = evaluations.high_value_decisions(rooms, comparisons, min_events=200, min_rooms=20)
    assert decision.first().promoted
    assert not evaluations.high_value_decisions(rooms, comparisons, min_events=300, min_rooms=20).first().promoted
    quality.assert_reproduces(evaluations.high_value_decisions(rooms, comparisons, min_events=200, min_rooms=20), decision)


def test_ownership_states(spark):
    rows = [(1, 1, "add", 7, "me", 0), (1, 2, "add", 8, "you", 1), (1, 3, "drop", 7, None, None), (1, 4, "undo", None, None, None), (1, 5, "undo", None, None, None), (2, 1, "undo", None, None, None)]
    found = forecast.ownership_states(frame(spark, rows, "league_id int, seq int, kind string, player_id int, owner string, slot int"))
    assert [(r.league_id, r.player_id, r.owner, r.slot) for r in found.collect()] == [(1, 7, "me", 0)]
    many = [(1, k, "add", k, "me", 0) for k in range(6)] + [(1, 10 + k, "undo", None, None, None) for k in range(6)]
    found = forecast.ownership_states(frame(spark, many, "league_id int, seq int, kind string, player_id int, owner string, slot int"), history=4)
    assert sorted(r.player_id for r in found.collect()) == [0, 1]


def test_census_rules(spark):
    registry = frame(spark, [("A", "H", "O", "H", "official")], "team string, head_coach string, coordinator string, caller string, confirmation string")
    staff = frame(spark, [("A", "H", "head_coach", "Head Coach"), ("A", "H", "head_coach", "Head Coach/Play Caller"), ("A", "O", "offense", "Offensive Coordinator")], "team string, person string, side string, title string")
    assert forecast.checked_census(registry, staff).first().caller_title == "Head Coach | Head Coach/Play Caller"
    for broken in (staff.filter("side <> 'offense'"), staff.withColumn("team", F.lit("B")), staff.replace("H", "X", ["person"])):
        with pytest.raises(QualityError):
            forecast.checked_census(registry, broken)


def test_active_events_and_opportunities(spark):
    priors = frame(spark, [("A", "m", 1, True, 0.2, 0.3, 0.4), ("A", "m", 2, True, 0.6, 0.3, 0.4), ("A", "m", 3, False, 0.2, 0.4, 0.2)], "team string, metric string, player_id int, active boolean, share_p12 double, share_p24 double, share_p48 double")
    pools = frame(spark, [("A", "m", 10.0, 8.0, 12.0)], "team string, metric string, events double, events_low double, events_high double")
    rows = {r.player_id: r for r in forecast.active_event_counts(priors, pools).collect()}
    assert (rows[1].active_p12, rows[1].events, rows[1].low, rows[1].high) == (pytest.approx(0.25), 5.0, pytest.approx(2.0), pytest.approx(6.0))
    assert rows[3].events == 0.0
    shares = frame(spark, [("A", 1, "R", "p", 0.5, 0.0, 0.5, 1.0)], "team string, week int, resource string, player_id string, mean_share double, p10 double, p50 double, p90 double")
    row = forecast.scenario_opportunities(shares, frame(spark, [("A", "R", 20.0)], "team string, resource string, pool double")).first()
    assert (row.expected, row.opportunities_p10, row.opportunities_p90) == (10.0, 0.0, 20.0)


def test_core_continuity(spark):
    side = lambda *rows: frame(spark, rows, "team string, person string, duty string")
    prior, current = side(("A", "x", "quarterbacks"), ("A", "y", "tight_ends"), ("A", "z", "running_backs")), side(("A", "x", "quarterbacks"), ("A", "n", "tight_ends"), ("A", "n", "pass_game"))
    row = agg.core_continuity(prior, current).first()
    assert (row.comparable, row.retained, row.changed, row.unavailable, row.core_share) == (2, 1, 1, 5, 0.5)
    queue = frame(spark, [("m", "unreviewed"), ("m", "kept"), ("m", agg.INCONCLUSIVE)], "metric string, finding string")
    row = agg.review_outcomes(queue).filter("metric is null").first()
    assert (row.queued, row.reviewed, row.inconclusive, row.resolved, row.unreviewed) == (3, 2, 1, 1, 1) and row.share == pytest.approx(2 / 3)


def test_adp_signal(spark):
    rows = frame(spark, [(None,), (5.0,), (15.0,), (40.0,)], "adp double").select(drafting.adp_signal(F.col("adp"), F.lit(10), F.lit(20)).alias("x")).collect()
    assert [r.x for r in rows] == [0.0, 5.0, 1.0, -8.0]


def test_first_of_a_duplicate_stays(spark, tmp_path):
    (tmp_path / "r.csv").write_text("season,week,team,position,status,full_name,gsis_id,game_type\n2024,1,SEA,WR,RES,Z,1,REG\n2024,1,SEA,WR,ACT,A,1,REG\n")
    kept, review = readers.read_weekly_rosters(spark, str(tmp_path / "r.csv"))
    assert [r.status for r in kept.collect()] == ["RES"] and [r.status for r in review.collect()] == ["ACT"] and kept.columns == review.drop("reason").columns


def test_season_scopes_and_rate_decision(spark):
    from opportunity.plans import backtests

    rows = frame(spark, [(2023, 1.0), (2024, 2.0)], "season int, delta double")
    assert {(r.scope, r.season) for r in backtests.season_scopes(rows).collect()} == {
        ("pooled", 2023), ("pooled", 2024), ("season_2023", 2023), ("season_2024", 2024), ("without_2024", 2023), ("without_2023", 2024),
    }
    rates = frame(spark, [(2024, f"t{t}", w, m, 0.2 if m == "league" else 0.1) for t in range(25) for w in (4, 8, 18) for m in ("league", "p4", "p17")], "target_season int, team string, window_end int, model string, error double")
    found = backtests.rate_comparisons(rates, samples=100)
    assert found.filter("high < 0").count() == 6
    two = rates.withColumn("resource", F.lit("R"))
    two = two.unionByName(two.withColumn("target_season", F.lit(2023)))
    compared = backtests.segment_comparisons(two, 2024, "resource", samples=100)
    decided = backtests.rate_decision(two, compared, 2024, "resource").first()
    assert decided.passed and decided.selected == "p17" and decided.clear_wins == 3  # a tie with p4, to the first name
    with pytest.raises(QualityError):
        forecast.checked_resources(frame(spark, [(0.5, 0.5, 0.2)], "rb_target_share double, wr_target_share double, te_target_share double"), None)
