import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opportunity import quality, stats
from opportunity.functions import clean
from opportunity.operators import aggregates, joins, windows
from opportunity.plans import forecast


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 2 ", 2.0), ("", None), ("x", None), ("NaN", None), ("inf", None), (None, None)])
def test_finite(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(clean.finite(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("TRUE", True), ("0", False), ("maybe", None), ("", None)])
def test_word_bool(spark, text, want):
    assert one(spark, clean.word_bool(F.col("x")), x=text) is want


@pytest.mark.parametrize("name,want", [("D'Andre St. Brown Jr.", "dandrestbrown"), ("José  Núñez III", "josenunez"), ("Ivy", "ivy")])
def test_identity_key(spark, name, want):
    assert one(spark, clean.identity_key(F.col("x")), x=name) == want


def test_snake(spark):
    owners = spark.range(1, 13).select(clean.snake_owner(F.col("id"), F.lit(4)).alias("o")).collect()
    assert [r.o for r in owners] == [0, 1, 2, 3, 3, 2, 1, 0, 0, 1, 2, 3]
    assert one(spark, clean.next_pick(F.col("p"), F.lit(0), F.lit(4)), p=1) == 8


def test_normal_cdf(spark):
    assert one(spark, clean.normal_cdf(F.col("x")), x=1.96) == pytest.approx(0.975, abs=1e-3)


def test_status_family(spark):
    rows = [("ACT", None), ("RES", "R04"), ("RES", "R05"), ("RES", "R99"), ("SUS", ""), ("CUT", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(clean.status_family(F.col("a"), F.col("b")).alias("f"))
    assert [r.f for r in df.collect()] == ["active_53", "return_eligible_reserve", "reserve_nfi", "reserve_other", "exempt_suspended", None]


def test_prior_history_is_strictly_earlier(spark):
    targets = spark.createDataFrame([(1, 2024, "A")], "player_id int, target_season int, team string")
    history = spark.createDataFrame([(1, s, "A" if s > 2021 else "B", 1.0) for s in range(2019, 2026)], "player_id int, season int, team string, x double")
    rows = {r.season: r.weight for r in joins.prior_history(targets, history, 3).collect()}
    assert rows == pytest.approx({2023: 1.0, 2022: 0.65, 2021: 0.65**2 * 0.7})


def test_market_crosswalk(spark):
    roster = spark.createDataFrame([("p1", "a", "SEA", "WR"), ("p2", "b", "SEA", "WR"), ("p3", "c", "LAR", "WR")], "player_id string, name_key string, team string, position string")
    market = spark.createDataFrame([(1, "a", "SEA", "WR"), (2, "c", "SEA", "WR"), (3, "z", "SEA", "WR"), (4, "b", "SEA", "WR"), (5, "b", "SEA", "WR")], "source_id int, name_key string, team string, position string")
    rows = {r.source_id: (r.player_id, r.status) for r in joins.market_crosswalk(market, roster).collect()}
    assert rows == {1: ("p1", "resolved"), 2: (None, "review"), 3: (None, "unmatched"), 4: (None, "review"), 5: (None, "review")}


def test_resolve_identity(spark):
    catalog = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "player_id string, other_id string")
    rows = spark.createDataFrame([("a", None), (None, "x"), (None, "y"), (None, "q"), ("zz", "x"), ("b", "x")], "player_id string, other_id string")
    got = sorted((r.player_id or "", r.other_id or "", r.resolved_id, r.reason) for r in joins.resolve_identity(rows, catalog).collect())
    assert got == [("", "q", None, "unmatched"), ("", "x", "a", None), ("", "y", None, "ambiguous"), ("a", "", "a", None), ("b", "x", "b", "conflict"), ("zz", "x", None, "unknown_id")]


def test_missing_reads_stay_null(spark):
    columns = "season int, week int, team string, receiver_id string, receiver_position string, rusher_id string, rusher_position string, pass int, rush int, yardline_100 double, air_yards double, down int, ydstogo double, qtr int, half_seconds_remaining double, qb_scramble int, goal_to_go int, read_code string"
    play = lambda season: (season, 1, "A", "w", "WR", None, None, 1, 0, 10.0, 12.0, 3, 5.0, 2, 60.0, 0, 0, "0")
    rows = {r.season: r for r in aggregates.player_week_events(spark.createDataFrame([play(2020), play(2022), play(2023)], columns), 2022, 2023).collect()}
    assert rows[2020].read_labeled_targets is None and rows[2022].read_labeled_targets == 1
    assert rows[2022].first_read_targets is None and rows[2023].first_read_targets == 1
    assert (rows[2020].end_zone_targets, rows[2020].two_minute_targets, rows[2020].deep_targets) == (1, 1, 0)
    up = aggregates.team_week_events(aggregates.player_week_events(spark.createDataFrame([play(2020)], columns), 2022, 2023), ["read_labeled_targets"])
    assert up.first().read_labeled_targets is None


def test_conformal_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 20)], "e double").withColumn("k", F.lit(1))
    assert stats.conformal_radius(df, ["k"], "e").first().radius == 18.0  # ceil(20 * 0.9)
    assert stats.conformal_radius(df.filter("e < 4"), ["k"], "e").first().radius == 3.0


def test_exact_bootstrap_and_independent_scopes(spark):
    rows = [("a", c, float(c)) for c in range(4)] + [("b", c, -1.0 - c / 10) for c in range(9)]
    df = spark.createDataFrame(rows, "scope string, cluster int, delta double")
    got = {r.scope: r for r in stats.paired_cluster_bootstrap(df, "scope", "cluster", "delta", samples=300, exact_to=7).collect()}
    means = [np.mean(x) for x in itertools.product(range(4), repeat=4)]
    assert got["a"].low == pytest.approx(np.percentile(means, 5)) and got["b"].interpretation == "lower_error"
    alone = stats.paired_cluster_bootstrap(df.filter("scope = 'b'"), "scope", "cluster", "delta", samples=300).first()
    assert alone.low == got["b"].low


def test_oracle_allocation_reconciles(spark):
    weights = spark.createDataFrame([("t", "a", 0.7), ("t", "b", 0.3)], "team string, player_id string, weight double")
    active = spark.createDataFrame([("t", 1, "a"), ("t", 2, "a"), ("t", 2, "b")], "team string, week int, player_id string")
    pools = spark.createDataFrame([("t", w, 10.0) for w in (1, 2, 3)], "team string, week int, pool double")
    out = stats.oracle_allocation(weights, active, pools, ["team"])
    rows = {(r.week, r.player_id): r.allocated for r in out.collect()}
    assert rows == pytest.approx({(1, "a"): 10.0, (2, "a"): 7.0, (2, "b"): 3.0, (3, "__UNALLOCATED__"): 10.0})
    assert quality.reconcile(out, pools, ["team", "week"], "allocated", "pool").agg(F.max("error")).first()[0] == pytest.approx(0)


def test_shares_of_latent_roles_sum_to_one(spark):
    everyone = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.3), ("t", "c", 0.2)], "team string, player_id string, share double")
    active = spark.createDataFrame([("t", "a", 0.6), ("t", "b", 0.4)], "team string, player_id string, active_share double")
    rows = {r.player_id: r.latent for r in forecast.latent_roles(active, everyone, ["team"]).collect()}
    assert rows == pytest.approx({"a": 0.48, "b": 0.32, "c": 0.2})


def test_role_priors_reconcile(spark):
    rooms = spark.createDataFrame([("A", "RB_CARRIES", "RB", "x", 1), ("A", "RB_CARRIES", "RB", "y", 2), ("A", "RB_CARRIES", "RB", "z", None)], "team string, resource string, position string, player_id string, depth_rank int")
    history = spark.createDataFrame([("x", "A", 0.6, 20.0, True), ("y", "A", 0.2, 10.0, False)], "player_id string, team string, share double, weighted_games double, same_team boolean")
    pools = spark.createDataFrame([("A", "RB_CARRIES", 25.0)], "team string, resource string, pool double")
    out = forecast.role_priors(rooms, history, pools)
    assert out.agg(F.sum("share")).first()[0] == pytest.approx(1) and out.agg(F.sum("opportunities")).first()[0] == pytest.approx(25)
    assert out.filter("player_id = 'x'").first().evidence_label == "strong_role_evidence"


def test_scenarios_share_draws_and_reconcile(spark):
    roles = spark.createDataFrame([("t", r, p, w) for r in ("R1", "R2") for p, w in (("a", 0.7), ("b", 0.3))], "team string, resource string, player_id string, weight double")
    availability = spark.createDataFrame([("t", 1, "a", 0.5), ("t", 1, "b", 0.4)], "team string, week int, player_id string, p double")
    out = forecast.role_scenarios(roles, availability, 50, 3)
    assert {r.s for r in out.groupBy("resource").agg(F.round(F.sum("mean_share"), 9).alias("s")).collect()} == {1.0}
    rows = {(r.resource, r.player_id): r.active_draws for r in out.collect()}
    assert all(rows["R1", p] == rows["R2", p] for p in ("a", "b", "__UNALLOCATED__"))


def test_resource_forecasts(spark):
    schema = "team string, plays_per_game double, pass_rate double, qb_scramble_rate double, designed_qb_run_share double, rb_target_share double, wr_target_share double, te_target_share double"
    style = spark.createDataFrame([("A", 60.0, 0.6, 0.05, 0.1, 0.2, 0.5, 0.2), ("B", 60.0, 0.6, 0.05, 0.1, 0.4, 0.6, 0.2)], schema)
    factors = spark.createDataFrame([(0.9, 0.8, 1.0)], "qb_dropbacks_per_pass_play double, target_per_pass_play double, rb_carries_per_non_qb_rush_play double")
    rows = {(r.team, r.resource): r.pool for r in forecast.resource_forecasts(style, factors).collect()}
    assert rows["A", "QB_DROPBACKS"] == pytest.approx(32.4) and rows["A", "QB_RUSH_OPPORTUNITIES"] == pytest.approx(4.2) and rows["A", "RB_CARRIES"] == pytest.approx(21.6)
    assert sum(rows["A", f"{p}_TARGETS"] for p in ("RB", "WR", "TE")) == pytest.approx(28.8 * 0.9)
    assert rows["B", "WR_TARGETS"] is None  # shares far above one


def test_survival_falls_with_the_pick(spark):
    df = spark.createDataFrame([(float(p), 30.0, 4.0, 20, 45, 200) for p in range(10, 60, 5)], "pick double, adp double, stdev double, high int, low int, drafts int")
    got = [r.survival for r in forecast.survival_estimates(df, F.col("pick")).orderBy("pick").collect()]
    assert got == sorted(got, reverse=True) and 0.005 <= got[-1] < got[0] <= 0.995


def test_ownership_replay_matches_a_stack(spark):
    rng, rows, stack = random.Random(4), [], []
    for seq in range(200):
        kind = rng.choice(["add", "add", "drop", "undo"])
        player, owner = rng.randrange(6), rng.randrange(4)
        rows.append((1, seq, kind, player, owner))
        if kind == "undo":
            stack and stack.pop()
        else:
            stack.append((kind, player, owner))
    want = {}
    for kind, player, owner in stack:
        want.pop(player, None)
        if kind == "add":
            want[player] = owner
    out = forecast.ownership_replay(spark.createDataFrame(rows, "league_id int, seq int, kind string, player_id int, owner int"))
    assert {r.player_id: r.owner for r in out.collect()} == want


def test_multiplier(spark):
    events = spark.createDataFrame([("p", 2023, "A", 10.0, 20.0)], "player_id string, season int, team string, high double, base double")
    teams = spark.createDataFrame([(2023, "A", 20.0, 100.0)], "season int, team string, team_high double, team_base double")
    targets = spark.createDataFrame([("p", 2024, "A"), ("p", 2025, "B")], "player_id string, target_season int, team string")
    rows = {r.target_season: r for r in stats.shrunk_rate_multiplier(events, teams, targets, 2).collect()}
    raw = (10 + 12 * 0.2) / (20 + 12) / 0.2
    assert rows[2024].p12 == pytest.approx(raw)
    w = 0.65 * 0.7
    moved = (10 * w + 12 * 0.2) / (20 * w + 12) / 0.2
    assert rows[2025].p12 == pytest.approx(1 + 0.45 * (moved - 1))


def test_promotion_gate(spark):
    ev = [("m", w, model, e, 500, 40) for w in (4, 8, 18) for model, e in (("base", 0.3), ("p12", 0.29), ("p24", 0.28))]
    evaluations = spark.createDataFrame(ev, "metric string, window_end int, model string, error double, events int, rooms int")
    comparisons = spark.createDataFrame([("m", 4, "p24", -0.1, -0.01), ("m", 8, "p24", -0.1, -0.01), ("m", 18, "p24", -0.1, 0.01)], "metric string, window_end int, challenger string, low double, high double")
    gate = lambda need: stats.promotion_gate(evaluations, comparisons, "base", "p24", (4, 8, 18), need, 10).first()
    assert gate(100).promoted and gate(100).best_model == "p24" and not gate(10_000).promoted


def test_checks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None)], "k int, v double")
    with pytest.raises(quality.QualityError):
        quality.assert_unique(df, ["k"])
    with pytest.raises(quality.QualityError):
        quality.assert_range(df, {"v": F.col("v") > 0})
    with pytest.raises(quality.QualityError):
        quality.assert_rule(df, F.col("v") > 0, "v")
    assert quality.same_rows(df, df.orderBy(F.desc("v"))) and not quality.same_rows(df, df.limit(1))


def test_ties_in_ranks(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 9.0), ("h", 4, 1.0)], "g string, id int, v double")
    assert {r.id: r.percentile for r in windows.average_rank_percentile(df, ["g"], "v").collect()} == {1: 0.25, 2: 0.25, 3: 1.0, 4: 0.5}
    assert {r.id: r.percentile for r in windows.cume_percentile(df, ["g"], "v").collect()} == pytest.approx({1: 200 / 3, 2: 200 / 3, 3: 100, 4: 100})


def test_no_python_in_builtin_plans(spark):
    df = spark.createDataFrame([("g", 1, 5.0)], "g string, id int, v double")
    plan = windows.cume_percentile(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_places_in_several_orders_are_written_once(spark, monkeypatch):
    from opportunity.operators import ranges

    writes = []
    plain = ranges.stored
    monkeypatch.setattr(ranges, "stored", lambda df, name: writes.append(name) or plain(df, name))
    rows = [(k, k * 7 % 31, k % 3, None if k % 11 == 0 else f"v{k * 5 % 13:02}") for k in range(200)]
    df = spark.createDataFrame(rows, "id int, x int, g int, v string")
    got = ranges.places_in(df.repartition(3), {"by_x": ([], [("x", False), ("id", True)]), "in_g": (["g"], [("v", True), ("id", False)]), "same": ([], [("id", True)])})
    assert got.columns == ["id", "x", "g", "v", "by_x", "in_g", "same"] and writes == ["places"]
    by_x = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    in_g = {r[0]: n for g in range(3) for n, r in enumerate(sorted((r for r in rows if r[2] == g), key=lambda r: (r[3] is not None, r[3] or "", -r[0])), 1)}
    assert {r.id: (r.x, r.g, r.v, r.by_x, r.in_g, r.same) for r in got.collect()} == {k: (x, g, v, by_x[k], in_g[k], k + 1) for k, x, g, v in rows}
    assert ranges.places_in(df.limit(0), {"a": ([], [("id", True)])}).collect() == []
