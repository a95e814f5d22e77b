"""Resampling by keyed hash, and the decisions of the backtests."""

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opportunity import resampling, stats
from opportunity.plans import backtests, evaluations
from opportunity.quality import QualityError


def taken(scope, n, samples, seed=0):
    """The clusters of each sample, drawn the plain way."""
    out = []
    for s in range(samples):
        digits = "".join(hashlib.md5(f"{seed}|{scope}|{s}|{c}".encode()).hexdigest() for c in range((n + 3) // 4))
        out.append([int(digits[8 * j : 8 * j + 8], 16) % n for j in range(n)])
    return np.array(out)


def test_drawn_intervals_equal_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(s, c, float(x)) for s, n in (("a", 9), ("b", 33), ("c", 1)) for c in range(n) for x in rng.normal(c / 10, 1, 1 + c % 4)]
    df = spark.createDataFrame([*rows, ("a", 3, None)], "scope string, cluster int, delta double")
    for pooled in (False, True):
        got = {r.scope: r for r in resampling.paired_cluster_bootstrap(df, "scope", "cluster", "delta", samples=400, seed=5, pooled=pooled).collect()}
        for scope in "abc":
            held = defaultdict(list)
            for _, c, x in (r for r in rows if r[0] == scope):
                held[c].append(x)
            sums, n = np.array([sum(held[c]) for c in sorted(held)]), np.array([len(held[c]) for c in sorted(held)])
            at = taken(scope, len(n), 400, 5)
            means = sums[at].sum(axis=1) / n[at].sum(axis=1) if pooled else (sums / n)[at].mean(axis=1)
            assert [got[scope].low, got[scope].high] == pytest.approx(list(np.percentile(means, [5, 95])))
            assert got[scope].mean_delta == pytest.approx(sums.sum() / n.sum()) and got[scope].clusters == len(n) and got[scope].rows == n.sum()


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_all_resamples_equal_plain(spark, n):
    rng = np.random.default_rng(n)
    rows = [("s", c, float(x)) for c in range(n) for x in rng.normal(size=1 + c % 3)]
    got = resampling.paired_cluster_bootstrap(spark.createDataFrame(rows, "scope string, cluster int, delta double"), "scope", "cluster", "delta", exact_to=7, level=0.95, pooled=True).first()
    sums = np.array([sum(x for _, c, x in rows if c == k) for k in range(n)])
    size = np.array([sum(c == k for _, c, _ in rows) for k in range(n)])
    at = np.array(list(itertools.product(range(n), repeat=n)))
    means = sums[at].sum(axis=1) / size[at].sum(axis=1)
    assert [got.low, got.high] == pytest.approx(list(np.percentile(means, [2.5, 97.5])))


def test_rank_interval_equals_plain(spark):
    rng = np.random.default_rng(2)
    values = [(u, float(rng.integers(0, 6)), float(rng.normal())) for u in range(40)]
    df = spark.createDataFrame([*[("k", *v) for v in values], *[("same", u, 1.0, float(u)) for u in range(5)], ("k", 99, None, 1.0)], "key string, unit int, x double, y double")
    got = {r.key: r for r in resampling.bootstrap_spearman(df, ["key"], ["unit"], "x", "y", samples=200, seed=3).collect()}
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    x, y = np.array([v[1] for v in values]), np.array([v[2] for v in values])
    found = [np.corrcoef(ranks(x[at]), ranks(y[at]))[0, 1] for at in taken("k", 40, 200, 3)]
    assert [got["k"].low, got["k"].high] == pytest.approx(list(np.percentile(found, [2.5, 97.5]))) and got["k"].samples == 200
    assert got["same"].low is None and got["same"].samples == 0  # every sample has constant ranks


WINDOWS = (4, 8, 18)


def gate_inputs(spark, errors, holdout_high=(-0.1, -0.1, -0.1), holdout_delta=(-1.0, -1.0, -1.0)):
    """One metric whose models have the given development errors; comparisons of every challenger alike."""
    ev = [("M", s, w, m, e) for s in ("development", "holdout") for w in WINDOWS for m, e in errors.items()]
    cp = [("M", "development", w, m, e - errors["league"], -0.5, -0.1) for w in WINDOWS for m, e in errors.items() if m != "league"]
    cp += [("M", "holdout", w, m, d, d - 0.5, h) for w, h, d in zip(WINDOWS, holdout_high, holdout_delta, strict=True) for m in errors if m != "league"]
    return spark.createDataFrame(ev, "metric string, segment string, window_end int, model string, error double"), spark.createDataFrame(cp, "metric string, segment string, window_end int, challenger string, mean_delta double, low double, high double")


def test_two_stage_gate(spark):
    def decide(*given, **more):
        return stats.two_stage_gate(*gate_inputs(spark, *given, **more), "league", WINDOWS).first()

    best = {"league": 2.0, "raw": 1.5, "p4": 1.2, "p16": 1.2}
    assert decide(best).candidate == "p16" and decide(best).selected == "p16"  # a tie, to the first name
    assert decide({"league": 1.0, "raw": 1.5, "p4": 1.2}).candidate == "p4"  # chosen although the league is better,
    assert decide({"league": 1.0, "raw": 1.5, "p4": 1.2}).selected == "league"  # and not promoted
    assert decide(best, holdout_high=(-0.1, -0.1, 0.2)).selected == "p16"  # two clear wins are enough
    assert decide(best, holdout_high=(-0.1, 0.1, 0.2)).selected == "league"
    assert decide(best, holdout_delta=(-1.0, -1.0, 0.1)).selected == "league"
    lost = decide(best, holdout_delta=(-1.0, -1.0, 0.9), holdout_high=(-0.1, -0.1, 1.0))
    assert lost.clear_losses == 1 and not lost.passed
    evaluations_, comparisons = gate_inputs(spark, best)
    with pytest.raises(QualityError):
        stats.two_stage_gate(evaluations_.filter("segment = 'holdout'"), comparisons, "league", WINDOWS)


def test_gate_chooses_by_metric_and_calibrates_the_choice(spark):
    rows = [(s, t, r, w, m, f, 10.0) for s in (2023, 2024, 2025) for t in range(12) for w in WINDOWS for r, best in (("A", "raw"), ("B", "league")) for m in ("league", "raw") for f in [10.0 + (0.5 + t / 100 if m == best else 1.0 + t / 100)]]
    df = spark.createDataFrame(rows, "target_season int, team int, resource string, window_end int, model string, forecast double, actual double").withColumn("error", F.abs(F.col("forecast") - F.col("actual")))
    compared = backtests.segment_comparisons(df, 2025, "resource", samples=200)
    assert {r.metric for r in compared.collect()} == {"ALL", "A", "B"}
    decided = {r.metric: r for r in backtests.rate_decision(df, compared, 2025, "resource").collect()}
    assert decided["A"].selected == "raw" and decided["B"].selected == "league" and decided["B"].candidate == "raw"
    held = {r.metric: r for r in backtests.selected_calibration(df, backtests.rate_decision(df, compared, 2025, "resource"), 2025, "resource").collect()}
    assert held["A"].radius == pytest.approx(0.61) and held["A"].rows == 12 and held["A"].rate == 1.0 and held["A"].mean_width == pytest.approx(1.22)


def effects(spark, rows):
    return spark.createDataFrame(rows, "scope string, mean_delta double, high double")


def test_transition_decision(spark):
    good = [(f"{s}|{w}", -1.0, -0.5) for w in (6, 8) for s in ("pooled", "season_2023", "season_2024", "season_2025", "without_2023", "without_2024", "without_2025")]

    def decide(change):
        return backtests.transition_decision(effects(spark, [(s, *change.get(s, (m, h))) for s, m, h in good]), 2025).first()

    assert decide({}).promoted and decide({}).development_below_zero
    open_ = decide({"without_2025|8": (-1.0, 0.1), "season_2023|6": (-0.1, 0.4)})
    assert open_.promoted and not open_.development_below_zero and not open_.leave_one_out_below_zero
    assert not decide({"season_2023|6": (0.1, 0.4)}).promoted
    assert not decide({"pooled|6": (-0.1, 0.0)}).promoted
    assert not decide({"season_2025|8": (-0.1, 0.0)}).promoted
    assert not decide({"season_2025|8": (-0.1, -0.0000001)}).promoted  # rounded to six digits
    assert not backtests.transition_decision(effects(spark, [r for r in good if "2023" not in r[0]]), 2025).first().promoted


def test_transition_effects_take_a_team_over_its_seasons_together(spark):
    rows = [(s, t, 6, "m", m, 1.0 + (0.1 * t if m == "caller_aware" else 0.3 * s % 1)) for s in (2023, 2024, 2025) for t in range(4) for m in ("caller_aware", "shrunken")]
    found, _ = backtests.transition_evaluation(spark.createDataFrame(rows, "season int, team int, window_end int, metric string, model string, error double"), 2025)
    got = {r.scope: r for r in found.collect()}
    delta = {(s, t): 0.1 * t - 0.3 * s % 1 for s in (2023, 2024, 2025) for t in range(4)}
    teams = [[delta[s, t] for s in (2023, 2024, 2025)] for t in range(4)]
    means = [np.mean(sum((teams[t] for t in at), [])) for at in itertools.product(range(4), repeat=4)]
    assert set(got) == {f"{s}|6" for s in ("pooled", *(f"{k}_{y}" for k in ("season", "without") for y in (2023, 2024, 2025)))}
    assert [got["pooled|6"].low, got["pooled|6"].high] == pytest.approx(list(np.percentile(means, [2.5, 97.5]))) and got["pooled|6"].clusters == 4


def test_certainty_decision_needs_all_five_rules(spark):
    base = {"spearman": -0.3, "high": -0.1, "low": 0.95, "middle": 0.93, "top": 0.91, "all": 0.92, "tier_radius": 1.0, "metric_radius": 1.0}

    def decide(**change):
        v = base | change
        ranks = spark.createDataFrame([("broad", "holdout", 8, v["spearman"], v["high"]), ("broad", "development", 8, 0.5, 0.9)], "score_kind string, part string, window_end int, spearman double, high double")
        rows = [("broad", 8, t, v[k], v["tier_radius"], v["metric_radius"]) for t, k in (("low", "low"), ("middle", "middle"), ("high", "top"), ("all", "all")) if v[k] is not None]
        return evaluations.certainty_decision(ranks, spark.createDataFrame(rows, "score_kind string, window_end int, tier string, tier_rate double, tier_radius double, metric_radius double")).first()

    assert decide().promoted
    for change, rule in (({"spearman": 0.1}, "negative"), ({"high": 0.01}, "clear"), ({"middle": 0.89}, "tiers_covered"), ({"all": 0.899}, "all_covered"), ({"tier_radius": 1.01}, "no_wider")):
        found = decide(**change)
        assert not found.promoted and not found[rule] and sum(found[r] for r in ("negative", "clear", "tiers_covered", "all_covered", "no_wider")) == 4
    with pytest.raises(QualityError):
        decide(middle=None)


def test_worst_cases(spark):
    scores = spark.createDataFrame([(2025, t, "returning", 1.0, 2.0) for t in range(9)], "season int, team int, cohort string, broad_low double, exact_low double")
    errors = spark.createDataFrame([(2025, w, t, m, float(t // 2)) for w in (6, 8) for t in range(9) for m in ("a", "b")], "season int, window_end int, team int, metric string, error double")
    got = [(r.window_end, r["rank"], r.team) for r in evaluations.certainty_worst(scores, errors, 2025).orderBy("window_end", "rank").collect()]
    assert got == [(w, i, t) for w in (6, 8) for i, t in enumerate((8, 6, 7, 4, 5), 1)]


def test_a_new_team_takes_the_league_rate(spark):
    rows = [(s, 1, t, "R", 10.0 * t, 1) for s in (2022, 2023) for t in (1, 2)] + [(2024, 1, t, "R", 9.0, 1) for t in (1, 2, 3)]
    df = spark.createDataFrame(rows, "season int, week int, team int, resource string, amount double, games int")
    got = {(r.team, r.model): r.forecast for r in backtests.rate_backtest(df, (2024,), priors=(4,), windows=(4,), keys=["resource"]).collect()}
    assert got[1, "raw"] == pytest.approx(10.0) and [got[3, m] for m in ("league", "raw", "p4")] == pytest.approx([15.0] * 3)
