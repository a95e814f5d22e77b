"""Queries over the driver's tables for drafts, seasons and whole forecast jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from opportunity.driver_evaluations import ORACLE_SQL, QUERIES
from opportunity.driver_queries import BOARD_SQL, WEEKLY_SQL, _read, as_double, board, query, weekly
from opportunity.operators import joins, windows
from opportunity.plans import drafting, forecast

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(
    "f15_draft_board",
    BOARD_SQL + ", r as (select player_id, position, 1 + size as adp, case when position <> 'K' then points end as opportunity, case when size % 3 <> 0 then size * 2.0 end as high_value, size * 1.5 as environment, case when size % 4 <> 0 then 60.0 end as evidence from board), "
    "o as (select player_id, case when count(*) over (partition by position) = 1 then 50.0 else round(100.0 * (row_number() over (partition by position order by opportunity, player_id) - 1) / (count(*) over (partition by position) - 1), 1) end as pc from r where opportunity is not null), "
    "s as (select r.*, round(100 - 0.35 * (adp - 1) + case when pc is not null then 0.08 * (pc - 50) + 0.04 * (coalesce(high_value, 50) - 50) + 0.03 * (environment - 50) + 0.015 * (coalesce(evidence, 50) - 50) else 0 end, 2) as score from r left join o using (player_id)), "
    "k as (select *, row_number() over (order by adp, player_id) as adp_rank, row_number() over (order by score desc, adp, player_id) as model_rank, row_number() over (partition by position order by score desc, adp, player_id) as position_rank from s) "
    "select player_id, position, adp_rank, position_rank, 1 + (position_rank > case when position in ('QB', 'TE') then 5 when position = 'K' then 8 else 12 end)::int + (position_rank > case when position in ('QB', 'TE') then 12 when position = 'K' then 16 else 30 end)::int + (position_rank > case position when 'RB' then 50 when 'WR' then 55 when 'K' then 24 else 20 end)::int as tier from k",
)
def f15_draft_board(spark, sf_dir):
    rows = board(spark, sf_dir).selectExpr("player_id", "position", "1 + size as adp", "case when position <> 'K' then points end as opportunity", "case when size % 3 <> 0 then size * 2.0D end as high_value", "size * 1.5D as environment", "case when size % 4 <> 0 then 60.0D end as evidence")
    return drafting.draft_board(rows).select("player_id", "position", "adp_rank", "position_rank", "tier")


STRATEGY = {"vorp_weight": 1.0, "starter_need_weight": 0.3, "late_need_boost": 0.5, "scarcity_weight": 0.4, "position_run_boost": 0.25, "adp_weight": 0.8, "long_turn_adp_boost": 0.5, "analytics_weight": 12.0, "qb_variance_penalty": 4.0, "upside_weight": 0.1, "downside_weight": 0.15, "specialist_round": 12, "early_specialist_penalty": 6.0}
F17_SQL = BOARD_SQL + (
    ", p as (select size % 3 as league_id, player_id, position, points, points - size as floor, points + 2 * size as ceiling, case when size % 5 <> 0 then (size * 4)::double end as adp, (size % 11) / 10.0 as o, (size % 7) / 10.0 as pv, case player_id % 3 when 0 then 'starter' when 1 then 'flex' else 'bench' end as status, (size % 4) / 4.0 as run, size % 3 as surplus, size % 2 as same_bye from board), "
    "lg as (select unnest([0, 1, 2]) as league_id, 10 as teams, 15 as rounds, unnest([5, 48, 91]) as current, unnest([16, 53, 110]) as following), lv as (select league_id, position, least(20, count(*)) as demand, quantile_disc(points, 0.6) as replacement from p group by all), "
    "t as (select *, sum(demand) over (partition by league_id) as dall from lv), k as (select p.*, teams, rounds, current, following, demand, replacement, greatest(1, ceil((following - current) * demand / dall::double)) as k, row_number() over (partition by p.league_id, position order by points desc, player_id) as pl, count(*) over (partition by p.league_id, position) as n from p join lg using (league_id) join t using (league_id, position)), "
    "d as (select a.*, greatest(0, a.points - b.points) as sc from k a join k b on a.league_id = b.league_id and a.position = b.position and b.pl = least(a.n, a.pl + a.k)), "
    "x as (select *, points - replacement as vorp, greatest(0, points - replacement) as ab, ceil(current / 10.0) as turn, case position when 'QB' then 0.52 * 0.18 * (pv - 0.5) + 0.48 * 0.18 * (o - 0.5) when 'RB' then 0.45 * 0.33 * (o - 0.5) when 'K' then 0 else 0.55 * 0.30 * (pv - 0.5) + 0.45 * 0.32 * (o - 0.5) end - 0.35 * 0.1 as ctx from d), "
    "y as (select *, vorp * 1.0 as vorp_term, case status when 'starter' then ab when 'flex' then 0.65 * ab else -greatest(2, 0.12 * ab) end * 0.3 * case when status in ('starter', 'flex') then 1 + 0.5 * least(1, (turn - 1) / 14.0) else 1 end as need_term, sc * 0.4 * (1 + 0.25 * run) as scarcity_term, "
    "case when adp is null then 0 when adp <= current then least(8, 2 + 6 * (current - adp) / greatest(1, following - current)) when adp <= following then 2 * (following - adp) / greatest(1, following - current) else -least(8, 6 * (adp - following) / greatest(1, following - current)) end * 0.8 * (1 + 0.5 * least(1, greatest(0, (following - current - 1) / 10.0))) as adp_term, "
    "ctx * 12 + case when position = 'QB' then (0.5 - 0.4) * 4 else 0 end as context_term, (ceiling - points) * 0.1 * case when status = 'bench' then 1.2 else 1 end - (points - floor) * 0.15 as range_term, "
    "-case when position = 'K' and turn < 12 then (12 - turn) * 6.0 else 0 end - case when status = 'bench' then 2.0 * surplus else 0 end - 1.5 * same_bye as penalty_term from x)"
)


@query("f17_draft_scores", F17_SQL + " select league_id, player_id, " + ", ".join(f"round({t}, 4) + 0.0 as {t}" for t in ("vorp_term", "need_term", "scarcity_term", "adp_term", "context_term", "range_term", "penalty_term")) + " from y")
def f17_draft_scores(spark, sf_dir):
    players, leagues = f17_inputs(spark, sf_dir)
    levels = players.groupBy("league_id", "position").agg(F.least(F.lit(20), F.count("*")).alias("demand"), F.expr("percentile_disc(0.6) within group (order by points)").alias("replacement"))
    scored = drafting.draft_scores(players, leagues, levels, STRATEGY)
    terms = [c for c in scored.columns if c.endswith("_term")]
    return scored.select("league_id", "player_id", *[(F.round(t, 4) + 0.0).alias(t) for t in terms])


def f17_inputs(spark, sf_dir):
    rating = {n: F.lit(None).cast("double") for parts in (*(p for c in drafting.CONTEXT.values() for p in c[:2]), drafting.OTHER_CONTEXT) for n in parts}
    rating |= {"opportunity_rating": F.expr("(size % 11) / 10"), "pass_volume_rating": F.expr("(size % 7) / 10")}
    context = drafting.context_signal(rating, F.col("position"), F.lit(0.1))
    players = board(spark, sf_dir).withColumn("context", context).selectExpr(
        "size % 3 as league_id", "player_id", "position", "points", "points - size as floor", "points + 2 * size as ceiling", "case when size % 5 <> 0 then cast(size * 4 as double) end as adp", "context", "0.4D as variance",
        "case player_id % 3 when 0 then 'starter' when 1 then 'flex' else 'bench' end as status", "(size % 4) / 4 as run", "size % 3 as surplus", "size % 2 as same_bye",
    )
    leagues = spark.createDataFrame([(0, 10, 15, 5, 16), (1, 10, 15, 48, 53), (2, 10, 15, 91, 110)], "league_id int, teams int, rounds int, current int, following int")
    return players, leagues


@query(
    "f18_adjusted_survival",
    BOARD_SQL + ", b as (select player_id, size * 1.0 as adp, size / 5.0 as stdev, size * 0.5 as high, size * 1.5 as low, size * 3 as drafts, 0.5 + size % 10 / 10.0 as pressure from board), "
    "z as (select *, greatest(1, stdev) as dv, greatest(1, high) as tp, greatest(greatest(1, high), low) as bt from b), "
    "c as (select *, unnest([0, 1, 2]) as w, unnest([30 - 0.5 - adp, tp - 0.5 - adp, bt + 0.5 - adp]) / dv as x from z), "
    "e as (select *, abs(x) / sqrt(2) as az, 1 / (1 + 0.3275911 * abs(x) / sqrt(2)) as t from c), f as (select *, 0.5 * (1 + sign(x) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-az * az))) as cdf from e), "
    "g as (select player_id, any_value(drafts) as drafts, any_value(pressure) as pressure, max(case when w = 0 then cdf end) as a, max(case when w = 1 then cdf end) as l, max(case when w = 2 then cdf end) as u from f group by player_id), "
    "h as (select *, least(0.995, greatest(0.005, drafts / (drafts + 50.0) * least(1, greatest(0, (u - a) / greatest(1e-6, u - l))) + (1 - drafts / (drafts + 50.0)) * (1 - a))) as s from g) select player_id, round(least(0.995, greatest(0.005, power(s, pressure))), 5) as survival from h",
)
def f18_adjusted_survival(spark, sf_dir):
    rows = board(spark, sf_dir).selectExpr("player_id", "size * 1.0D as adp", "size / 5 as stdev", "size * 0.5D as high", "size * 1.5D as low", "size * 3 as drafts", "0.5D + size % 10 / 10 as pressure")
    return drafting.adjusted_survival(rows, F.lit(30)).select("player_id", F.round("survival", 5).alias("survival"))


@query(
    "f20_tier_outlook",
    BOARD_SQL + ", b as (select player_id, position, 1 + size % 6 as tier, points as score, size % 30 as picks, 0.5 + size % 10 / 10.0 as pressure, size * 2 as survival from board), t as (select position, tier, count(*) as remaining, min(score) as fl, max(score) as bs from b group by all), "
    "n as (select position, tier, remaining, fl, lead(bs) over (partition by position order by tier) as nx from t), p as (select *, lead(player_id) over (partition by position order by tier, score desc, player_id) as fallback from b), "
    "q as (select p.player_id, position, tier, remaining, greatest(1, ceil(picks * case position when 'QB' then 0.1 when 'RB' then 0.3 when 'WR' then 0.4 when 'TE' then 0.1 else 0.1 end * pressure))::bigint as expected_picks, coalesce(greatest(0, fl - nx), 0) as dp, fallback, survival from p join n using (position, tier)) "
    "select player_id, position, tier, remaining, expected_picks, round(dp, 4) + 0.0 as \"drop\", fallback, case when survival <= 25 or (expected_picks >= remaining and dp >= 1) then 'critical' when survival <= 50 or expected_picks >= remaining then 'warning' else 'safe' end as level from q",
)
def f20_tier_outlook(spark, sf_dir):
    rows = board(spark, sf_dir).selectExpr("player_id", "position", "1 + size % 6 as tier", "points as score", "size % 30 as picks", "0.5D + size % 10 / 10 as pressure", "size * 2 as survival")
    found = drafting.tier_outlook(rows, {"QB": 0.1, "RB": 0.3, "WR": 0.4, "TE": 0.1, "K": 0.1})
    return found.withColumn("drop", F.round("drop", 4) + 0.0)


F14_SQL = WEEKLY_SQL + (
    ", u as (select *, (player_id * week % 10)::double as ts from weekly), s as (select player_id, any_value(position) as position, avg(case when week > 9 then volume end) as late, avg(case when week <= 9 then volume end) as early, avg(case when week > 9 then ts end) as ls, coalesce(avg(case when week > 9 then volume end), 0) - coalesce(avg(case when week <= 9 then volume end), 0) as tr from u group by player_id), "
    "v as (select player_id, 100.0 * count(*) over (partition by position order by late) / count(*) over (partition by position) as pv, 100.0 * count(*) over (partition by position order by ls) / count(*) over (partition by position) as ps from s where late is not null), "
    "w as (select player_id, 100.0 * count(*) over (partition by position order by tr) / count(*) over (partition by position) as pt from s where late is not null and early is not null), "
    "x as (select s.*, case when position in ('WR', 'TE') and ps is not null then (pv + ps) / 2 else pv end as lv, pt from s left join v using (player_id) left join w using (player_id)), y as (select player_id, position, case when late is null then 0.0 else 0.7 * lv + 0.3 * coalesce(pt, lv) end as score, late is null as un from x), "
    "o as (select league_id, player_id, player_id % 2 = league_id as mine from (select player_id from y where position <> 'QB'), (select unnest([0, 1]) as league_id)), m as (select league_id, position, arg_min(score, (un, score, player_id)) as bs, arg_min(player_id, (un, score, player_id)) as bp from o join y using (player_id) where mine group by all) "
)


@query(
    "f14_season_board",
    F14_SQL + "select l.league_id, y.player_id, y.position, round(score, 4) as score, round(score - coalesce(bs, 0), 4) + 0.0 as delta, case when o.mine is null then 'waiver' else 'trade' end as list, bp as compare_with, case when un then 'unavailable' when bp is null then 'empty_position' when score - coalesce(bs, 0) > 0 then 'upgrade' else 'depth_only' end as reason "
    "from y cross join (select unnest([0, 1]) as league_id) l left join o on o.league_id = l.league_id and o.player_id = y.player_id left join m on m.league_id = l.league_id and m.position = y.position where o.mine is null or not o.mine",
)
def f14_season_board(spark, sf_dir):
    rows = weekly(spark, sf_dir).withColumn("target_share", F.expr("cast(player_id * week % 10 as double)"))
    positions = rows.select("player_id", "position").distinct()
    trends = windows.half_season_trend(rows, 18).join(positions, "player_id")
    scores = drafting.season_scores(trends)
    owners = scores.filter("position <> 'QB'").select("player_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("league_id")).withColumn("mine", F.col("player_id") % 2 == F.col("league_id"))
    found = drafting.season_board(scores, owners)
    return found.withColumn("score", F.round("score", 4)).withColumn("delta", F.round("delta", 4) + 0.0)


F1_TEAMS = {"team": "c_custkey", "same": "c_custkey % 5 = 0", "moved": "c_custkey % 5 = 1", "on_prior_staff": "c_custkey % 5 = 2", "episodes": "c_custkey % 7 = 0", "destination_continuity": "(c_custkey % 11) / 10.0", "identity": "(c_custkey % 4) / 4.0", "scheme_identity": "(c_custkey % 3) / 2.0", "staff": "(c_nationkey % 5) / 5.0", "head_coach_kept": "c_custkey % 2 = 0"}
F1_SQL = (
    f"with tm0 as (select {', '.join(f'({e})::double as {c}' if '.0' in e else f'{e} as {c}' for c, e in F1_TEAMS.items())} from customer), "
    "an as (select team, season, 1999 - season as age, unnest(['pass_rate', 'plays_per_game']) as metric, unnest([pr, pg]) as value from (select o_custkey as team, year(o_orderdate) as season, avg((o_orderstatus = 'F')::int) as pr, avg(o_totalprice) / 1000 as pg from orders where year(o_orderdate) < 1999 group by all)), "
    "de as (select c_custkey as team, m as metric, case m when 'pass_rate' then (c_custkey % 10) / 10.0 else 50 + c_custkey % 20 end::double as value from customer, (select unnest(['pass_rate', 'plays_per_game']) as m)), "
    "tm as (select tm0.*, coalesce(n, 0) as anchors from tm0 left join (select team, count(distinct season) as n from an group by 1) using (team)), ca as (select *, case when same then 'same' when moved then 'moved' when on_prior_staff and anchors > 0 then 'staff_with_anchors' when on_prior_staff then 'staff' when anchors > 0 then 'anchors' when destination_continuity >= 0.75 then 'new_high_continuity' when destination_continuity >= 0.5 then 'new_half_continuity' else 'new' end as cs from tm), "
    "wt as (select * from (values ('same', 1.0, 0.65, 0.30, 0.05), ('moved', 0.75, 0.70, 0.20, 0.10), ('staff_with_anchors', 0.65, 0.40, 0.50, 0.10), ('staff', 0.60, 0.0, 0.80, 0.20), ('anchors', 0.50, 0.65, 0.20, 0.15), ('new_high_continuity', null, 0.0, 0.8, 0.2), ('new_half_continuity', null, 0.0, 0.6, 0.4), ('new', null, 0.0, 0.35, 0.65)) as t(cs, cc, a, b, c)), "
    "mn as (select team, metric, sum(value * power(0.75, age)) / sum(power(0.75, age)) as fp, count(*) as n from an group by all), md as (select team, metric, sum(abs(value - fp) * power(0.75, age)) / sum(power(0.75, age)) as mad from an join mn using (team, metric) group by all), "
    "st as (select team, metric, fp, n, case when n = 1 then 0.45 else 1 / (1 + mad / case metric when 'pass_rate' then 0.05 else 5.0 end) end as sb from mn join md using (team, metric)), "
    "sg as (select team, least(1, sum(power(0.75, age)) / 2.2) as s from (select distinct team, season, age from an) group by 1), ov as (select team, avg(sb) as o from st group by 1), "
    "sc as (select ca.*, coalesce(cc::double, case when episodes then 0.35 else 0.15 end) as cc, a::double as a, b::double as b, c::double as c, coalesce(s, 0) as s, coalesce(o, 0.20) as o from ca join wt using (cs) left join sg using (team) left join ov using (team)), "
    "ex as (select *, 100 * (0.20 * identity + 0.45 * scheme_identity + 0.15 * s + 0.10 * destination_continuity + 0.05 * staff + 0.05 * head_coach_kept::int) as broad, 100 * (0.10 * identity + 0.15 * cc + 0.18 * s + 0.12 * staff + 0.08 * head_coach_kept::int + 0.12 * o + 0.15 * destination_continuity + 0.10 * scheme_identity) as e0 from sc), "
    "lg as (select metric, median(value) as l from de group by 1), jn as (select ex.*, de.metric, de.value as d, fp, n, sb, l, case when same then e0 else least(79.0, e0) end as exact from ex join de using (team) left join st using (team, metric) join lg using (metric)), "
    "bl as (select *, (coalesce(fp * a, 0) + d * b + l * c) / (case when fp is not null then a else 0 end + b + c) as bb from jn)"
)


@query(
    "f1_caller_forecasts",
    F1_SQL + " select team, metric, cs as \"case\", coalesce(n, 0) as anchors, round(coalesce(sb, 0.20), 5) as stability, round(case metric when 'pass_rate' then least(1.0, greatest(0.0, bb)) else bb end, 5) as forecast, round(broad, 3) as broad, round(exact, 3) as exact, round(0.7 * exact + 30 * coalesce(sb, 0.20), 3) as certainty from bl",
)
def f1_caller_forecasts(spark, sf_dir):
    metrics = F.explode(F.array(F.lit("pass_rate"), F.lit("plays_per_game"))).alias("metric")
    orders = _read(spark, sf_dir, "orders").filter(F.year("o_orderdate") < 1999)
    seen = orders.groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("season")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("pass_rate"), (F.avg("o_totalprice") / 1000).alias("plays_per_game"))
    anchors = seen.unpivot(["team", "season"], ["pass_rate", "plays_per_game"], "metric", "value").withColumn("age", 1999 - F.col("season"))
    customers = _read(spark, sf_dir, "customer")
    teams = customers.selectExpr(*[f"{e.replace('.0', '')} as {c}" for c, e in F1_TEAMS.items()])
    teams = teams.join(seen.groupBy("team").agg(F.count("*").alias("anchors")), "team", "left").fillna(0, ["anchors"])
    destination = customers.select(F.col("c_custkey").alias("team"), metrics).withColumn("value", F.expr("case metric when 'pass_rate' then (team % 10) / 10 else 50D + team % 20 end"))
    specs = spark.createDataFrame([("pass_rate", 0.05, 0.0, 1.0), ("plays_per_game", 5.0, None, None)], "metric string, tolerance double, low double, high double")
    found = forecast.caller_style_forecasts(teams, anchors, destination, specs)
    return found.select("team", "metric", "case", "anchors", *[F.round(c, 5).alias(c) for c in ("stability", "forecast")], *[F.round(c, 3).alias(c) for c in ("broad", "exact", "certainty")])


@query(
    "f2_position_outlook",
    "with m as (select c_custkey as team, 50 + c_custkey % 37 as plays, 0.4::double + (c_custkey % 29) / 100 as pr, (c_custkey % 23) / 23 as np, (c_custkey % 19) / 19 as pa, 5 + (c_custkey % 17) / 4 as ay, (c_custkey % 13) / 50 as rb, 0.4::double + (c_custkey % 11) / 50 as wr, (c_custkey % 7) / 30 as te from customer), "
    "l as (select team, unnest(['plays', 'pass_plays', 'rush_plays', 'neutral_pass', 'play_action', 'air_yards', 'rb_share', 'wr_share', 'te_share']) as f, unnest([plays::double, plays * pr, plays * (1 - pr), np, pa, ay, rb, wr, te]) as v from m), "
    "r as (select team, f, (rank() over (partition by f order by v) - 1 + (count(*) over (partition by f, v) - 1) / 2.0) / (count(*) over (partition by f) - 1) as p from l), "
    "w as (select * from (values ('QB', 'pass_plays', 0.55), ('QB', 'neutral_pass', 0.20), ('QB', 'air_yards', 0.15), ('QB', 'play_action', 0.10), ('RB', 'rush_plays', 0.55), ('RB', 'rb_share', 0.35), ('RB', 'plays', 0.10), ('WR', 'pass_plays', 0.50), ('WR', 'wr_share', 0.35), ('WR', 'air_yards', 0.15), ('TE', 'pass_plays', 0.40), ('TE', 'te_share', 0.60)) as t(position, f, wt)), "
    "s as (select team, position, 100 * sum(wt::double * p) as score from r join w using (f) group by all) select team, position, round(score, 3) as score, case when score >= 80 then 'strongly_favorable_opportunity' when score >= 65 then 'favorable_opportunity' when score > 35 then 'neutral_opportunity' when score > 20 then 'unfavorable_opportunity' else 'strongly_unfavorable_opportunity' end as label from s",
)
def f2_position_outlook(spark, sf_dir):
    columns = {"plays_per_game": "cast(50 + c_custkey % 37 as double)", "pass_rate": "0.4D + (c_custkey % 29) / 100", "neutral_early_down_pass_rate": "(c_custkey % 23) / 23", "play_action_rate": "(c_custkey % 19) / 19", "mean_air_yards": "5 + (c_custkey % 17) / 4", "rb_target_share": "(c_custkey % 13) / 50", "wr_target_share": "0.4D + (c_custkey % 11) / 50", "te_target_share": "(c_custkey % 7) / 30"}
    wide = _read(spark, sf_dir, "customer").selectExpr("c_custkey as team", *[f"{e} as {n}" for n, e in columns.items()])
    found = forecast.position_outlook(wide.unpivot("team", list(columns), "metric", "forecast"))
    return found.select("team", "position", F.round("score", 3).alias("score"), "label")


@query(
    "f8_availability_inputs",
    "with p as (select c_custkey as player_id, c_nationkey as team, c_custkey % 150 + 20 as trials from customer), g as (select s_nationkey as team, s_suppkey % 6 + 1 as week from supplier group by all), m as (select c_custkey as player_id, 3 as mm from customer where c_custkey % 4 = 0), x as (select p.*, w.week, mm, g.week is null as bye from p cross join (select unnest([1, 2, 3, 4, 5, 6]) as week) w left join g on g.team = p.team and g.week = w.week left join m using (player_id)) "
    "select player_id, week, bye, mm::double as min_missed, case when trials >= 150 then 'strong' when trials >= 30 then 'moderate' else 'weak' end as support, case when coalesce(week <= mm, false) and bye then 'rule_minimum_and_bye' when coalesce(week <= mm, false) then 'rule_minimum_absence' when bye then 'scheduled_bye' else '' end as \"constraint\" from x",
)
def f8_availability_inputs(spark, sf_dir):
    players = _read(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "c_nationkey as team", "c_custkey % 150 + 20 as trials")
    schedule = _read(spark, sf_dir, "supplier").selectExpr("s_nationkey as team", "s_suppkey % 6 + 1 as week")
    minimums = players.filter("player_id % 4 = 0").selectExpr("player_id", "3 as min_missed")
    rows = forecast.availability_support(forecast.availability_inputs(players, range(1, 7), schedule, minimums))
    return as_double(rows.select("player_id", "week", "bye", "min_missed", "support", "constraint"), "min_missed")


@query(
    "f12_rate_reviews",
    "with r as (select l_suppkey as team, sum(l_quantity) as base, avg(l_discount) as raw_rate, 0.05 as rate, 0.001 + l_suppkey % 5 / 1000.0 as radius from lineitem group by l_suppkey) select team, round(raw_rate, 6) as raw_rate, round(radius, 6) as radius from r where base > 0 and abs(raw_rate - rate) >= radius",
)
def f12_rate_reviews(spark, sf_dir):
    rates = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("team")).agg(F.sum("l_quantity").alias("base"), F.avg("l_discount").alias("raw_rate"))
    rates = rates.withColumn("metric", F.lit("events")).withColumn("rate", F.lit(0.05)).withColumn("radius", F.expr("0.001D + team % 5 / 1000"))
    return forecast.raw_rate_reviews(rates).select("team", "raw_rate", "radius")


@query(
    "f13_weekly_events",
    WEEKLY_SQL + ", s as (select team, week, player_id, volume / 100 as sh, week % 5 <> 0 as sched from weekly), z as (select *, sh / sum(sh) over (partition by team, week) as n from s), v as (select team, player_id, sum(case when sched then (10 + team) * n * 0.9 else 0 end) as e, sum(case when sched then (5 + team) * sh * 0.5 * (n * 0.9 / sh) else 0 end) as lo, sum(case when sched then (20 + team) * sh * 1.5 * (n * 0.9 / sh) else 0 end) as hi from z group by all) select team, player_id, round(e, 6) as season_events, round(lo, 6) as season_low, round(hi, 6) as season_high from v",
)
def f13_weekly_events(spark, sf_dir):
    rows = weekly(spark, sf_dir).selectExpr("team", "'m' as metric", "week", "player_id", "volume / 100 as share", "volume / 200 as share_low", "volume / 100 * 1.5D as share_high", "week % 5 <> 0 as scheduled")
    pools = rows.select("team", "metric").distinct().selectExpr("team", "metric", "10D + team as events", "5D + team as events_low", "20D + team as events_high")
    totals = rows.select("team", "metric", "week").distinct().withColumn("share_sum", F.lit(0.9))
    return forecast.weekly_event_counts(rows, pools, totals).drop("metric")


@query(
    "w12_run_pressure",
    "with p as (select o_custkey % 20 as draft, o_orderkey as pick, case o_orderkey % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position from orders), d as (select * from (values ('QB', 12), ('RB', 30), ('WR', 36), ('TE', 12), ('K', 0)) as t(position, n)), l as (select *, row_number() over (partition by draft order by pick desc) as i from p), s as (select draft, position, count(*) / 12.0 as sh from l where i <= 12 group by all), "
    "x as (select draft, d.position, n / 90.0 as ex from (select distinct draft from p), d) select draft, position, round(ex, 6) as expected, round(greatest(0, least(1, (coalesce(sh, 0) - ex) / greatest(0.05, ex))), 6) + 0.0 as pressure from x left join s using (draft, position)",
)
def w12_run_pressure(spark, sf_dir):
    picks = _read(spark, sf_dir, "orders").selectExpr("o_custkey % 20 as draft", "o_orderkey as pick", "case o_orderkey % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position")
    demand = spark.createDataFrame([("QB", 12), ("RB", 30), ("WR", 36), ("TE", 12), ("K", 0)], "position string, demand int")
    return windows.run_pressure(picks, demand, ["draft"], "pick", 12)


@query("f23_ownership_states")
def f23_ownership_states(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").selectExpr("user_id % 50 as league_id", "event_id as seq", "case event_type when 'error' then 'undo' when 'view' then 'drop' else 'add' end as kind", "user_id as player_id", "event_id % 10 as owner", "event_id % 16 as slot")
    return forecast.ownership_states(rows)


@query(
    "j3_id_conflicts",
    "select c_custkey as player_id, c_nationkey as other_id, s_nationkey as catalog_other from customer join supplier on s_suppkey = c_custkey where c_nationkey <> s_nationkey",
)
def j3_id_conflicts(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "c_nationkey as other_id")
    return joins.roster_id_conflicts(rows, _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as player_id", "s_nationkey as other_id")).drop("review")

