"""More queries over the driver's tables and their SQL: evidence, evaluations, cleaning and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opportunity import driver_sql, quality, stats
from opportunity.driver_queries import ELIGIBLE, EVENTS_SQL, ORACLE_SQL, PLAYS_SQL, QUERIES, RATE_SQL, SAMPLES, TRANSITION_SQL, WEEKLY_SQL, _read, player_weeks, plays, query, rate_rows, transitions, weekly
from opportunity.functions import clean
from opportunity.functions.stored import stored
from opportunity.operators import aggregates as agg
from opportunity.operators import joins, windows
from opportunity.plans import backtests, environment, evaluations, forecast

__all__ = ["ORACLE_SQL", "QUERIES"]

# E16 --------------------------------------------------------------------------------------

TARGET, PRIORS = 2000, (12, 24, 48)
LONG_SQL = " union all ".join(
    f"select season, week, team, player_id, '{m}' as metric, {high}::double as high, {base}::double as base from pw where position = '{p}' and {high} is not null" for m, (p, _, high, base) in evaluations.EVENT_METRICS.items()
)
HIGH_SQL = (
    EVENTS_SQL
    + f", ev as ({LONG_SQL}), se as (select season, team, metric, player_id, sum(high) as high, sum(base) as base from ev group by all), "
    + f"tt as (select season, team, metric, sum(high) as th, sum(base) as tb from se group by all), "
    + f"ro as (select team, metric, player_id, base / sum(base) over (partition by team, metric) as share from se where season = {TARGET - 1} and base > 0), "
    + f"h0 as (select r.team, r.metric, r.player_id, s.season, s.team as st, s.high, s.base, th, tb, power(0.65, {TARGET - 1} - s.season) * case when s.team = r.team then 1.0 else 0.7 end as w, max(case when s.base > 0 then s.season end) over (partition by r.team, r.metric, r.player_id) as last "
    + f"from ro r join se s on s.metric = r.metric and s.player_id = r.player_id join tt on tt.season = s.season and tt.team = s.team and tt.metric = s.metric where s.season between {TARGET - 3} and {TARGET - 1}), "
    + "m0 as (select team, metric, player_id, sum(w * high) as high, sum(w * base) as base, sum(w * th) / nullif(sum(w * tb), 0) as rate, coalesce(bool_or(base > 0 and season = last and st = team), false) as same from h0 group by all), "
    + "mu as (select team, metric, player_id, p, case when base > 0 and rate > 0 then least(4.0, greatest(0.25, case when same then (high + p * rate) / (base + p) / rate else 1 + 0.45 * ((high + p * rate) / (base + p) / rate - 1) end)) else 1.0 end as x from m0, (select unnest([12, 24, 48]) as p)), "
    + "ms as (select team, metric, player_id, 'base' as model, share as mass from ro union all select r.team, r.metric, r.player_id, 'p' || p, share * coalesce(x, 1.0) from ro r join mu using (team, metric, player_id)), "
    + "wt as (select team, metric, player_id, model, mass / sum(mass) over (partition by team, metric, model) as weight from ms), "
    + f"act as (select distinct team, week, player_id from pw where season = {TARGET}), am as (select e.team, e.metric, e.week, e.player_id, e.high as amount from ev e join (select distinct team, metric from ro) using (team, metric) where season = {TARGET} and high > 0), "
    + "pool as (select team, metric, week, sum(amount) as pool from am group by all), md as (select distinct team, metric, model from wt), live as (select w.*, a.week from wt w join act a using (team, player_id)), tot as (select team, metric, model, week, sum(weight) as t from live group by all having sum(weight) > 0), "
    + "al as (select l.team, l.metric, l.model, l.week, l.player_id::varchar as player_id, pool * weight / t as x from live l join tot using (team, metric, model, week) join pool using (team, metric, week) union all select p.team, p.metric, m.model, p.week, '__UNALLOCATED__', p.pool from pool p join md m using (team, metric) where not exists (select 1 from tot where tot.team = p.team and tot.metric = p.metric and tot.model = m.model and tot.week = p.week)), "
    + "we as (select unnest([4, 8, 18]) as window_end), f as (select team, metric, model, window_end, player_id, sum(x) as f from al, we where week <= window_end group by all), ac as (select team, metric, window_end, player_id::varchar as player_id, sum(amount) as a from am, we where week <= window_end group by all), ad as (select ac.*, model from ac join md using (team, metric)), tp as (select team, metric, window_end, sum(pool) as pool from pool, we where week <= window_end group by all), "
    + "j as (select coalesce(f.team, ad.team) as team, coalesce(f.metric, ad.metric) as metric, coalesce(f.model, ad.model) as model, coalesce(f.window_end, ad.window_end) as window_end, coalesce(f.player_id, ad.player_id) as player_id, coalesce(f, 0) as f, coalesce(a, 0) as a, f.team is not null and f.player_id <> '__UNALLOCATED__' as opening "
    + "from f full join ad on f.team = ad.team and f.metric = ad.metric and f.model = ad.model and f.window_end = ad.window_end and f.player_id = ad.player_id), "
    + f"rm as (select {TARGET} as season, team, metric, model, window_end::bigint as window_end, sum(abs(f - a) / pool) / 2 as total_variation, avg(abs(f - a) / pool) as mean_error, sum(case when opening then a / pool else 0 end) as coverage, (first(player_id order by round(f / pool, 9) desc, player_id) = first(player_id order by round(a / pool, 9) desc, player_id)) as top_hit, round(any_value(pool))::bigint as events from j join tp using (team, metric, window_end) group by team, metric, model, window_end)"
)


def high_value_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The target's season and the three before it are all that its rooms and their history ask for.
    counts = sorted({c for _, _, high, base in evaluations.EVENT_METRICS.values() for c in (high, base)})
    weeks = player_weeks(spark, sf_dir).filter(F.col("season").between(TARGET - 3, TARGET)).select("season", "week", "team", "player_id", "position", *counts)
    weeks = stored(weeks, "player-weeks")
    events = evaluations.event_rows(weeks)
    past = events.filter(F.col("season") == TARGET - 1).groupBy("team", "metric", "player_id").agg(F.sum("base").alias("base")).filter("base > 0")
    roles = windows.share_in_group(past, ["team", "metric"], "base").drop("base").withColumn("season", F.lit(TARGET))
    active = weeks.filter(F.col("season") == TARGET).select("season", "team", "week", "player_id").distinct()
    return evaluations.high_value_rooms(roles, events, active)


@query("e16_high_value_backtest", HIGH_SQL + " select season, team, metric, model, window_end, round(total_variation, 6) as total_variation, round(mean_error, 6) as mean_error, round(coverage, 6) as coverage, top_hit, events from rm")
def e16_high_value_backtest(spark, sf_dir):
    return high_value_rooms(spark, sf_dir).withColumn("events", F.round("events").cast("long"))


@query(
    "e16_high_value_evaluations",
    HIGH_SQL
    + ", sc as (select unnest(['ALL', metric]) as scope, window_end, model, total_variation as e, top_hit from rm), g as (select scope, window_end, model, count(*) as n, avg(e) as m, median(e) as md, quantile_cont(e, 0.75) as q, sqrt(avg(e * e)) as r, avg(top_hit::int) as hit from sc group by all), b as (select *, max(case when model = 'base' then m end) over (partition by scope, window_end) as base from g) "
    + "select scope, window_end, model, n, round(m, 6) as mean_error, round(md, 6) as median_error, round(q, 6) as p75_error, round(r, 6) as rmse, round(hit, 6) as hit_rate, round(m - base, 6) + 0.0 as delta, round((base - m) / nullif(base, 0), 6) + 0.0 as improvement from b",
)
def e16_high_value_evaluations(spark, sf_dir):
    return evaluations.high_value_evaluations(high_value_rooms(spark, sf_dir))


@query(
    "e16_high_value_decisions",
    HIGH_SQL
    + ", hd as (select metric || '|' || window_end || '|' || c.model as scope, team as cluster, c.total_variation - b.total_variation as delta from rm c join rm b using (season, team, metric, window_end) where c.model <> 'base' and b.model = 'base'), " + driver_sql.cluster_bootstrap("hd", SAMPLES, 0.90)
    + ", ev2 as (select metric, window_end, model, avg(total_variation) as error, sum(events) as events, count(*) as rooms from rm group by all), me as (select metric, model, avg(error) as mean, count(distinct window_end) as windows from ev2 group by all), ba as (select metric, mean as base from me where model = 'base'), "
    + "de as (select metric, max(case when model <> 'base' then mean - base end) as worst_delta, min(windows) as windows, arg_min(model, (mean, model)) filter (where model <> 'base') as best_model from me join ba using (metric) group by metric), la as (select metric, events, rooms from ev2 where model = 'base' and window_end = 18), "
    + "ow as (select split_part(scope, '|', 1) as metric, sum((high < 0)::int)::bigint as wins, sum((low > 0)::int)::bigint as losses from br where split_part(scope, '|', 3) = 'p24' group by 1) "
    + "select metric, round(worst_delta, 6) + 0.0 as worst_delta, best_model, coalesce(wins, 0) as wins, coalesce(losses, 0) as losses, coalesce(windows = 3 and events >= 100 and rooms >= 20 and wins >= 2 and losses = 0 and worst_delta < 0, false) as promoted from de left join la using (metric) left join ow using (metric)",
)
def e16_high_value_decisions(spark, sf_dir):
    rooms = stored(high_value_rooms(spark, sf_dir), "rooms")
    return evaluations.high_value_decisions(rooms, evaluations.high_value_comparisons(rooms, samples=SAMPLES))


# F3 ---------------------------------------------------------------------------------------

CLAIMS = "select s_nationkey as team, s_suppkey as claim_id, array(case s_suppkey % 2 when 0 then 'pace' else 'efficiency' end) as dimensions, round(s_acctbal / 10000, 2) as certainty_effect, (s_suppkey % 5 + 1) / 5.0D as weight"
F3_SQL = (
    "with st as (select year(o_orderdate)::bigint as season, o_custkey % 25 as team, unnest(['plays_per_game', 'success_rate', 'epa_per_play']) as metric, unnest([avg(o_totalprice) / 1000, avg((o_orderstatus = 'F')::int), avg(o_totalprice) / 100000 - 1]) as value from orders group by year(o_orderdate), o_custkey % 25), "
    "an as (select c_nationkey as team, (c_nationkey + c_custkey % 3) % 25 as anchor_team, 1995 + c_custkey % 4 as season, sum(1.0 / (1 + c_custkey % 3)) as weight from customer group by all), "
    "cl as (select s_nationkey as team, s_suppkey as claim_id, case s_suppkey % 2 when 0 then 'pace' else 'efficiency' end as dimension, round(s_acctbal / 10000, 2) as ce, (s_suppkey % 5 + 1) / 5.0 as w from supplier), "
    "sg as (select team, case claim_id % 3 when 0 then 'plays_per_game' when 1 then 'success_rate' else 'epa_per_play' end as metric, sum((claim_id % 3 - 1) * w) / sum(w) as signal, least(1.0, sum(w)) as vol from cl group by all), "
    "ef as (select team, dimension, sum(ce * w) / sum(w) as effect from cl group by all), sp as (select * from (values ('plays_per_game', 'pace', 20.0, null, null), ('success_rate', 'efficiency', 0.04, 0.0, 1.0), ('epa_per_play', 'efficiency', 0.10, null, null)) as t(metric, dimension, tol, low, high)), "
    "ce as (select n_nationkey as team, 20.0 + 3 * n_nationkey as sc from nation), "
    "ow as (select an.team, metric, count(*) as n, sum(weight) as w, sum(weight * value) / sum(weight) as base, sqrt(greatest(0, sum(weight * value * value) / sum(weight) - power(sum(weight * value) / sum(weight), 2))) as sd from an join st on st.team = anchor_team and st.season = an.season group by all), "
    "lg as (select metric, stddev_pop(value) as rs from st group by all), "
    "fc as (select ow.team, ow.metric, sp.dimension, n as anchors, base, sd, 0.2 * rs * coalesce(signal, 0) * coalesce(vol, 0) as sh, least(coalesce(high, 1e18), greatest(coalesce(low, -1e18), base + 0.2 * rs * coalesce(signal, 0) * coalesce(vol, 0))) as value, "
    "least(100, greatest(0, 0.8 * sc + 20 * (1 - least(sd / tol, 1)) * (0.5 + 0.5 * least(w / 3, 1)) + 5 * coalesce(effect, 0))) as cert from ow join sp using (metric) join lg using (metric) join ce using (team) left join sg using (team, metric) left join ef using (team, dimension)), "
    "fp as (select fc.*, (select (count(*) filter (where s.value < fc.value) + 0.5 * count(*) filter (where s.value = fc.value)) / count(*) from st s where s.metric = fc.metric) as pct from fc)"
)


def f3_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = _read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("season"), (F.col("o_custkey") % 25).alias("team")).agg(
        (F.avg("o_totalprice") / 1000).alias("plays_per_game"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("success_rate"), (F.avg("o_totalprice") / 100000 - 1).alias("epa_per_play")
    )
    style = agg.unpivoted(style, ["season", "team"], ["plays_per_game", "success_rate", "epa_per_play"])
    anchors = _read(spark, sf_dir, "customer").selectExpr("c_nationkey as team", "(c_nationkey + c_custkey % 3) % 25 as anchor_team", "1995 + c_custkey % 4 as season", "1.0D / (1 + c_custkey % 3) as w").groupBy("team", "anchor_team", "season").agg(F.sum("w").alias("weight"))
    claims = _read(spark, sf_dir, "supplier").selectExpr("s_nationkey as team", "s_suppkey as claim_id", "array(case s_suppkey % 2 when 0 then 'pace' else 'efficiency' end) as dimensions", "round(s_acctbal / 10000, 2) as certainty_effect", "(s_suppkey % 5 + 1) / 5 as weight")
    signals = claims.selectExpr("team", "claim_id", "case claim_id % 3 when 0 then 'plays_per_game' when 1 then 'success_rate' else 'epa_per_play' end as metric", "cast(claim_id % 3 - 1 as double) as signal")
    certainty = _read(spark, sf_dir, "nation").selectExpr("n_nationkey as team", "20.0D + 3 * n_nationkey as structural_score")
    specs = spark.createDataFrame([("plays_per_game", "pace", 20.0, None, None), ("success_rate", "efficiency", 0.04, 0.0, 1.0), ("epa_per_play", "efficiency", 0.10, None, None)], "metric string, dimension string, tolerance double, low double, high double")
    return environment.style_forecasts(anchors, style, claims, signals, certainty, specs)


@query(
    "f3_style_forecasts",
    F3_SQL + " select team, metric, dimension, anchors, round(base, 6) as anchor_value, round(sd, 4) as anchor_std, round(sh, 6) + 0.0 as shift, round(value, 6) as value, round(cert, 2) as certainty, round(pct, 6) as percentile from fp",
)
def f3_style_forecasts(spark, sf_dir):
    return f3_forecasts(spark, sf_dir).withColumn("anchor_std", F.round("anchor_std", 4)).withColumn("certainty", F.round("certainty", 2))


@query(
    "f3_position_scores",
    F3_SQL + ", d as (select * from (values ('QB', 'plays_per_game', 0.15, 1), ('QB', 'epa_per_play', 0.10, 1), ('RB', 'plays_per_game', 0.15, 1), ('RB', 'success_rate', 0.10, 1), ('WR', 'plays_per_game', 0.15, 1), ('WR', 'epa_per_play', 0.10, 1), ('TE', 'plays_per_game', 0.15, 1), ('TE', 'success_rate', 0.15, 1)) as t(position, metric, w, dir)), "
    "g as (select team, position, sum(w::double) as w, 100 * sum(w::double * pct) / sum(w::double) as raw, sum(w::double * cert) / sum(w::double) as ct from fp join d using (metric) group by all), s as (select team, position, 50 + (raw - 50) * w as score, ct * w as certainty, w as coverage from g) "
    "select team, position, round(score, 4) as score, round(certainty, 4) as certainty, round(coverage::double, 6) as coverage, case when score >= 65 then 'favorable' when score >= 55 then 'slightly_favorable' when score >= 45 then 'mixed_neutral' when score >= 35 then 'slightly_unfavorable' else 'unfavorable' end as label from s",
)
def f3_position_scores(spark, sf_dir):
    return environment.position_scores(f3_forecasts(spark, sf_dir)).drop("driver").withColumn("score", F.round("score", 4)).withColumn("certainty", F.round("certainty", 4))


# E20 --------------------------------------------------------------------------------------

E20_METRICS = evaluations.RESOURCE_STYLE
E20_SQL = (
    "with tm as (select l_suppkey % 32 as team, year(l_shipdate)::bigint as season, count(distinct l_orderkey)::double as games, sum(l_quantity) as qty, avg(l_discount) as d, avg(l_tax) as t, count(*) as n from lineitem group by all), "
    "fc as (select season, team, m as model, 60 + 100 * d + case m when 'shrunken' then 1 when 'caller_aware' then 2 else 0 end as ppg, 0.5 + d as pr, t as qs, t / 2 as dq, 0.2 + d as rb, 0.5 + d as wr, 0.2 + t as te from tm, (select unnest(['persistence', 'shrunken', 'caller_aware']) as m)), "
    "fa as (select season, 0.9 as qd, 0.85 as tp, 0.9 + (season - 1996) / 100.0 as rc from (select distinct season from tm)), "
    "sc as (select fc.*, qd, tp, rc, greatest(1.0, rb + wr + te) as s, rb + wr + te > 1.05 as bad from fc join fa using (season)), "
    "po as (select season, team, model, unnest(['QB_DROPBACKS', 'QB_RUSH_OPPORTUNITIES', 'RB_CARRIES', 'RB_TARGETS', 'WR_TARGETS', 'TE_TARGETS']) as resource, unnest([ppg * pr * qd, ppg * pr * qs + ppg * (1 - pr) * dq, ppg * (1 - pr) * (1 - dq) * rc, case when not bad then ppg * pr * tp * rb / s end, case when not bad then ppg * pr * tp * wr / s end, case when not bad then ppg * pr * tp * te / s end]) as forecast from sc), "
    "ac as (select season, team, unnest(['QB_DROPBACKS', 'QB_RUSH_OPPORTUNITIES', 'RB_CARRIES', 'RB_TARGETS', 'WR_TARGETS', 'TE_TARGETS']) as resource, unnest([1.2, 0.2, 0.9, 0.3, 0.8, 0.3]) * qty / n * 25 as actual from tm), "
    "er as (select po.*, actual, forecast - actual as signed_error, abs(forecast - actual) as error from po join ac using (season, team, resource))"
)


def e20_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 32).alias("team"), F.year("l_shipdate").cast("long").alias("season")).agg(
        F.countDistinct("l_orderkey").cast("double").alias("games"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.count("*").alias("n")
    )
    style = {"plays_per_game": "60 + 100 * d + case model when 'shrunken' then 1 when 'caller_aware' then 2 else 0 end", "pass_rate": "0.5D + d", "qb_scramble_rate": "t", "designed_qb_run_share": "t / 2", "rb_target_share": "0.2D + d", "wr_target_share": "0.5D + d", "te_target_share": "0.2D + t"}
    models = teams.withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("persistence", "shrunken", "caller_aware")])))
    forecasts = models.selectExpr("season", "18 as window_end", "team", "model", *[f"{e} as {n}" for n, e in style.items()]).unpivot(["season", "window_end", "team", "model"], list(E20_METRICS), "metric", "forecast")
    factors = teams.select("season").distinct().selectExpr("season", "0.9D as qb_dropbacks_per_pass_play", "0.85D as target_per_pass_play", "0.9D + (season - 1996) / 100 as rb_carries_per_non_qb_rush_play")
    each = F.map_from_arrays(F.array(*[F.lit(r) for r in forecast.RESOURCES]), F.array(*[F.lit(x) for x in (1.2, 0.2, 0.9, 0.3, 0.8, 0.3)]))
    actual = teams.select("season", F.lit(18).alias("window_end"), "team", "games", F.explode(each).alias("resource", "k"), (F.col("qty") / F.col("n") * 25).alias("base"))
    actual = actual.select("season", "window_end", "team", "resource", "games", (F.col("k") * F.col("base") * F.col("games")).alias("amount"))
    return evaluations.caller_resource_errors(forecasts, factors, actual)


@query("e20_caller_resource_backtest", E20_SQL + " select season, 18 as window_end, team, model, resource, round(forecast, 5) as forecast, round(actual, 5) as actual, round(signed_error, 5) + 0.0 as signed_error, round(error, 5) as error from er")
def e20_caller_resource_backtest(spark, sf_dir):
    return e20_errors(spark, sf_dir).withColumns({c: F.round(c, 5) for c in ("forecast", "actual", "signed_error", "error")})


@query("e20_paired_errors", E20_SQL + " select c.season, 18 as window_end, c.team, c.resource, round(c.error - b.error, 5) + 0.0 as delta, c.error < b.error as wins from er c join er b using (season, team, resource) where c.model = 'caller_aware' and b.model = 'shrunken'")
def e20_paired_errors(spark, sf_dir):
    return evaluations.caller_resource_pairs(e20_errors(spark, sf_dir)).select("season", "window_end", "team", "resource", F.round("delta", 5).alias("delta"), "wins")


@query(
    "e20_holdout_coverage",
    E20_SQL + ", o as (select resource, error, row_number() over (partition by resource order by error) as i, count(*) over (partition by resource) as n from er where model = 'caller_aware' and season < 1999 and error is not null), r as (select resource, error as radius from o where i = least(n, ceil((n + 1) * 0.9))) select season, team, resource, round(radius, 5) as radius, error <= radius as covered from er join r using (resource) where model = 'caller_aware' and season = 1999",
)
def e20_holdout_coverage(spark, sf_dir):
    rows, _ = evaluations.caller_resource_coverage(e20_errors(spark, sf_dir), 1999)
    return rows.select("season", "team", "resource", F.round("radius", 5).alias("radius"), "covered")


@query(
    "e20_comparisons",
    E20_SQL + ", pd as (select c.resource || '|18' as scope, c.team as cluster, c.error - b.error as delta from er c join er b using (season, team, resource) where c.model = 'caller_aware' and b.model = 'shrunken'), " + driver_sql.cluster_bootstrap("pd", SAMPLES, 0.90) + f" select scope, {driver_sql.BOOTSTRAP_COLUMNS} from br",
)
def e20_comparisons(spark, sf_dir):
    return evaluations.caller_resource_comparisons(evaluations.caller_resource_pairs(e20_errors(spark, sf_dir)), samples=SAMPLES)


# E21 --------------------------------------------------------------------------------------

E21_TEAMS = {
    "season": "1997 + c_custkey % 3",
    "team": "c_custkey",
    "cohort": "case c_custkey % 4 when 0 then 'returning' when 1 then 'changed_with_anchor' when 2 then 'changed_without_anchor' else 'ambiguous' end",
    "on_prior_staff": "c_custkey % 5 = 0",
    "head_coach_kept": "c_nationkey % 2 = 0",
    "staff_index": "cast(c_nationkey * 4 as double)",
}
E21_SQL = (
    f"with tm as (select {', '.join(f'{e} as {c}' for c, e in E21_TEAMS.items())} from customer), p as (select *, case when cohort in ('returning', 'changed_with_anchor') then 1 / 2.2 else 0 end as st, case when cohort in ('returning', 'changed_with_anchor') then 0.45 else 0.20 end as sb, case cohort when 'returning' then 1.0 when 'changed_with_anchor' then 0.75 else case when on_prior_staff then 0.60 else 0.15 end end as cc, staff_index / 100 as sx, head_coach_kept::int::double as hc from tm where cohort <> 'ambiguous'), "
    "k as (select *, 0.20 + 0.15 * st + 0.05 * sx + 0.05 * hc as b, 0.10 + 0.15 * cc + 0.18 * st + 0.12 * sx + 0.08 * hc + 0.12 * sb as e from p), "
    "s as (select season, team, cohort, case when cohort = 'returning' then 100 * (b + 0.55) else 100 * b end as broad_low, 100 * (b + 0.55) as broad_high, case when cohort = 'returning' then 100 * (e + 0.25) else least(79.0, 100 * e) end as exact_low, case when cohort = 'returning' then 100 * (e + 0.25) else least(79.0, 100 * (e + 0.25)) end as exact_high from k), "
    "er as (select season, team, o_orderkey % 2 as metric, avg(o_totalprice) / 1e5 as error from orders join s on team = o_custkey group by all), rw as (select er.*, unnest(['broad', 'exact']) as score_kind, unnest([broad_low, exact_low]) as score from er join s using (season, team)), "
    "cu as (select score_kind, quantile_cont(score, 1 / 3.0) as a, quantile_cont(score, 2 / 3.0) as b from (select distinct score_kind, season, team, score from rw where season < 1999) group by all), tr as (select rw.*, case when score <= a then 'low' when score <= b then 'middle' else 'high' end as tier from rw join cu using (score_kind))"
)


def e21_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = _read(spark, sf_dir, "customer").selectExpr(*[f"{e} as {c}" for c, e in E21_TEAMS.items()])
    scores = evaluations.certainty_scores(teams)
    errors = _read(spark, sf_dir, "orders").join(scores.select("season", "team"), F.col("o_custkey") == F.col("team")).groupBy("season", "team", (F.col("o_orderkey") % 2).alias("metric")).agg((F.avg("o_totalprice") / 1e5).alias("error"))
    return evaluations.certainty_rows(scores, errors.withColumn("window_end", F.lit(8)))


@query("e21_certainty_scores", E21_SQL + " select season, team, cohort, round(broad_low, 5) as broad_low, round(broad_high, 5) as broad_high, round(exact_low, 5) as exact_low, round(exact_high, 5) as exact_high from s")
def e21_certainty_scores(spark, sf_dir):
    found = evaluations.certainty_scores(_read(spark, sf_dir, "customer").selectExpr(*[f"{e} as {c}" for c, e in E21_TEAMS.items()]))
    return found.withColumns({c: F.round(c, 5) for c in ("broad_low", "broad_high", "exact_low", "exact_high")})


@query(
    "e21_certainty_coverage",
    E21_SQL + ", q as (select *, unnest([tier, 'global']) as g from tr where season < 1999), o as (select score_kind, metric, g, error, row_number() over (partition by score_kind, metric, g order by error) as i, count(*) over (partition by score_kind, metric, g) as n from q), r as (select score_kind, metric, g, error as radius from o where i = least(n, ceil((n + 1) * 0.9))), "
    "h as (select t.score_kind, unnest([t.tier, 'all']) as tier, error, a.radius as tr, b.radius as mr from tr t left join r a on a.score_kind = t.score_kind and a.metric = t.metric and a.g = t.tier join r b on b.score_kind = t.score_kind and b.metric = t.metric and b.g = 'global' where season = 1999) "
    "select score_kind, 8 as window_end, tier, count(*) as rows, round(avg((error <= tr)::int), 6) as tier_rate, round(avg((error <= mr)::int), 6) as metric_rate from h group by all",
)
def e21_certainty_coverage(spark, sf_dir):
    found = evaluations.certainty_coverage(evaluations.certainty_tiers(e21_rows(spark, sf_dir), 1999), 1999)
    return found.select("score_kind", "window_end", "tier", "rows", "tier_rate", "metric_rate")


E21_RANKS_SQL = (
    ", tq as (select score_kind, case when season = 1999 then 'holdout' else 'development' end as part, season, team, round(score, 9) as x, round(avg(error), 9) as y from rw group by score_kind, season, team, score), ts as (select score_kind || '|' || part || '|8' as scope, * from tq), "
    + driver_sql.spearman_bootstrap("ts", "season, team", SAMPLES, 0.95)
    + ", rk as (select scope, score_kind, part, rank() over (partition by scope order by x) + (count(*) over (partition by scope, x) - 1) / 2 as a, rank() over (partition by scope order by y) + (count(*) over (partition by scope, y) - 1) / 2 as b from ts where x is not null and y is not null), sp as (select scope, score_kind, part, corr(a, b) as spearman, count(*) as n from rk group by all), rr as (select score_kind, part, spearman, n, low, high, samples from sp join qr using (scope))"
)
E21_RADII_SQL = (
    ", gz as (select *, unnest([tier, 'global']) as g from tr where season < 1999), ot as (select score_kind, metric, g, error, row_number() over (partition by score_kind, metric, g order by error) as i, count(*) over (partition by score_kind, metric, g) as n from gz), ra as (select score_kind, metric, g, error as radius from ot where i = least(n, ceil((n + 1) * 0.9))), "
    "ho as (select t.score_kind, unnest([t.tier, 'all']) as tier, error, a.radius as tr, b.radius as mr from tr t left join ra a on a.score_kind = t.score_kind and a.metric = t.metric and a.g = t.tier join ra b on b.score_kind = t.score_kind and b.metric = t.metric and b.g = 'global' where season = 1999), "
    "co as (select score_kind, tier, count(*) as rows, avg((error <= tr)::int) as tier_rate, sum(coalesce((error <= tr)::int, 0)) as covered, avg(tr) as tier_radius, avg(mr) as metric_radius from ho group by all)"
)


@query(
    "e21_certainty_decision",
    E21_SQL + E21_RANKS_SQL + E21_RADII_SQL
    + ", he as (select score_kind, bool_and(round(spearman, 6) < 0) as negative, bool_and(coalesce(round(high, 6) < 0, false)) as clear from rr where part = 'holdout' group by 1), ru as (select score_kind, bool_and(coalesce(round(tier_rate, 6) >= 0.9, false)) filter (where tier <> 'all') as tiers_covered, bool_and(coalesce(round(tier_rate, 6) >= 0.9, false)) filter (where tier = 'all') as all_covered, bool_and(coalesce(round(tier_radius, 6) <= round(metric_radius, 6), false)) filter (where tier = 'all') as no_wider from co group by 1) "
    + "select *, negative and clear and tiers_covered and all_covered and no_wider as promoted from he join ru using (score_kind)",
)
def e21_certainty_decision(spark, sf_dir):
    rows = stored(e21_rows(spark, sf_dir), "certainty-rows")
    covered = evaluations.certainty_coverage(evaluations.certainty_tiers(rows, 1999), 1999)
    return evaluations.certainty_decision(evaluations.certainty_ranks(rows, 1999, samples=SAMPLES), stored(covered, "certainty-coverage"))


@query(
    "e21_certainty_widths",
    E21_SQL + E21_RADII_SQL + ", z as (select *, covered / rows as p, 1.959963984540054 * 1.959963984540054 as z2 from co), b as (select *, (p + z2 / (2 * rows)) / (1 + z2 / rows) as c, 1.959963984540054 * sqrt(p * (1 - p) / rows + z2 / (4.0 * rows * rows)) / (1 + z2 / rows) as m from z) "
    "select score_kind, tier, rows, round(tier_radius, 6) as tier_radius, round(metric_radius, 6) as metric_radius, round(greatest(0.0, c - m), 6) as tier_low, round(least(1.0, c + m), 6) as tier_high from b",
)
def e21_certainty_widths(spark, sf_dir):
    return evaluations.certainty_coverage(evaluations.certainty_tiers(e21_rows(spark, sf_dir), 1999), 1999).select("score_kind", "tier", "rows", "tier_radius", "metric_radius", "tier_low", "tier_high")


@query(
    "e21_worst_cases",
    E21_SQL + ", te as (select season, team, avg(error) as error from er where season = 1999 group by all), o as (select te.*, row_number() over (order by te.error desc, te.team) as rank from te) select 8 as window_end, rank, team, cohort, round(broad_low, 5) as broad_low, round(exact_low, 5) as exact_low, round(error, 5) as error from o join s using (season, team) where rank <= 5",
)
def e21_worst_cases(spark, sf_dir):
    teams = _read(spark, sf_dir, "customer").selectExpr(*[f"{e} as {c}" for c, e in E21_TEAMS.items()])
    scores = evaluations.certainty_scores(teams)
    found = evaluations.certainty_worst(scores, e21_rows(spark, sf_dir).filter("score_kind = 'broad'"), 1999)
    return found.withColumns({c: F.round(c, 5) for c in ("broad_low", "exact_low", "error")})


@query(
    "e12_tier_radii",
    E21_SQL + ", q as (select *, unnest([tier, 'global']) as g from tr where season < 1999), o as (select score_kind, metric, g as tier, error, row_number() over (partition by score_kind, metric, g order by error) as i, count(*) over (partition by score_kind, metric, g) as n from q) select score_kind, metric, tier, round(error, 6) as radius, n from o where i = least(n, ceil((n + 1) * 0.9))",
)
def e12_tier_radii(spark, sf_dir):
    return stats.tier_radii(evaluations.certainty_tiers(e21_rows(spark, sf_dir), 1999).filter("season < 1999"), ["score_kind", "metric"], "error")


# E10 --------------------------------------------------------------------------------------

E10_SQL = (
    "with ou as (select user_id % 3 as season, event_type as family, case user_id % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position, user_id % 16 as team, case when value > 20 then 1 else 0 end as active from events), "
    "c1 as (select season, family, position, count(*) as n, sum(active) as s from ou group by all), l1 as (select a.season, a.family, a.position, (sum(b.s) + 1.0) / (sum(b.n) + 2) as p from c1 a join c1 b on a.family = b.family and a.position = b.position and a.season <> b.season group by all), "
    "c2 as (select season, family, count(*) as n, sum(active) as s from ou group by all), l2 as (select a.season, a.family, (sum(b.s) + 1.0) / (sum(b.n) + 2) as p from c2 a join c2 b on a.family = b.family and a.season <> b.season group by all), "
    "r as (select ou.position, team, power(l1.p - active, 2) as c, power(l2.p - active, 2) as d from ou join l1 using (season, family, position) join l2 using (season, family)), m as (select position, team, count(*) as n, sum(c) as c, sum(d) as d, avg(c - d) as x from r group by all)"
)


@query(
    "e10_leave_one_out_brier",
    E10_SQL + " select position, sum(n)::bigint as n, count(*) as clusters, round(sum(c) / sum(n), 6) as cohort_brier, round(sum(d) / sum(n), 6) as coarse_brier, round(avg(x), 6) + 0.0 as delta, round(avg(x) - 1.645 * stddev_samp(x) / sqrt(count(*)), 6) + 0.0 as low, round(avg(x) + 1.645 * stddev_samp(x) / sqrt(count(*)), 6) + 0.0 as high from m group by position",
)
def e10_leave_one_out_brier(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").selectExpr("user_id % 3 as season", "event_type as family", "case user_id % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position", "user_id % 16 as team", "case when value > 20 then 1 else 0 end as active")
    counts = rows.groupBy("season", "family", "position").agg(F.count("*").alias("trials"), F.sum("active").alias("successes"))
    return stats.leave_one_out_brier(counts, rows, ["family", "position"], ["position"], "team")


@query("e11_bootstrap_spearman", E21_SQL + E21_RANKS_SQL + " select score_kind, part, 8 as window_end, round(spearman, 6) + 0.0 as spearman, n, round(low, 6) + 0.0 as low, round(high, 6) + 0.0 as high, samples from rr")
def e11_bootstrap_spearman(spark, sf_dir):
    return evaluations.certainty_ranks(stored(e21_rows(spark, sf_dir), "certainty-rows"), 1999, samples=SAMPLES)


# With three clusters all 27 resamples are listed, and SQL can list them too.
@query(
    "e4_exact_bootstrap",
    TRANSITION_SQL + ", pd as (select c.window_end, c.team % 3 as cl, c.error - b.error as d from tr c join tr b using (team, window_end, metric) where c.model = 'caller_aware' and b.model = 'shrunken'), cm as (select window_end, cl, avg(d) as m from pd group by all), rs as (select a.window_end, (a.m + b.m + c.m) / 3 as x from cm a join cm b using (window_end) join cm c using (window_end)), "
    "iv as (select window_end, quantile_cont(x, 0.05) as low, quantile_cont(x, 0.95) as high from rs group by all), g as (select window_end, count(*) as rows, count(distinct cl) as clusters, avg(d) as md, avg((d < 0)::int) as wr from pd group by all) "
    "select window_end::varchar as scope, rows, clusters, round(md, 6) + 0.0 as mean_delta, round(low, 6) + 0.0 as low, round(high, 6) + 0.0 as high, round(wr, 6) as win_rate, case when high < 0 then 'lower_error' when low > 0 then 'higher_error' else 'uncertain' end as interpretation from iv join g using (window_end)",
)
def e4_exact_bootstrap(spark, sf_dir):
    rows = transitions(spark, sf_dir).withColumn("scope", F.col("window_end").cast("string"))
    deltas = windows.scope_deltas(rows.filter("model in ('caller_aware', 'shrunken')").select("scope", "team", "metric", "model", "error"), ["scope", "team", "metric"], "model", "error", "shrunken")
    return stats.paired_cluster_bootstrap(deltas.withColumn("cluster", F.col("team") % 3), "scope", "cluster", "delta", exact_to=3)


# Cleaning and identity --------------------------------------------------------------------


@query("c4_positions", "select p_type, case when upper(p_type) = 'STANDARD' then 'OTHER' else 'OTHER' end as skill, case p_size % 6 when 0 then 'RB' when 1 then 'WR' when 2 then 'K' when 3 then null when 4 then 'TE' else null end as fantasy, case p_size % 6 when 0 then 'FB' when 1 then 'WR' when 2 then 'PK' when 3 then 'DST' when 4 then 'TE' else 'DST' end as draft, count(*) as n from part group by all")
def c4_positions(spark, sf_dir):
    code = F.expr("case p_size % 6 when 0 then ' fb' when 1 then 'WR' when 2 then 'pk' when 3 then 'DEF' when 4 then 'te ' else 'd/st' end")
    rows = _read(spark, sf_dir, "part").select("p_type", clean.skill_position(F.col("p_type")).alias("skill"), clean.fantasy_position(code).alias("fantasy"), clean.draft_position(code).alias("draft"))
    return rows.groupBy("p_type", "skill", "fantasy", "draft").agg(F.count("*").alias("n"))


@query("c5_teams", "select case c_nationkey % 4 when 0 then 'ARI' when 1 then 'JAX' when 2 then 'LAR' else 'KC' end as team, count(*) as n from customer group by all")
def c5_teams(spark, sf_dir):
    code = F.expr("case c_nationkey % 4 when 0 then 'arz' when 1 then 'JAC ' when 2 then 'stl' else 'KC' end")
    return _read(spark, sf_dir, "customer").groupBy(clean.canonical_team(code).alias("team")).agg(F.count("*").alias("n"))


@query("c7_name_aliases", "with n as (select c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) as a, lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) as b from customer) select c_custkey, case when a = b then a when a < b then a || ',' || b else b || ',' || a end as aliases from n")
def c7_name_aliases(spark, sf_dir):
    names = clean.name_aliases(F.concat(F.col("c_name"), F.lit(" Jr.")), F.col("c_mktsegment"), F.lit(""))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.array_join(names, ",").alias("aliases"))


STAFF_TITLES = ("Head Coach/Play Caller", "Offensive Coordinator", "Passing Game Coordinator/Quarterbacks", "Defensive Line Assistant", "Special Teams Quality Control", "Head Strength and Conditioning", "Running Backs", "Scouting Assistant", "Assistant Offensive Line")
STAFF_SIDES = ("head_coach", "offense", "offense", "defense", "special_teams", "performance", "offense", "other", "offense")
STAFF_DUTIES = ("head_coach", "offensive_coordinator", "pass_game,quarterbacks", "", "", "", "running_backs", "", "offensive_assistant,offensive_line")


def _choose(values: tuple[str, ...]) -> str:
    return "case s_suppkey % 9 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


@query("c8_staff_sides", f"select s_suppkey, {_choose(STAFF_SIDES)} as side, {_choose(STAFF_DUTIES)} as duties from supplier")
def c8_staff_sides(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_choose(STAFF_TITLES)).alias("title")).withColumn("side", clean.staff_side(F.col("title")))
    return rows.select("s_suppkey", "side", F.array_join(clean.staff_responsibilities(F.col("title"), F.col("side")), ",").alias("duties"))


HEADLINES = ("Coordinator calls plays in new offense", "Guard returns from reserve", "QB targets: starting role", "Backfield rotation, tight end out", "Nothing to see")
HEADLINE_TAGS = ("play_calling,scheme_style", "offensive_line,injury_availability", "role_usage,quarterback", "role_usage,running_back,receiver_tight_end", "")


@query("c9_eight_topics", "select o_orderkey, case o_orderkey % 5 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(HEADLINE_TAGS)) + " end as tags from orders")
def c9_eight_topics(spark, sf_dir):
    title = F.expr("case o_orderkey % 5 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(HEADLINES)) + " end")
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(clean.topic_tags(title), ",").alias("tags"))


@query("c10_points_range", "select p_partkey, case when p_size % 3 = 0 then p_size else p_retailprice end as floor, case when p_size % 4 = 0 then p_size * 2 else p_retailprice end as ceiling from part")
def c10_points_range(spark, sf_dir):
    low, high = clean.points_range(F.col("p_retailprice"), F.expr("case when p_size % 3 = 0 then cast(p_size as double) end"), F.expr("case when p_size % 4 = 0 then cast(p_size * 2 as double) end"))
    return _read(spark, sf_dir, "part").select("p_partkey", low.alias("floor"), high.alias("ceiling"))


@query("c14_current_families", "select c_custkey, case when c_custkey % 7 = 0 then 'practice_squad' when c_custkey % 7 = 1 then 'reserve_other' else case c_custkey % 4 when 0 then 'active_53' when 1 then 'return_eligible_reserve' when 2 then 'reserve_nfi' end end as family from customer")
def c14_current_families(spark, sf_dir):
    status = F.expr("case c_custkey % 4 when 0 then 'act' when 1 then 'RSR' when 2 then 'RSN' else 'ZZZ' end")
    evidence = F.expr("case c_custkey % 7 when 0 then 'practice_squad' when 1 then 'Reserve_Injured ' else '' end")
    return _read(spark, sf_dir, "customer").select("c_custkey", clean.current_status_family(status, evidence).alias("family"))


@query("c15_bands", "select p_partkey, case when p_size >= 80 then 'strong_role_evidence' when p_size * 2 >= 80 then 'strong_role_evidence' when p_size * 2 >= 65 then 'moderate_role_evidence' when p_size * 2 >= 50 then 'limited_role_evidence' else 'weak_role_evidence' end as band from part")
def c15_bands(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", clean.score_band(F.col("p_size") * 2.0).alias("band"))


@query("c16_volume", "select l_orderkey, l_linenumber, round(case l_linenumber % 4 when 0 then l_quantity + l_discount when 1 then l_discount + l_tax else l_tax end, 6) as volume from lineitem")
def c16_volume(spark, sf_dir):
    position = F.expr("case l_linenumber % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clean.volume(position, F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")).alias("volume"))


@query(
    "c19_roster_needs",
    "with s as (select p_partkey, p_size % 14 as r, p_size % 3 as qb, p_size % 4 as rb from part) select p_partkey, concat_ws(',', case when qb < 1 then 'QB' end, case when rb < 2 or rb - 2 < 1 then 'RB' end, case when r >= 11 then 'K' end) as needs from s",
)
def c19_roster_needs(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 14 as r", "p_size % 3 as qb", "p_size % 4 as rb")
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    statuses = {
        "QB": clean.lineup_status(F.col("qb"), F.lit(1), zero, zero, no),
        "RB": clean.lineup_status(F.col("rb"), F.lit(2), F.greatest(zero, F.col("rb") - 2), F.lit(1), yes),
        "K": clean.lineup_status(zero, F.lit(1), zero, zero, no),
    }
    return rows.select("p_partkey", F.array_join(clean.roster_needs(statuses, F.col("r")), ",").alias("needs"))


IDENTITY_SQL = "with cat as (select p_partkey as player_id, p_size as other_id, p_partkey % 5 as team from part), ro as (select case when l_orderkey % 4 <> 0 then l_partkey + case when l_orderkey % 9 = 0 then 10000000 else 0 end end as player_id, case when l_orderkey % 5 <> 0 then l_linenumber * 20 end as other_id, l_partkey % 6 as team, l_orderkey, l_linenumber from lineitem), oc as (select other_id, min(player_id) as lo, max(player_id) as hi from cat group by 1)"


@query(
    "j4_resolve_identity",
    IDENTITY_SQL + ", x as (select ro.*, k.player_id is not null as known, lo, hi from ro left join cat k on k.player_id = ro.player_id left join oc on oc.other_id = ro.other_id), y as (select *, case when known then player_id when player_id is null and lo = hi then lo end as resolved_id, case when known and lo = hi and lo <> player_id then 'conflict' when known then null when player_id is not null then 'unknown_id' when lo is null then 'unmatched' when lo <> hi then 'ambiguous' end as r from x) "
    "select l_orderkey, l_linenumber, resolved_id, case when r is null and cat.team <> y.team then 'team_mismatch' else r end as reason from y left join cat on cat.player_id = resolved_id",
)
def j4_resolve_identity(spark, sf_dir):
    catalog = _read(spark, sf_dir, "part").selectExpr("p_partkey as player_id", "p_size as other_id", "p_partkey % 5 as team")
    rows = _read(spark, sf_dir, "lineitem").selectExpr("case when l_orderkey % 4 <> 0 then l_partkey + case when l_orderkey % 9 = 0 then 10000000 else 0 end end as player_id", "case when l_orderkey % 5 <> 0 then l_linenumber * 20 end as other_id", "l_partkey % 6 as team", "l_orderkey", "l_linenumber")
    return joins.resolve_identity(rows, catalog).select("l_orderkey", "l_linenumber", "resolved_id", "reason")


@query(
    "j7_match_feed",
    "with p as (select c_custkey as player_id, c_name as name_key, c_nationkey as team, c_mktsegment as position from customer), f as (select case when o_orderkey % 3 = 0 then o_custkey end as player_id, c_name as name_key, c_nationkey as team, c_mktsegment as position, o_orderpriority as alert from orders join customer on c_custkey = o_custkey ), i as (select player_id, min(alert) as a from f where player_id is not null group by 1), n as (select name_key, team, position, min(alert) as b from f group by all having count(*) = 1) select p.player_id, coalesce(a, b) as alert from p left join i using (player_id) left join n using (name_key, team, position) where coalesce(a, b) is not null",
)
def j7_match_feed(spark, sf_dir):
    players = _read(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "c_name as name_key", "c_nationkey as team", "c_mktsegment as position")
    alerts = _read(spark, sf_dir, "orders").selectExpr("case when o_orderkey % 3 = 0 then o_custkey end as player_id", "o_custkey as owner", "o_orderpriority as alert")
    feed = alerts.join(players.withColumnRenamed("player_id", "owner"), "owner").drop("owner")
    return joins.match_feed(players, feed)


@query(
    "j15_attach_reviews",
    "with w as (select o_orderkey as k, o_custkey as player_id from orders), s as (select c_custkey as player_id, c_nationkey % 2 = 0 as required from customer), r as (select c_custkey as player_id, c_mktsegment as review from customer where c_nationkey % 3 = 0) select k, player_id, required, review, coalesce(required, false) = (review is not null) as agrees from w left join s using (player_id) left join r using (player_id)",
)
def j15_attach_reviews(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer")
    season, reviews = customers.selectExpr("c_custkey as player_id", "c_nationkey % 2 = 0 as required"), customers.filter("c_nationkey % 3 = 0").selectExpr("c_custkey as player_id", "c_mktsegment as review")
    return joins.attach_reviews(_read(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as player_id"), season, reviews)


@query("q3_rule_breaks", "select count(*) as broken from lineitem where not (l_quantity <= 40 and l_discount <= 0.05)")
def q3_rule_breaks(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    return quality.range_violations(rows, {"broken": (F.col("l_quantity") <= 40) & (F.col("l_discount") <= 0.05)})


# F5 ---------------------------------------------------------------------------------------

ROLE_RESOURCE = "case position when 'QB' then 'QB_DROPBACKS' when 'RB' then 'RB_CARRIES' when 'WR' then 'WR_TARGETS' else 'TE_TARGETS' end"

@query(
    "f5_role_priors",
    WEEKLY_SQL + ", pl as (select team, player_id, position, sum(volume) as v, count(*) as g from weekly group by all), rk as (select *, row_number() over (partition by team, position order by v desc, player_id) as rank from pl), "
    "dw as (select *, case position when 'QB' then 'QB_DROPBACKS' when 'RB' then 'RB_CARRIES' when 'WR' then 'WR_TARGETS' else 'TE_TARGETS' end as resource, case position when 'QB' then case when rank <= 4 then [1.0, 0.07, 0.015, 0.005][rank] else 0.005 * power(0.55, rank - 4) end when 'RB' then case when rank <= 6 then [1.0, 0.55, 0.28, 0.14, 0.07, 0.035][rank] else 0.035 * power(0.55, rank - 6) end when 'WR' then case when rank <= 8 then [1.0, 0.90, 0.80, 0.35, 0.22, 0.13, 0.08, 0.05][rank] else 0.05 * power(0.55, rank - 8) end else case when rank <= 6 then [1.0, 0.45, 0.18, 0.08, 0.04, 0.02][rank] else 0.02 * power(0.55, rank - 6) end end as d, case when player_id % 5 <> 0 then 0.1 + player_id % 7 / 10.0 end as hs, case when player_id % 5 <> 0 then g::double end as wg, case when player_id % 5 <> 0 then player_id % 2 = 0 end as sm from rk), "
    "a as (select *, d / sum(d) over w as dp, coalesce(hs, 0) / nullif(sum(coalesce(hs, 0)) over w, 0) as h0 from dw window w as (partition by team, resource)), b as (select *, coalesce(h0, dp) as h, coalesce(least(0.8, wg / (wg + case position when 'QB' then 6 else 8 end)) * case when sm then 1 else 0.45 end, 0) as rel, case resource when 'QB_DROPBACKS' then 0.0 when 'RB_CARRIES' then 0.45 else 0.55 end as hw from a), "
    "c as (select *, hw * (rel * h + (1 - rel) * dp) + (1 - hw) * dp as raw from b), e as (select *, raw / sum(raw) over (partition by team, resource) as share, least(95, 50 + 40 * rel + case when coalesce(sm, false) then 10 else 0 end) as ev from c) "
    "select team, resource, player_id, round(share, 6) as share, round(share * (10 + team), 6) as opportunities, round(ev, 6) as evidence, round(greatest(0, share - case resource when 'QB_DROPBACKS' then 0.14 when 'RB_CARRIES' then 0.20 when 'WR_TARGETS' then 0.18 else 0.19 end * (1.25 - ev / 100)), 6) + 0.0 as share_low from e",
)
def f5_role_priors(spark, sf_dir):
    rows = weekly(spark, sf_dir).groupBy("team", "player_id", "position").agg(F.sum("volume").alias("v"), F.count("*").cast("double").alias("g"))
    ranked = windows.rank_in(rows, ["team", "position"], [F.desc("v"), F.col("player_id")], "depth_rank").withColumn("resource", F.expr(ROLE_RESOURCE))
    history = rows.filter("player_id % 5 <> 0").selectExpr("player_id", "team", "0.1D + player_id % 7 / 10 as share", "g as weighted_games", "player_id % 2 = 0 as same_team").distinct()
    pools = ranked.select("team", "resource").distinct().withColumn("pool", 10.0 + F.col("team"))
    found = forecast.role_priors(ranked.select("team", "resource", "position", "player_id", "depth_rank"), history, pools)
    return found.select("team", "resource", "player_id", "share", "opportunities", "evidence", "share_low")


# E15, E17 and E19 -------------------------------------------------------------------------


ROLE_SQL = (
    WEEKLY_SQL + ", pl as (select team, player_id, position, sum(volume) as v, count(*) as g from weekly group by all), rk as (select *, row_number() over (partition by team, position order by v desc, player_id) as rank from pl), "
    "dw as (select *, case position when 'QB' then 'QB_DROPBACKS' when 'RB' then 'RB_CARRIES' when 'WR' then 'WR_TARGETS' else 'TE_TARGETS' end as resource, case position when 'QB' then case when rank <= 4 then [1.0, 0.07, 0.015, 0.005][rank] else 0.005 * power(0.55, rank - 4) end when 'RB' then case when rank <= 6 then [1.0, 0.55, 0.28, 0.14, 0.07, 0.035][rank] else 0.035 * power(0.55, rank - 6) end when 'WR' then case when rank <= 8 then [1.0, 0.90, 0.80, 0.35, 0.22, 0.13, 0.08, 0.05][rank] else 0.05 * power(0.55, rank - 8) end else case when rank <= 6 then [1.0, 0.45, 0.18, 0.08, 0.04, 0.02][rank] else 0.02 * power(0.55, rank - 6) end end as d, case when player_id % 5 <> 0 then 0.1 + player_id % 7 / 10.0 end as hs, case when player_id % 5 <> 0 then g::double end as wg, case when player_id % 5 <> 0 then player_id % 2 = 0 end as sm from rk), "
    "a as (select *, d / sum(d) over w as dp, coalesce(hs, 0) / nullif(sum(coalesce(hs, 0)) over w, 0) as h0 from dw window w as (partition by team, resource)), b as (select *, coalesce(h0, dp) as h, coalesce(least(0.8, wg / (wg + case position when 'QB' then 6 else 8 end)) * case when sm then 1 else 0.45 end, 0) as rel, case resource when 'QB_DROPBACKS' then 0.0 when 'RB_CARRIES' then 0.45 else 0.55 end as hw from a) "
)


@query("e15_role_models", ROLE_SQL + " select 2024 as season, team, resource, player_id, unnest(['depth', 'prior', 'blend']) as model, round(unnest([dp, h, hw * (rel * h + (1 - rel) * dp) + (1 - hw) * dp]), 6) as weight from b")
def e15_role_models(spark, sf_dir):
    return role_models(spark, sf_dir)


def role_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly(spark, sf_dir).groupBy("team", "player_id", "position").agg(F.sum("volume").alias("v"), F.count("*").cast("double").alias("g"))
    ranked = windows.rank_in(rows, ["team", "position"], [F.desc("v"), F.col("player_id")], "depth_rank").withColumn("resource", F.expr(ROLE_RESOURCE)).withColumn("season", F.lit(2024))
    history = ranked.filter("player_id % 5 <> 0").selectExpr("season", "team", "resource", "player_id", "0.1D + player_id % 7 / 10 as share", "g as weighted_games", "player_id % 2 = 0 as same_team")
    return backtests.role_weights(ranked.select("season", "team", "resource", "position", "player_id", "depth_rank"), history)


# The models through E2 and E1: a seventh of the players has no actual amounts, a third is never active.
MODELS_SQL = (
    ROLE_SQL
    + ", wt as (select team, resource, player_id, unnest(['depth', 'prior', 'blend']) as model, unnest([dp, h, hw * (rel * h + (1 - rel) * dp) + (1 - hw) * dp]) as weight from b), "
    + "po as (select distinct team, player_id, resource from b), am as (select w.team, resource, week, player_id, volume as amount from weekly w join po using (team, player_id) where player_id % 7 <> 0), act as (select distinct team, week, player_id from weekly where player_id % 3 <> 0), "
    + "pool as (select team, resource, week, sum(amount) as pool from am group by all having sum(amount) > 0), md as (select distinct team, resource, model from wt), live as (select w.*, a2.week from wt w join act a2 using (team, player_id)), tot as (select team, resource, model, week, sum(weight) as t from live group by all having sum(weight) > 0), "
    + "al as (select l.team, l.resource, l.model, l.week, l.player_id::varchar as player_id, pool * weight / t as x from live l join tot using (team, resource, model, week) join pool using (team, resource, week) union all select p.team, p.resource, m.model, p.week, '__UNALLOCATED__', p.pool from pool p join md m using (team, resource) where not exists (select 1 from tot where tot.team = p.team and tot.resource = p.resource and tot.model = m.model and tot.week = p.week)), "
    + "we as (select unnest([4, 8, 18]) as window_end), f as (select team, resource, model, window_end, player_id, sum(x) as f from al, we where week <= window_end group by all), ac as (select team, resource, window_end, player_id::varchar as player_id, sum(amount) as a from am, we where week <= window_end group by all), ad as (select ac.*, model from ac join md using (team, resource)), tp as (select team, resource, window_end, sum(pool) as pool from pool, we where week <= window_end group by all), "
    + "j as (select coalesce(f.team, ad.team) as team, coalesce(f.resource, ad.resource) as resource, coalesce(f.model, ad.model) as model, coalesce(f.window_end, ad.window_end) as window_end, coalesce(f.player_id, ad.player_id) as player_id, coalesce(f, 0) as f, coalesce(a, 0) as a, f.team is not null and f.player_id <> '__UNALLOCATED__' as opening from f full join ad on f.team = ad.team and f.resource = ad.resource and f.model = ad.model and f.window_end = ad.window_end and f.player_id = ad.player_id), "
    + "rm as (select team, resource, model, window_end, sum(abs(f - a) / pool) / 2 as total_variation, avg(abs(f - a) / pool) as mean_error, sum(case when opening then a / pool else 0 end) as coverage, (first(player_id order by round(f / pool, 9) desc, player_id) = first(player_id order by round(a / pool, 9) desc, player_id)) as top_hit from j join tp using (team, resource, window_end) group by all)"
)


def model_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = stored(weekly(spark, sf_dir), "weeks")
    weights = stored(role_models(spark, sf_dir), "role-weights")
    own = weights.select("team", "player_id", "resource").distinct()
    actual = weeks.filter("player_id % 7 <> 0").join(own, ["team", "player_id"]).select(F.lit(2024).alias("season"), "team", "resource", "week", "player_id", F.col("volume").alias("amount"))
    active = weeks.filter("player_id % 3 <> 0").select(F.lit(2024).alias("season"), "team", "week", "player_id").distinct()
    return backtests.allocation_backtest(weights, active, actual)


@query("e15_model_backtest", MODELS_SQL + " select 2024 as season, team, resource, model, window_end::bigint as window_end, round(total_variation, 6) as total_variation, round(mean_error, 6) as mean_error, round(coverage, 6) as coverage, top_hit from rm")
def e15_model_backtest(spark, sf_dir):
    return model_rooms(spark, sf_dir)


@query(
    "e15_model_evaluations",
    MODELS_SQL
    + ", sc as (select unnest(['ALL', resource]) as scope, window_end, model, total_variation as e, top_hit from rm), g as (select scope, window_end, model, count(*) as n, avg(e) as m, median(e) as md, quantile_cont(e, 0.75) as q, sqrt(avg(e * e)) as r, avg(top_hit::int) as hit from sc group by all), bb as (select *, max(case when model = 'depth' then m end) over (partition by scope, window_end) as base from g) "
    + "select scope, window_end, model, n, round(m, 6) as mean_error, round(md, 6) as median_error, round(q, 6) as p75_error, round(r, 6) as rmse, round(hit, 6) as hit_rate, round(m - base, 6) + 0.0 as delta, round((base - m) / nullif(base, 0), 6) + 0.0 as improvement from bb",
)
def e15_model_evaluations(spark, sf_dir):
    rows = model_rooms(spark, sf_dir).select("window_end", "model", F.col("total_variation").alias("error"), "top_hit", "resource")
    return agg.evaluation_summary(rows, F.array(F.lit("ALL"), F.col("resource")), "depth")


@query(
    "e15_model_comparisons",
    MODELS_SQL + ", xd as (select unnest(['ALL', c.resource]) || '|' || window_end || '|' || c.model as scope, team as cluster, round(c.total_variation, 9) - round(d.total_variation, 9) as delta from rm c join rm d using (team, resource, window_end) where c.model <> 'depth' and d.model = 'depth'), "
    + driver_sql.cluster_bootstrap("xd", SAMPLES, 0.90, prefix="cb") + f" select scope, {driver_sql.BOOTSTRAP_COLUMNS} from cbr",
)
def e15_model_comparisons(spark, sf_dir):
    return backtests.allocation_comparisons(model_rooms(spark, sf_dir), "depth", samples=SAMPLES)


@query(
    "e17_rate_comparisons",
    RATE_SQL + ", rd as (select c.window_end || '|' || c.model as scope, team as cluster, c.error - b.error as delta from rt c join rt b using (target, team, window_end) where c.model <> 'league' and b.model = 'league'), " + driver_sql.cluster_bootstrap("rd", SAMPLES, 0.90)
    + f" select {driver_sql.BOOTSTRAP_COLUMNS}, split_part(scope, '|', 1)::int as window_end, split_part(scope, '|', 2) as challenger from br",
)
def e17_rate_comparisons(spark, sf_dir):
    return backtests.rate_comparisons(stored(rate_rows(spark, sf_dir), "rates"), samples=SAMPLES)


# Counts of the plays stand for resources, alike for all teams or not; games are games with a play.
RESOURCE_COUNTS = {"PASSES": "pass", "TEAM_PASSES": "pass * (1 + team % 7)", "SUCCESSES": "success * (20 + team % 3)"}
RESOURCE_PRIORS = (4, 8, 16, 32, 64)
RESOURCE_SQL = (
    PLAYS_SQL
    + f", v as (select season, week, team, unnest({list(RESOURCE_COUNTS)}) as resource, unnest([{', '.join(f'sum({c})' for c in RESOURCE_COUNTS.values())}]) as amount, count(distinct game_id) as games from plays group by season, week, team), "
    + "tg as (select unnest([1999, 2000, 2001]) as target), past as (select target, v.*, power(0.65, target - 1 - season) as w from v, tg where season between target - 3 and target - 1), "
    + "t as (select target, resource, team, sum(w * amount) as x, sum(w * games) as n from past group by all), l as (select target, resource, sum(w * amount) / sum(w * games) as league from past group by all), "
    + "act as (select season as target, resource, team, we as window_end, sum(amount) / sum(games) as actual from v, (select unnest([4, 8, 18]) as we) where week <= we group by all), "
    + f"pr as (select target, resource, team, unnest(['league', 'raw', {', '.join(repr(f'p{p}') for p in RESOURCE_PRIORS)}]) as model, unnest([league, x / n, {', '.join(f'(x + {p} * league) / (n + {p})' for p in RESOURCE_PRIORS)}]) as forecast from t join l using (target, resource)), "
    + "rt as (select pr.*, window_end, actual, abs(forecast - actual) as error, case when target = 2001 then 'holdout' else 'development' end as segment from pr join act using (target, resource, team)), "
    + "rd as (select unnest(['ALL', resource]) || '|' || c.segment || '|' || c.window_end || '|' || c.model as scope, target || '|' || team as cluster, c.error - b.error as delta from rt c join rt b using (target, resource, team, window_end) where c.model <> 'league' and b.model = 'league'), "
    + driver_sql.cluster_bootstrap("rd", SAMPLES, 0.90)
    + ", cp as (select split_part(scope, '|', 1) as metric, split_part(scope, '|', 2) as segment, split_part(scope, '|', 3)::int as window_end, split_part(scope, '|', 4) as challenger, * from br), "
    + "mw as (select resource as metric, segment, window_end, model, avg(error) as e from rt group by all), me as (select metric, segment, model, sum(e) / 3 as mean from mw group by all), "
    + "ch as (select metric, arg_min(model, (mean, model)) as candidate from me where segment = 'development' and model <> 'league' group by 1), "
    + "gt as (select metric, candidate, sum((segment = 'development' and mean_delta < 0)::int)::bigint as development_wins, sum((segment = 'holdout' and mean_delta < 0)::int)::bigint as holdout_wins, sum((segment = 'holdout' and high < 0)::int)::bigint as clear_wins, sum((segment = 'holdout' and low > 0)::int)::bigint as clear_losses from ch join cp using (metric) where challenger = candidate group by all), "
    + "dc as (select *, development_wins = 3 and holdout_wins = 3 and clear_wins >= 2 and clear_losses = 0 as passed from gt), "
    + "fd as (select dc.*, case when passed then candidate else 'league' end as selected, a.mean as candidate_development, b.mean as baseline_development, c.mean as candidate_holdout, d.mean as baseline_holdout from dc join me a on a.metric = dc.metric and a.segment = 'development' and a.model = candidate join me b on b.metric = dc.metric and b.segment = 'development' and b.model = 'league' join me c on c.metric = dc.metric and c.segment = 'holdout' and c.model = candidate join me d on d.metric = dc.metric and d.segment = 'holdout' and d.model = 'league')"
)


def resource_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = plays(spark, sf_dir).groupBy("season", "week", "team").agg(*[F.sum(F.expr(c)).alias(r) for r, c in RESOURCE_COUNTS.items()], F.countDistinct("game_id").alias("games"))
    values = weeks.unpivot(["season", "week", "team", "games"], list(RESOURCE_COUNTS), "resource", "amount")
    return stored(backtests.rate_backtest(stored(values, "resource-weeks"), (1999, 2000, 2001), priors=RESOURCE_PRIORS, keys=["resource"]), "resource-rates")


@query("e17_segment_comparisons", RESOURCE_SQL + f" select metric, segment, window_end, challenger, {driver_sql.BOOTSTRAP_COLUMNS} from cp")
def e17_segment_comparisons(spark, sf_dir):
    return backtests.segment_comparisons(resource_rates(spark, sf_dir), 2001, "resource", samples=SAMPLES)


@query("e17_rate_decision", RESOURCE_SQL + " select metric, candidate, round(candidate_development, 6) as candidate_development, round(baseline_development, 6) as baseline_development, round(candidate_holdout, 6) as candidate_holdout, round(baseline_holdout, 6) as baseline_holdout, development_wins, holdout_wins, clear_wins, clear_losses, passed, selected from fd")
def e17_rate_decision(spark, sf_dir):
    rows = resource_rates(spark, sf_dir)
    return backtests.rate_decision(rows, backtests.segment_comparisons(rows, 2001, "resource", samples=SAMPLES), 2001, "resource")


@query(
    "e17_selected_calibration",
    RESOURCE_SQL + ", ow as (select rt.*, resource as metric from rt join fd on fd.metric = resource and fd.selected = model where window_end = 18), oo as (select metric, model, error, row_number() over (partition by metric order by error) as i, count(*) over (partition by metric) as n from ow where segment = 'development'), ra as (select metric, model, error as radius, n from oo where i = least(n, ceil((n + 1) * 0.9))), "
    "hl as (select ow.*, radius, n, greatest(0, forecast - radius) as lo, forecast + radius as hi from ow join ra using (metric, model) where segment = 'holdout') "
    "select metric, model, n as development_rows, round(any_value(radius), 6) as radius, count(*) as rows, sum((actual < lo)::int)::bigint as below, sum((actual > hi)::int)::bigint as above, round(avg(hi - lo), 6) as mean_width, round(1 - sum((actual < lo or actual > hi)::int) / count(*), 6) as rate from hl group by metric, model, n",
)
def e17_selected_calibration(spark, sf_dir):
    rows = resource_rates(spark, sf_dir)
    decision = backtests.rate_decision(rows, backtests.segment_comparisons(rows, 2001, "resource", samples=SAMPLES), 2001, "resource")
    return backtests.selected_calibration(rows, decision, 2001, "resource")


# E19 over three target seasons, each forecast from the season before it.
E19_SEASONS = (1999, 2000, 2001)
E19_SQL = (
    PLAYS_SQL
    + f", ep as (select * from plays where {ELIGIBLE}), st as (select season, team, sum(pass)::double / count(*) as pass_rate, sum(success)::double / count(*) as success_rate from ep group by all), "
    + f"pr as (select season + 1 as season, team, unnest(['pass_rate', 'success_rate']) as metric, unnest([pass_rate, success_rate]) as value from st where season + 1 in {E19_SEASONS}), lg as (select season, metric, median(value) as league from pr group by all), "
    + f"wk as (select season, we as window_end, team, sum(pass)::double / count(*) as pass_rate, sum(success)::double / count(*) as success_rate from ep, (select unnest([6, 8]) as we) where season in {E19_SEASONS} and week <= we group by all), ac as (select season, team, window_end, unnest(['pass_rate', 'success_rate']) as metric, unnest([pass_rate, success_rate]) as actual from wk), "
    + "co as (select distinct season, team, case team % 3 when 0 then 'returning' when 1 then 'changed_with_anchor' else 'changed_without_anchor' end as cohort, case when team % 3 = 1 then team - 1 end as anchor_team from pr), "
    + "j as (select pr.season, pr.team, pr.metric, cohort, pr.value as persistence, league, an.value as anchor from pr join lg using (season, metric) join co on co.season = pr.season and co.team = pr.team left join pr an on an.season = co.season and an.team = co.anchor_team and an.metric = pr.metric), "
    + "f as (select season, team, metric, unnest(['shrunken', 'caller_aware']) as model, unnest([0.8 * persistence + 0.2 * league, case cohort when 'returning' then 0.95 * persistence + 0.05 * league when 'changed_with_anchor' then 0.7 * anchor + 0.2 * persistence + 0.1 * league else 0.6 * persistence + 0.4 * league end]) as forecast from j), "
    + "tr as (select f.*, window_end, abs(forecast - actual) / 0.05 as error from f join ac using (season, team, metric) where forecast is not null), "
    + "pe as (select c.season, c.team, c.window_end, avg(c.error - b.error) as delta from tr c join tr b using (season, team, window_end, metric) where c.model = 'caller_aware' and b.model = 'shrunken' group by all), "
    + f"sc as (select unnest(list_filter(['pooled', 'season_' || season, {', '.join(f'case when season <> {s} then {chr(39)}without_{s}{chr(39)} end' for s in E19_SEASONS)}], lambda x: x is not null)) || '|' || window_end as scope, team as cluster, delta from pe), "
    + driver_sql.cluster_bootstrap("sc", SAMPLES, 0.95, exact_to=7, pooled=True)
)


def transition_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [transitions(spark, sf_dir, season).withColumn("season", F.lit(season)) for season in E19_SEASONS]
    return stored(parts[0].unionByName(parts[1]).unionByName(parts[2]), "transitions")


@query("e19_transition_evaluation", E19_SQL + f" select scope, {driver_sql.BOOTSTRAP_COLUMNS} from br")
def e19_transition_evaluation(spark, sf_dir):
    return backtests.transition_evaluation(transition_seasons(spark, sf_dir), 2001, samples=SAMPLES)[0]


@query(
    "e19_transition_decision",
    E19_SQL + ", d as (select split_part(scope, '|', 1) as s, round(mean_delta, 6) as mean, round(high, 6) as high from br), g as (select count(distinct s) filter (where s like 'season_%') as seasons, bool_and(mean < 0) filter (where s like 'season_%') as every_season_improves, bool_and(high < 0) filter (where s = 'pooled') as pooled_below_zero, bool_and(high < 0) filter (where s = 'season_2001') as holdout_below_zero, bool_and(high < 0) filter (where s like 'without_%') as leave_one_out_below_zero, bool_and(high < 0) filter (where s = 'without_2001') as development_below_zero from d) "
    "select *, seasons >= 3 and every_season_improves and pooled_below_zero and holdout_below_zero as promoted from g",
)
def e19_transition_decision(spark, sf_dir):
    effects, _ = backtests.transition_evaluation(transition_seasons(spark, sf_dir), 2001, samples=SAMPLES)
    return backtests.transition_decision(stored(effects, "effects"), 2001)
