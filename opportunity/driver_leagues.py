"""Queries over many leagues, transactions, stored decisions and staffs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from opportunity import driver_drafts, quality, stats
from opportunity.driver_drafts import F14_SQL, F17_SQL, STRATEGY
from opportunity.driver_evaluations import RESOURCE_SQL, resource_rates
from opportunity.driver_queries import BOARD_SQL, ORACLE_SQL, QUERIES, SAMPLES, STARTERS, _read, board, query, weekly
from opportunity.functions.stored import shared_path, stored
from opportunity.operators import aggregates as agg
from opportunity.operators import windows
from opportunity.plans import backtests, drafting, forecast, ownership
from opportunity.sources import bundles

__all__ = ["ORACLE_SQL", "QUERIES"]

# F16 and F17 ------------------------------------------------------------------------------

# Six leagues of 8 to 18 teams, half of them with a second flex slot that a quarterback may fill.
LEAGUE_SQL = (
    "lq as (select l as league_id, 8 + 2 * l as teams from (select unnest(range(0, 6)) as l)), lp as (select league_id, teams, player_id, position, points from board, lq where (player_id + league_id) % 4 <> 0), "
    "l0 as (select *, teams * case when position in ('RB', 'WR') then 2 else 1 end as want, row_number() over (partition by league_id, position order by points desc, player_id) as place from lp), "
    "l1 as (select *, place <= want as used, row_number() over (partition by league_id, place > want and position in ('RB', 'WR', 'TE') order by points desc, position desc, place) as f from l0), "
    "l2 as (select * exclude (used, f), used or (position in ('RB', 'WR', 'TE') and f <= teams) as used from l1), "
    "l3 as (select *, row_number() over (partition by league_id, not used and position <> 'K' order by points desc, position desc, place) as f from l2), "
    "l4 as (select *, used or (league_id % 2 = 1 and position <> 'K' and f <= teams) as taken from l3), "
    "ll as (select league_id, position, any_value(want) + sum((taken and place > want)::int)::bigint as demand, coalesce(max(case when place = 1 then points end), 0) as top, count(*) as n from l4 group by all), "
    "lr as (select ll.league_id, ll.position, demand, coalesce(l4.points, 0) as replacement from ll left join l4 on l4.league_id = ll.league_id and l4.position = ll.position and l4.place = least(demand, n))"
)


def league_levels(spark, sf_dir):
    leagues = spark.range(6).selectExpr("id as league_id", "8 + 2 * id as teams")
    players = board(spark, sf_dir).join(F.broadcast(leagues)).filter((F.col("player_id") + F.col("league_id")) % 4 != 0)  # six leagues
    slots = leagues.select("league_id", F.explode(F.array(*[F.struct(F.lit(p).alias("position"), (F.lit(n) * F.col("teams")).alias("starters")) for p, n in STARTERS.items()])).alias("s")).select("league_id", "s.*")
    flex = leagues.selectExpr("league_id", "0 as slot", "array('RB', 'WR', 'TE') as eligible", "teams as picks")
    flex = flex.unionByName(leagues.filter("league_id % 2 = 1").selectExpr("league_id", "1 as slot", "array('QB', 'RB', 'WR', 'TE') as eligible", "teams as picks"))
    return forecast.league_replacement_levels(players, slots, flex)


@query("f16_league_levels", BOARD_SQL + ", " + LEAGUE_SQL + " select league_id, position, demand, round(replacement, 6) as replacement from lr")
def f16_league_levels(spark, sf_dir):
    return league_levels(spark, sf_dir)


# F17 fed with the levels of F16: leagues 0 to 2 of it.
_LV = "lv as (select league_id, position, least(20, count(*)) as demand, quantile_disc(points, 0.6) as replacement from p group by all)"
assert _LV in F17_SQL
F17_LEAGUES_SQL = F17_SQL.replace(_LV, LEAGUE_SQL + ", lv as (select league_id, position, demand, replacement from lr where league_id < 3)")


@query("f17_league_scores", F17_LEAGUES_SQL + " select league_id, player_id, " + ", ".join(f"round({t}, 4) + 0.0 as {t}" for t in ("vorp_term", "need_term", "scarcity_term")) + " from y")
def f17_league_scores(spark, sf_dir):
    players, leagues = driver_drafts.f17_inputs(spark, sf_dir)
    scored = drafting.draft_scores(players, leagues, league_levels(spark, sf_dir), STRATEGY)
    return scored.select("league_id", "player_id", *[(F.round(t, 4) + 0.0).alias(t) for t in ("vorp_term", "need_term", "scarcity_term")])


# F14 ---------------------------------------------------------------------------------------


@query(
    "f14_shortlist",
    F14_SQL + ", z as (select player_id, position, round(score, 6) as score, un from y), fr as (select l.league_id, z.*, row_number() over (partition by l.league_id, position order by score desc, z.player_id) as n from z, (select unnest([0, 1]) as league_id) l where not exists (select 1 from o where o.league_id = l.league_id and o.player_id = z.player_id)) "
    "select league_id, player_id, position, score, 'waiver' as list from fr where n <= 10 union all select league_id, player_id, position, score, 'trade' from o join z using (player_id) where not mine",
)
def f14_shortlist(spark, sf_dir):
    rows = weekly(spark, sf_dir).withColumn("target_share", F.expr("cast(player_id * week % 10 as double)"))
    trends = windows.half_season_trend(rows, 18).join(rows.select("player_id", "position").distinct(), "player_id")
    scores = drafting.season_scores(trends).withColumn("score", F.round("score", 6))
    owners = scores.filter("position <> 'QB'").select("player_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("league_id")).withColumn("mine", F.col("player_id") % 2 == F.col("league_id"))
    return forecast.league_shortlist(scores.select("player_id", "position", "score"), owners, rows=10)


# F23 ---------------------------------------------------------------------------------------

LOG = {"league_id": "user_id % 50", "seq": "event_id", "kind": "case event_type when 'error' then 'undo' when 'view' then 'drop' else 'add' end", "player_id": "user_id", "owner": "event_id % 10", "slot": "event_id % 16"}
# The stack's depth goes step by step; a change stands if the level never falls below its own.
REPLAY_SQL = (
    f"with recursive t as (select {', '.join(f'{e} as {c}' for c, e in LOG.items())} from events), n as (select *, row_number() over (partition by league_id order by seq) as i from t), "
    "w(league_id, i, before, depth) as (select league_id, i, 0, case when kind = 'undo' then 0 else 1 end from n where i = 1 union all select n.league_id, n.i, w.depth, case when n.kind = 'undo' then greatest(0, w.depth - 1) else least(100, w.depth + 1) end from w join n on n.league_id = w.league_id and n.i = w.i + 1), "
    "e as (select n.*, before, case when kind <> 'undo' then 1 when before > 0 then -1 else 0 end as step from n join w using (league_id, i)), l as (select *, sum(step) over (partition by league_id order by i) as level from e), "
    "m as (select *, min(level) over (partition by league_id order by i rows between 1 following and unbounded following) as lowest from l), s as (select * from m where step = 1 and (lowest is null or lowest >= level))"
)


@query("f23_standing_changes", REPLAY_SQL + " select league_id, seq, kind from s")
def f23_standing_changes(spark, sf_dir):
    log = _read(spark, sf_dir, "events").selectExpr(*[f"{e} as {c}" for c, e in LOG.items()])
    return ownership.standing_changes(log).select("league_id", "seq", "kind")


ORACLE_SQL["f23_ownership_states"] = REPLAY_SQL + ", f as (select *, row_number() over (partition by league_id, player_id order by seq desc) as k from s) select league_id, player_id, owner, slot from f where k = 1 and kind = 'add'"


# The first error of each league: a slot below 2 is unknown, and undos need a history.
@query(
    "f23_rejected",
    REPLAY_SQL.replace("'view' then 'drop'", "'view' then 'add'") + ", b as (select league_id, seq, case when kind = 'undo' and before = 0 then 'nothing_to_undo' when kind = 'add' and slot < 2 then 'unknown_slot' end as reason from e) select league_id, min(seq) as seq, arg_min(reason, seq) as reason from b where reason is not null group by league_id",
)
def f23_rejected(spark, sf_dir):
    log = _read(spark, sf_dir, "events").selectExpr(*[f"{e} as {c}" for c, e in (LOG | {"kind": LOG["kind"].replace("'view' then 'drop'", "'view' then 'add'")}).items()])
    return ownership.rejected_transactions(log, slots=tuple(range(2, 16)))


# A16 ---------------------------------------------------------------------------------------

# Every third year's lines of an order are a team's duties; suppliers are people, parts tell the duty.
DUTIES = [*agg.CORE_RESPONSIBILITIES, "pass_game", "scouting"]
_DUTY = "case l_partkey % 9 " + " ".join(f"when {k} then '{d}'" for k, d in enumerate(DUTIES)) + " end"
CORE_SQL = (
    f"with d as (select year(l_shipdate) as season, l_suppkey % 32 as team, l_suppkey as person, {_DUTY} as duty from lineitem where l_quantity < 4), pr as (select distinct team, person, duty from d where season = 1996), cu as (select distinct team, person, duty from d where season = 1997), "
    f"co as (select c.team, c.duty, bool_or(exists (select 1 from pr p where p.team = c.team and p.duty = c.duty and p.person = c.person)) as kept from cu c where c.duty in {agg.CORE_RESPONSIBILITIES} and exists (select 1 from pr p where p.team = c.team and p.duty = c.duty) group by all), "
    "g as (select t.team, count(duty) as comparable, coalesce(sum(kept::int), 0)::bigint as retained from (select distinct team from cu) t left join co using (team) group by t.team)"
)


def core_staff(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").filter("l_quantity < 4").select(F.year("l_shipdate").alias("season"), (F.col("l_suppkey") % 32).alias("team"), F.col("l_suppkey").alias("person"), F.expr(_DUTY).alias("duty"))
    return [rows.filter(F.col("season") == s).select("team", "person", "duty").distinct() for s in (1996, 1997)]


@query("a16_core_continuity", CORE_SQL + " select team, comparable, retained, comparable - retained as changed, 7 - comparable as unavailable, round(coalesce(retained / nullif(comparable, 0), 0), 6) as core_share from g")
def a16_core_continuity(spark, sf_dir):
    return agg.core_continuity(*core_staff(spark, sf_dir)).select("team", "comparable", "retained", "changed", "unavailable", "core_share")


@query(
    "a16_continuity_index",
    CORE_SQL + ", ch as (select team, person, case when exists (select 1 from pr where pr.team = cu.team and pr.person = cu.person and pr.duty = cu.duty) then 'same_title' when exists (select 1 from pr where pr.team = cu.team and pr.person = cu.person) then 'changed' else 'new' end as status from cu), "
    "st as (select team, count(*) as staff, sum((status <> 'new')::int) as back from ch group by team) select team, round(100 * (0.5 * back / staff + 0.5 * coalesce(retained / nullif(comparable, 0), 0)), 6) as index from st join g using (team)",
)
def a16_continuity_index(spark, sf_dir):
    prior, current = core_staff(spark, sf_dir)
    same = prior.withColumn("_same", F.lit(True))
    known = prior.select("team", "person").distinct().withColumn("_known", F.lit(True))
    changes = current.join(same, ["team", "person", "duty"], "left").join(known, ["team", "person"], "left")
    changes = changes.select("team", F.when(F.col("_same"), "same_title").when(F.col("_known"), "changed").otherwise("new").alias("status"))
    return agg.continuity_index(changes, agg.core_continuity(prior, current)).select("team", "index")


# Q10 ---------------------------------------------------------------------------------------


@query(
    "q10_changed_decisions",
    RESOURCE_SQL + ", sd as (select metric, candidate, case when metric = 'PASSES' then 'raw' else selected end as selected from fd) select metric, 'stored' as side, selected from sd where metric = 'PASSES' union all select metric, 'recomputed', selected from fd where metric = 'PASSES'",
)
def q10_changed_decisions(spark, sf_dir):
    """A stored decision with one selection changed, against what its evaluations and comparisons give again."""
    rows = resource_rates(spark, sf_dir)
    compared = stored(backtests.segment_comparisons(rows, 2001, "resource", samples=SAMPLES), "comparisons")
    evaluations = stored(backtests.segment_evaluations(rows, 2001, "resource"), "evaluations")
    decision = stats.two_stage_gate(evaluations, compared.filter("metric <> 'ALL'"), "league", backtests.WINDOWS)
    kept = stored(decision.withColumn("selected", F.when(F.col("metric") == "PASSES", F.lit("raw")).otherwise(F.col("selected"))), "decision")
    return quality.decision_differences(evaluations, compared.filter("metric <> 'ALL'"), kept, "league", backtests.WINDOWS).select("metric", "side", "selected")


@query(
    "q10_changed_radii",
    RESOURCE_SQL + ", o as (select resource, window_end, error, row_number() over (partition by resource, window_end order by error) as i, count(*) over (partition by resource, window_end) as n from rt where model = 'p16' and segment = 'development'), r as (select resource, window_end, error as radius from o where i = least(n, ceil((n + 1) * 0.9))) "
    "select resource, window_end, 'stored' as side, round(radius + 0.5, 6) as radius from r where window_end = 4 union all select resource, window_end, 'recomputed', round(radius, 6) from r where window_end = 4",
)
def q10_changed_radii(spark, sf_dir):
    rows = resource_rates(spark, sf_dir).filter("model = 'p16' and target_season < 2001")
    kept = stats.conformal_radius(rows, ["resource", "window_end"], "error").withColumn("radius", F.when(F.col("window_end") == 4, F.col("radius") + 0.5).otherwise(F.col("radius")))
    return quality.radius_differences(rows, stored(kept, "radii"), ["resource", "window_end"], "error").select("resource", "window_end", "side", F.round("radius", 6).alias("radius"))


# F21 ---------------------------------------------------------------------------------------

_METRICS = {"opportunity": "size * 2", "highValue": "size % 50 * 2", "environment": "100 - size * 2"}
PERSONAL_SQL = BOARD_SQL + (
    ", b as (select player_id % 3 as draft_id, player_id, position, points / 100 as ds, case player_id % 3 when 0 then 'starter' when 1 then 'flex' else 'bench' end as status, size % 14 + 1 as rd, size % 5 as dr, size * 2 as sv, 0.5 + size % 10 / 10.0 as ps, size % 9 as rn, size % 4 as ov, size % 3 as sb, "
    "case when position <> 'K' then (size * 2 - 50) / 50.0 * (case position when 'QB' then 150 else 100 end - 100) / 100.0 * 2 + (size % 50 * 2 - 50) / 50.0 * (case position when 'RB' then 200 else 80 end - 100) / 100.0 * 2 + (100 - size * 2 - 50) / 50.0 * (0 - 100) / 100.0 * 2 else 0 end as pe from board), "
    "t as (select *, ds + pe + case status when 'starter' then 0.45 + least(1.0, (rd - 1) / 12.0) * 1.2 when 'flex' then 0.25 + least(1.0, (rd - 1) / 12.0) * 0.65 else 0 end + least(2.4, dr * 0.55) + greatest(-1.4, least(1.4, (50 - sv) / 50.0 * 1.4)) + greatest(-0.8, least(0.8, (ps - 1) * 0.9)) + least(1.28, rn * 0.16) - case when position = 'K' and rd < 12 then (12 - rd) * 0.65 else 0 end - case when status = 'bench' then greatest(1, ov + 1) * 0.8 else 0 end - 0.5 * sb as total from b)"
)


@query("f21_personal_board", PERSONAL_SQL + " select draft_id, player_id, round(pe, 6) + 0.0 as personal, row_number() over (partition by draft_id order by round(total, 9) desc, player_id) as rank from t")
def f21_personal_board(spark, sf_dir):
    rows = board(spark, sf_dir).selectExpr(
        "player_id % 3 as draft_id", "player_id", "position", "points / 100 as draft_score", "case player_id % 3 when 0 then 'starter' when 1 then 'flex' else 'bench' end as status", "size % 14 + 1 as round", "size % 5 as drop",
        "size * 2 as survival", "0.5D + size % 10 / 10 as pressure", "size % 9 as run", "size % 4 as over", "size % 3 as same_bye", "position <> 'K' as modeled", *[f"cast({e} as double) as {m}" for m, e in _METRICS.items()],
    )
    weights = {"QB": {"opportunity": 150.0, "highValue": 80.0, "environment": 0.0}, "RB": {"opportunity": 100.0, "highValue": 200.0, "environment": 0.0}, "WR": {"opportunity": 100.0, "highValue": 80.0, "environment": 0.0}, "TE": {"opportunity": 100.0, "highValue": 80.0, "environment": 0.0}}
    scored = rows.withColumn("personal", forecast.personal_score(F.col("position"), F.col("modeled"), weights))
    return forecast.live_board(scored).select("draft_id", "player_id", "personal", "rank")


# S14 and Q6 --------------------------------------------------------------------------------

_PART = "('0x' || substr(md5('=' || {key}), 1, 8))::bigint % 64"


@query(
    "q6_changed_parts",
    f"with c as (select *, {_PART.format(key='c_custkey')} as part from customer), s as (select *, {_PART.format(key='s_suppkey')} as part from supplier), x as (select part from c where c_custkey = (select max(c_custkey) from customer)), y as (select part from s where s_suppkey = (select min(s_suppkey) from supplier)) "
    "select 'customer' as \"table\", part, 'changed' as change, count(*) as rows from c where part in (select part from x) group by part union all select 'supplier', part, case when count(*) = 1 then 'missing' else 'changed' end, count(*) from s where part in (select part from y) group by part",
)
def q6_changed_parts(spark, sf_dir):
    """A customer is renamed and a supplier is lost: the parts that two trees tell apart, and how many rows those had."""
    tables = {n: _read(spark, sf_dir, n) for n in ("customer", "supplier")}
    keys = {"customer": ["c_custkey"], "supplier": ["s_suppkey"]}
    last = tables["customer"].agg(F.max("c_custkey")).first()[0]
    first = tables["supplier"].agg(F.min("s_suppkey")).first()[0]
    later = {"customer": tables["customer"].withColumn("c_name", F.when(F.col("c_custkey") == last, "Somebody").otherwise(F.col("c_name"))), "supplier": tables["supplier"].filter(F.col("s_suppkey") != first)}
    old = stored(bundles.bundle_tree(tables, keys), "tree")
    found = bundles.tree_differences(old, bundles.bundle_tree(later, keys))
    return found.join(old.select("table", "part", "rows"), ["table", "part"]).select("table", F.col("part").cast("long").alias("part"), "change", "rows")


@query("s14_bundle_round_trip", "select 'nation' as \"table\", count(*) as rows from nation union all select 'orders', count(*) from orders")
def s14_bundle_round_trip(spark, sf_dir):
    """Two tables written as a bundle and read back verified."""
    tables = {n: _read(spark, sf_dir, n) for n in ("nation", "orders")}
    root = shared_path(spark, "bundles")
    bundles.write_bundle(tables, root, "first", {"orders": ["o_orderkey"]}, parameters={"season": 2000})
    back = bundles.read_bundle(spark, root, "first", parameters={"season": 2000})
    return back["nation"].agg(F.lit("nation").alias("table"), F.count("*").alias("rows")).unionByName(back["orders"].agg(F.lit("orders").alias("table"), F.count("*").alias("rows")))
