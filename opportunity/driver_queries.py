"""Queries over the driver's tables, and the SQL that should return the same rows.

Each query shapes a driver table into one of the library's tables by a plain select, then calls
the library. The stand-ins are lists of expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opportunity import driver_sql, quality, stats
from opportunity.functions import clean
from opportunity.functions.stored import stored
from opportunity.operators import aggregates as agg
from opportunity.operators import joins, windows
from opportunity.plans import backtests, forecast

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PLAYS = {
    "season": "year(l_shipdate)",
    "week": "cast(least(18, floor((dayofyear(l_shipdate) - 1) / 20.0) + 1) as int)",
    "team": "l_suppkey % 32",
    "game_id": "l_orderkey",
    "down": "l_linenumber % 4 + 1",
    "qtr": "l_orderkey % 4 + 1",
    "pass": "case when l_returnflag <> 'N' then 1 else 0 end",
    "rush": "case when l_returnflag <> 'N' then 0 else 1 end",
    "qb_kneel": "case when l_partkey % 50 = 0 then 1 else 0 end",
    "qb_spike": "0",
    "qb_scramble": "case when l_partkey % 7 = 0 then 1 else 0 end",
    "wp": "l_tax * 10",
    "yardline_100": "2 * l_quantity",
    "air_yards": "case when l_returnflag <> 'N' and l_partkey % 13 <> 0 then round(200 * l_discount) - 5 end",
    "yards_gained": "l_quantity - 10",
    "pass_oe": "case when l_partkey % 5 <> 0 then l_discount - 0.05 end",
    "shotgun": "case when l_linestatus = 'O' then 1 when l_partkey % 3 = 0 then null else 0 end",
    "no_huddle": "case when l_orderkey % 5 = 0 then 1 else 0 end",
    "success": "case when l_quantity > 25 then 1 else 0 end",
    "epa": "l_discount * 10 - 0.5",
    "receiver_id": "case when l_returnflag <> 'N' and l_partkey % 11 <> 0 then l_partkey end",
    "rusher_id": "case when l_returnflag = 'N' then l_partkey end",
    "ydstogo": "l_quantity % 10",
    "half_seconds_remaining": "(l_suppkey * 37) % 1800",
    "goal_to_go": "case when l_quantity <= 4 then 1 else 0 end",
    "read_code": "case l_orderkey % 4 when 0 then '0' when 1 then 'CHK' when 2 then '1' end",
}
ROSTER = {
    "player_id": "p_partkey",
    "position": "case p_type when 'ECONOMY' then 'QB' when 'STANDARD' then 'RB' when 'PROMO' then 'WR' when 'SMALL' then 'TE' else 'OTHER' end",
}
CHARTING = {
    "game_id": "o_orderkey",
    "is_motion": "case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then false end",
    "is_play_action": "o_orderpriority like '1%'",
    "is_screen_pass": "o_orderpriority like '2%'",
    "is_rpo": "o_orderpriority like '3%'",
    "is_qb_out_of_pocket": "o_orderpriority like '4%'",
    "is_qb_sneak": "o_custkey % 10 = 0",
    "qb_location": "case o_custkey % 4 when 0 then 'U' when 1 then 'S' when 2 then 'P' end",
    "backfield": "case when o_custkey % 7 < 5 then o_custkey % 7 end",
}
USAGE = {
    "player_id": "user_id",
    "week": "cast(floor((day(ts) - 1) / 2.0) + 1 as int)",
    "position": "case user_id % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end",
    "team": "user_id % 8",
    "role": "event_type",
    "volume": "value",
    "event_id": "event_id",
}
BOARD = {
    "player_id": "p_partkey",
    "position": "case p_type when 'ECONOMY' then 'QB' when 'STANDARD' then 'RB' when 'PROMO' then 'WR' when 'SMALL' then 'TE' else 'K' end",
    "points": "p_retailprice",
    "size": "p_size",
}


def _cte(name: str, columns: dict[str, str], table: str, where: str = "") -> str:
    return f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table} {where})"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _stand_in(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return _read(spark, sf_dir, table).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stand_in(spark, sf_dir, "part", ROSTER).filter("player_id % 9 <> 0")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stand_in(spark, sf_dir, "lineitem", PLAYS)
    known = roster(spark, sf_dir)
    found = joins.with_positions(found, known, "receiver_id", "receiver_position")
    return joins.with_positions(found, known, "rusher_id", "rusher_position")


PLAYS_SQL = f"""
with raw as (select {', '.join(f'{e} as {c}' for c, e in PLAYS.items())} from lineitem),
roster as (select {', '.join(f'{e} as {c}' for c, e in ROSTER.items())} from part where p_partkey % 9 <> 0),
plays as (
  select raw.*, case when receiver_id is not null then coalesce(r1.position, 'UNKNOWN') end as receiver_position,
    case when rusher_id is not null then coalesce(r2.position, 'UNKNOWN') end as rusher_position
  from raw left join roster r1 on r1.player_id = receiver_id left join roster r2 on r2.player_id = rusher_id
)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stand_in(spark, sf_dir, "events", USAGE)


USAGE_SQL = "with " + _cte("usage", USAGE, "events")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).groupBy("player_id", "week", "position", "team").agg(F.round(F.sum("volume"), 6).alias("volume"))


WEEKLY_SQL = USAGE_SQL + ", weekly as (select player_id, week, position, team, round(sum(volume), 6) as volume from usage group by all)"


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stand_in(spark, sf_dir, "part", BOARD)


BOARD_SQL = "with " + _cte("board", BOARD, "part")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long, so that both engines print alike."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind == "double":
            out.append((F.round(col, digits) + 0.0).alias(name))
        elif kind in ("int", "bigint", "smallint") or kind.startswith("decimal"):
            out.append(col.cast("long").alias(name))
        elif kind == "date":
            out.append(col.cast("string").alias(name))
        else:
            out.append(col)
    return df.select(*out)


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be null as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL where SQL can say the same."""

    def add(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def _rate(flag: str, known: str = "true") -> str:
    return f"round(sum(case when {known} and {flag} then 1 when {known} then 0 end)::double / nullif(sum(case when {known} then 1 else 0 end), 0), 6)"


STYLE_RATES = {
    "pass_rate": _rate("pass = 1"),
    "neutral_early_down_pass_rate": _rate("pass = 1", "(down in (1, 2) and qtr between 1 and 3 and wp between 0.20 and 0.80)"),
    "shotgun_rate": _rate("shotgun = 1", "shotgun is not null"),
    "no_huddle_rate": _rate("no_huddle = 1", "no_huddle is not null"),
    "red_zone_pass_rate": _rate("pass = 1", "yardline_100 <= 20"),
    "deep_attempt_rate": _rate("air_yards >= 15", "(pass = 1 and air_yards is not null)"),
    "qb_scramble_rate": _rate("qb_scramble = 1", "pass = 1"),
    "designed_qb_run_share": _rate("(coalesce(rusher_position, '') = 'QB' and qb_scramble <> 1)", "rush = 1"),
    "explosive_play_rate": _rate("((pass = 1 and yards_gained >= 20) or (rush = 1 and yards_gained >= 10))"),
    "success_rate": _rate("success = 1", "success is not null"),
    **{f"{p.lower()}_target_share": _rate(f"receiver_position = '{p}'", "(pass = 1 and receiver_position is not null)") for p in ("RB", "WR", "TE", "OTHER", "UNKNOWN")},
}
STYLE_MEANS = {
    "neutral_pass_oe": "round(avg(case when down in (1, 2) and qtr between 1 and 3 and wp between 0.20 and 0.80 then pass_oe end), 6) + 0.0",
    "mean_air_yards": "round(avg(case when pass = 1 then air_yards end), 6) + 0.0",
    "epa_per_play": "round(avg(epa), 6) + 0.0",
}
STYLE_SELECT = "season::bigint as season, team::bigint as team, count(distinct game_id) as games, count(*) as plays, round(count(*)::double / count(distinct game_id), 6) as plays_per_game"
STYLE_COLUMNS = ", ".join(f"{e} as {n}" for n, e in {**STYLE_RATES, **STYLE_MEANS}.items())
ELIGIBLE = "down between 1 and 4 and qb_kneel <> 1 and qb_spike <> 1"


@query("a1_team_style", f"{PLAYS_SQL} select {STYLE_SELECT}, {STYLE_COLUMNS} from plays where {ELIGIBLE} group by season, team")
def a1_team_style(spark, sf_dir):
    return agg.team_style(plays(spark, sf_dir))


@query("a1_team_style_weeks", f"{PLAYS_SQL} select {STYLE_SELECT}, {STYLE_COLUMNS} from plays where {ELIGIBLE} and week between 1 and 8 group by season, team")
def a1_team_style_weeks(spark, sf_dir):
    return agg.team_style(plays(spark, sf_dir), weeks=(1, 8))


CHARTED = {n: _rate(c, f"charted and {c} is not null") for n, c in agg.CHARTING_RATES.items()}
CHARTED |= {
    "under_center_rate": _rate("qb_location = 'U'", "charted and qb_location is not null"),
    "pistol_rate": _rate("qb_location = 'P'", "charted and qb_location is not null"),
    "charting_coverage_rate": _rate("charted"),
    "multi_back_rate": _rate("backfield >= 2", "charted and backfield is not null"),
}


@query(
    "j2_charted_style",
    f"{PLAYS_SQL}, {_cte('charting', CHARTING, 'orders', 'where o_orderkey % 3 <> 0')}, charted as (select plays.*, c.* exclude (game_id), c.game_id is not null as charted from plays left join charting c on plays.game_id = c.game_id) "
    f"select season::bigint as season, team::bigint as team, count(*) as plays, {', '.join(f'{e} as {n}' for n, e in CHARTED.items())} from charted where {ELIGIBLE} group by season, team",
)
def j2_charted_style(spark, sf_dir):
    charting = _stand_in(spark, sf_dir, "orders", CHARTING).filter("game_id % 3 <> 0")
    style = agg.team_style(joins.with_charting(plays(spark, sf_dir), charting, ["game_id"]), charted=True)
    return style.select("season", "team", "plays", *CHARTED)


@query("j1_positions", f"{PLAYS_SQL} select receiver_position, rusher_position, count(*) as plays from plays group by all")
def j1_positions(spark, sf_dir):
    return plays(spark, sf_dir).groupBy("receiver_position", "rusher_position").agg(F.count("*").alias("plays"))


@query(
    "a2_mode_with_ties",
    f"{PLAYS_SQL}, c as (select team, week, count(*) as n from plays group by all) select team, arg_min(week, (-n) * 100 + week)::bigint as week, count(*) as \"values\" from c group by team",
)
def a2_mode_with_ties(spark, sf_dir):
    return agg.mode_with_ties(plays(spark, sf_dir), ["team"], "week")


EVENT_SQL = {
    "targets_with_air_yards": "air_yards is not null",
    "deep_targets": "air_yards >= 15",
    "end_zone_targets": "air_yards >= yardline_100",
    "red_zone_targets": "yardline_100 <= 20",
    "inside_10_targets": "yardline_100 <= 10",
    "two_minute_targets": "qtr in (2, 4) and half_seconds_remaining between 0 and 120",
    "third_fourth_down_targets": "down in (3, 4)",
    "red_zone_carries": "yardline_100 <= 20",
    "inside_10_carries": "yardline_100 <= 10",
    "inside_5_carries": "yardline_100 <= 5",
    "goal_to_go_carries": "goal_to_go = 1",
    "short_yardage_carries": "ydstogo > 0 and ydstogo <= 2",
    "third_fourth_short_carries": "ydstogo > 0 and ydstogo <= 2 and down in (3, 4)",
    "two_minute_carries": "qtr in (2, 4) and half_seconds_remaining between 0 and 120",
    "qb_scramble_carries": "position = 'QB' and qb_scramble = 1",
    "designed_qb_carries": "position = 'QB' and qb_scramble <> 1",
    "designed_qb_red_zone_carries": "position = 'QB' and qb_scramble <> 1 and yardline_100 <= 20",
    "designed_qb_inside_10_carries": "position = 'QB' and qb_scramble <> 1 and yardline_100 <= 10",
    "designed_qb_inside_5_carries": "position = 'QB' and qb_scramble <> 1 and yardline_100 <= 5",
}
READ_SQL = {
    "charted_targets": ("read_code is not null", 1997),
    "read_labeled_targets": ("read_code is not null", 1997),
    "first_read_targets": ("read_code = '0'", 1999),
    "second_read_targets": ("read_code = '1'", 1997),
    "third_later_read_targets": ("read_code = '2'", 1997),
    "designed_targets": ("read_code = 'DES'", 1997),
    "checkdown_targets": ("read_code = 'CHK'", 1997),
    "scramble_drill_targets": ("read_code = 'SD'", 1997),
}
EVENTS_SQL = (
    PLAYS_SQL
    + ", rows as (select *, receiver_id as player_id, receiver_position as position, 'target' as kind from plays where pass = 1 and receiver_id is not null union all select *, rusher_id, rusher_position, 'carry' from plays where rush = 1 and rusher_id is not null), "
    + "pw as (select season::bigint as season, week::bigint as week, team, player_id, position, sum((kind = 'target')::int)::bigint as targets, sum((kind = 'carry')::int)::bigint as carries, "
    + ", ".join(f"sum(case when kind = '{'target' if 'target' in n else 'carry'}' and ({e}) then 1 else 0 end)::bigint as {n}" for n, e in EVENT_SQL.items())
    + ", round(sum(case when kind = 'target' then coalesce(air_yards, 0) else 0 end), 3) as target_air_yards"
    + "".join(
        f", case when season >= {s} then sum(case when kind = 'target' and ({e}) then 1 else 0 end)::double end as {n}"
        for n, (e, s) in READ_SQL.items()
    )
    + " from rows group by season, week, team, player_id, position)"
)


def player_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = agg.player_week_events(plays(spark, sf_dir), read_from=1997, first_read_from=1999)
    return as_double(events, *READ_SQL)


@query("a3_player_week_events", EVENTS_SQL + " select * from pw")
def a3_player_week_events(spark, sf_dir):
    return player_weeks(spark, sf_dir)


@query(
    "a4_team_week_events",
    EVENTS_SQL + " select season, week, team, position, count(*) as player_count, sum(targets)::bigint as targets, sum(first_read_targets) as first_read_targets, sum(inside_5_carries)::bigint as inside_5_carries from pw group by season, week, team, position",
)
def a4_team_week_events(spark, sf_dir):
    return agg.team_week_events(player_weeks(spark, sf_dir), ["targets", "first_read_targets", "inside_5_carries"])


COVERAGE_SQL = EVENTS_SQL + (
    ", cov as (select season, count(distinct team) as teams, count(distinct week) as weeks, sum(targets)::bigint as targets, "
    "round(sum(case when position <> 'UNKNOWN' then targets else 0 end)::double / sum(targets), 6) as mapped_rate, round(sum(charted_targets)::double / sum(targets), 6) as charted_rate, round(sum(read_labeled_targets)::double / sum(targets), 6) as label_rate, "
    "sum(read_labeled_targets - coalesce(first_read_targets, 0) - second_read_targets - third_later_read_targets - designed_targets - checkdown_targets - scramble_drill_targets) as unknown_codes from pw group by season)"
)


@query("a5_event_coverage", COVERAGE_SQL + " select * from cov")
def a5_event_coverage(spark, sf_dir):
    return agg.event_coverage(player_weeks(spark, sf_dir))


@query(
    "a6_source_review",
    COVERAGE_SQL + ", ex as (select season::bigint as season, 'unmapped_player' as issue from pw where position = 'UNKNOWN') select season, issue, count(*) as rows from ex group by all "
    "union all select season, 'low_mapped_rate', 1 from cov where mapped_rate < 0.9 union all select season, 'no_labels', 1 from cov where label_rate is null",
)
def a6_source_review(spark, sf_dir):
    events = player_weeks(spark, sf_dir)
    exceptions = events.filter("position = 'UNKNOWN'").select("season", F.lit("unmapped_player").alias("issue"))
    rules = {"low_mapped_rate": F.col("mapped_rate") < 0.9, "no_labels": F.col("label_rate").isNull()}
    return agg.source_review(exceptions, agg.event_coverage(events), rules)


def season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "lineitem").selectExpr(
        "year(l_shipdate) as season", "1 as week", "l_suppkey % 32 as team", "l_partkey as player_id", "l_orderkey % 50 as game_id", "l_quantity as carries", "l_linenumber as targets", "l_quantity + l_linenumber as snaps"
    )
    return found.join(_stand_in(spark, sf_dir, "part", ROSTER), "player_id")


SEASON_SQL = f"""with weekly as (select year(l_shipdate)::bigint as season, l_suppkey % 32 as team, l_partkey as player_id, l_orderkey % 50 as game_id, l_quantity as carries, l_linenumber as targets, l_quantity + l_linenumber as snaps, position
from lineitem join (select {', '.join(f'{e} as {c}' for c, e in ROSTER.items())} from part) r on l_partkey = r.player_id),
player as (select season, team, player_id, position, count(distinct game_id) as games, sum(carries) as carries, sum(targets)::bigint as targets, sum(snaps) as snaps from weekly group by season, team, player_id, position),
tm as (select season, team, sum(m) as team_snaps from (select season, team, game_id, max(snaps) as m from weekly group by all) group by season, team),
room as (select season, team, position, sum(carries) as room_carries, sum(targets)::bigint as room_targets from player group by all)"""


@query(
    "a7_season_usage",
    SEASON_SQL + " select player.*, team_snaps, room_carries, room_targets, round(carries / room_carries, 6) as carry_share, round(targets::double / room_targets, 6) as target_share, round(snaps / team_snaps, 6) as snap_share from player join tm using (season, team) join room using (season, team, position)",
)
def a7_season_usage(spark, sf_dir):
    return agg.season_usage(season_rows(spark, sf_dir))


HISTORY_SQL = SEASON_SQL + (
    ", used as (select player.*, room_carries from player join room using (season, team, position)), "
    "targets as (select player_id, 2000 as target_season, min(team) as target_team from player where season = 2000 group by player_id), "
    "hist as (select h.*, t.target_season, t.target_team, power(0.65, 2000 - 1 - h.season) * case when h.team = t.target_team then 1.0 else 0.7 end as weight from used h join targets t using (player_id) where h.season between 1997 and 1999)"
)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = agg.season_usage(season_rows(spark, sf_dir))
    targets = used.filter("season = 2000").groupBy("player_id").agg(F.min("team").alias("team")).withColumn("target_season", F.lit(2000))
    return joins.prior_history(targets, used, lookback=3)


@query(
    "j9_a8_historical_share",
    HISTORY_SQL + " select player_id, target_season::bigint as target_season, target_team, round(coalesce(sum(weight * carries) / nullif(sum(weight * room_carries), 0), 0), 6) as share, round(sum(weight * games), 6) as weighted_games, count(distinct season) as season_count, arg_max(team, season * 1000 + team) as latest_team, any_value(latest_teams) as latest_teams, bool_or(season = last and team = target_team) as same_team "
    "from hist join (select player_id, max(season) as last, string_agg(distinct team::varchar, ',' order by team::varchar) filter (where season = ms) as latest_teams from (select *, max(season) over (partition by player_id) as ms from hist) group by player_id) using (player_id) group by player_id, target_season, target_team",
)
def j9_a8_historical_share(spark, sf_dir):
    found = agg.historical_share(history(spark, sf_dir), "carries", "room_carries")
    return found.withColumn("latest_teams", F.array_join(F.array_sort(F.col("latest_teams").cast("array<string>")), ","))


@query(
    "a9_conversion_factors",
    SEASON_SQL + ", st as (select season, team, count(*) as plays from weekly group by all), us as (select season, team, sum(carries) as carries, sum(targets) as targets from player group by all) select round(sum(power(0.65, 2001 - season) * carries) / sum(power(0.65, 2001 - season) * plays), 6) as carries_per_play, round(sum(power(0.65, 2001 - season) * targets) / sum(power(0.65, 2001 - season) * plays), 6) as targets_per_play from us join st using (season, team)",
)
def a9_conversion_factors(spark, sf_dir):
    rows = season_rows(spark, sf_dir)
    style = rows.groupBy("season", "team").agg(F.count("*").alias("plays"))
    used = rows.groupBy("season", "team").agg(F.sum("carries").alias("carries"), F.sum("targets").alias("targets"))
    return agg.conversion_factors(used, style, 2001, {"carries_per_play": ("carries", "plays"), "targets_per_play": ("targets", "plays")})


STATUS = "case event_type when 'click' then 'active_53' when 'view' then 'active_53' when 'error' then 'reserve_other' else 'practice_squad' end"
STATUS_SQL = f"with st as (select user_id % 3 as season, day(ts) % 6 + 1 as week, {STATUS} as family, case user_id % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position, case when value > 20 then 1 else 0 end as active from events), sp as (select season, week, active, unnest(list_distinct([family, case when family = 'active_53' then 'active_53' else 'nonactive' end])) as family, position from st), sp2 as (select season, week, active, family, unnest([position, 'ALL']) as position from sp), cnt as (select season::bigint as season, week::bigint as week, family, position, count(*) as trials, sum(active)::bigint as successes from sp2 group by all)"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "events").selectExpr("user_id % 3 as season", "day(ts) % 6 + 1 as week", f"{STATUS} as family", f"{USAGE['position']} as position", "case when value > 20 then 1 else 0 end as active")
    return agg.status_cohort_counts(found)


@query("a10_status_cohorts", STATUS_SQL + " select * from cnt")
def a10_status_cohorts(spark, sf_dir):
    return statuses(spark, sf_dir)


@query(
    "a11_leave_one_out",
    STATUS_SQL + " select week, family, position, season, (sum(trials) over w - trials)::bigint as trials, (sum(successes) over w - successes)::bigint as successes from cnt window w as (partition by week, family, position)",
)
def a11_leave_one_out(spark, sf_dir):
    return agg.leave_one_out(statuses(spark, sf_dir), ["week", "family", "position"], "season", ["trials", "successes"])


FALLBACK_SQL = STATUS_SQL + (
    ", pool as (select week, family, position, sum(trials)::bigint as trials, sum(successes)::bigint as successes from cnt group by all), "
    "asked as (select distinct week, family, position from pool where position <> 'ALL' and family <> 'nonactive'), "
    "f as (select a.week, a.family, a.position, case when p0.trials >= 150 then p0.trials when p1.trials >= 150 then p1.trials else p2.trials end as trials, "
    "case when p0.trials >= 150 then p0.successes when p1.trials >= 150 then p1.successes else p2.successes end as successes, "
    "case when p0.trials >= 150 then 'position' when p1.trials >= 150 then 'all_positions' when p2.trials >= 150 then 'active_flag' else 'weak_active_flag' end as level from asked a "
    "left join pool p0 on p0.week = a.week and p0.family = a.family and p0.position = a.position left join pool p1 on p1.week = a.week and p1.family = a.family and p1.position = 'ALL' "
    "left join pool p2 on p2.week = a.week and p2.family = case when a.family = 'active_53' then 'active_53' else 'nonactive' end and p2.position = 'ALL')"
)


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = statuses(spark, sf_dir).groupBy("week", "family", "position").agg(F.sum("trials").alias("trials"), F.sum("successes").alias("successes"))
    asked = pool.filter("position <> 'ALL' and family <> 'nonactive'").select("week", "family", "position")
    flag = F.when(F.col("family") == "active_53", "active_53").otherwise("nonactive")
    levels = [("position", F.col("family"), F.col("position")), ("all_positions", F.col("family"), F.lit("ALL")), ("active_flag", flag, F.lit("ALL"))]
    return agg.cohort_fallback(asked, pool, levels, min_n=150)


@query("a12_cohort_fallback", FALLBACK_SQL + " select * from f")
def a12_cohort_fallback(spark, sf_dir):
    return fallback(spark, sf_dir)


@query(
    "e5_f8_availability",
    FALLBACK_SQL + ", w as (select *, successes::double / trials as p, 1 + 2.706025 / trials as s from f) select week, family, position, trials, successes, level, week = 3 as bye, case when family <> 'active_53' then 2 end::double as min_missed, "
    "case when week = 3 or (family <> 'active_53' and week <= 2) then 0.0 else round(greatest(0, ((p + 2.706025 / (2 * trials)) - 1.645 * sqrt(p * (1 - p) / trials + 2.706025 / (4 * trials * trials))) / s), 6) end as p_low, "
    "case when week = 3 or (family <> 'active_53' and week <= 2) then 0.0 else round((successes + 1.0) / (trials + 2.0), 6) end as p_mean, "
    "case when week = 3 or (family <> 'active_53' and week <= 2) then 0.0 else round(least(1, ((p + 2.706025 / (2 * trials)) + 1.645 * sqrt(p * (1 - p) / trials + 2.706025 / (4 * trials * trials))) / s), 6) end as p_high from w",
)
def e5_f8_availability(spark, sf_dir):
    rows = fallback(spark, sf_dir).withColumn("bye", F.col("week") == 3).withColumn("min_missed", F.when(F.col("family") != "active_53", 2))
    return as_double(forecast.weekly_availability(rows), "min_missed")


@query(
    "a13_weighted_std",
    WEEKLY_SQL + ", m as (select position, sum(week) as w, sum(week * volume) as x, sum(week * volume * volume) as xx from weekly group by position) select position, round(x / w, 6) as mean, round(sqrt(xx / w - (x / w) * (x / w)), 6) as std from m",
)
def a13_weighted_std(spark, sf_dir):
    return agg.weighted_std(weekly(spark, sf_dir), ["position"], "volume", "week")


@query("a14_league_median", f"{PLAYS_SQL}, s as (select season, team, {STYLE_RATES['pass_rate'][6:-4]} as pass_rate, {STYLE_RATES['success_rate'][6:-4]} as success_rate from plays where {ELIGIBLE} group by all) select season::bigint as season, metric, round(median(value), 6) as median from (unpivot s on pass_rate, success_rate into name metric value value) group by all")
def a14_league_median(spark, sf_dir):
    return agg.league_median(agg.team_style(plays(spark, sf_dir)), ["pass_rate", "success_rate"])


@query("a15_percentiles", WEEKLY_SQL + " select position, week::bigint as week, round(quantile_cont(volume, 0.1), 6) as p10, round(quantile_cont(volume, 0.5), 6) as p50, round(quantile_cont(volume, 0.9), 6) as p90 from weekly group by position, week")
def a15_percentiles(spark, sf_dir):
    return agg.exact_percentiles(weekly(spark, sf_dir), ["position", "week"], "volume", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


STAFF_SQL = "with cur as (select c_nationkey as team, c_custkey % 40 as person, 'title' || (c_custkey % 5) as title, 'duty' || (c_custkey % 3) as duty from customer where c_custkey % 2 = 0), old as (select c_nationkey as team, c_custkey % 40 as person, list('title' || (c_custkey % 7)) as titles, list('duty' || (c_custkey % 4)) as duties from customer where c_custkey % 2 = 1 or c_custkey % 6 = 0 group by all), ch as (select cur.*, case when titles is null then 'new' when list_contains(titles, title) then 'same_title' when list_contains(duties, duty) then 'same_responsibility' else 'changed_responsibility' end as status from cur left join old using (team, person))"


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _read(spark, sf_dir, "customer")
    current = people.filter("c_custkey % 2 = 0").selectExpr("c_nationkey as team", "c_custkey % 40 as person", "concat('title', c_custkey % 5) as title", "concat('duty', c_custkey % 3) as duty")
    prior = people.filter("c_custkey % 2 = 1 or c_custkey % 6 = 0").selectExpr("c_nationkey as team", "c_custkey % 40 as person", "concat('title', c_custkey % 7) as title", "concat('duty', c_custkey % 4) as duty")
    return joins.staff_changes(prior, current)


@query("j11_staff_changes", STAFF_SQL + " select team::bigint as team, person, title, duty, status from ch")
def j11_staff_changes(spark, sf_dir):
    return staff(spark, sf_dir)


@query(
    "a16_staff_continuity",
    STAFF_SQL + ", c as (select team::bigint as team, count(*) as staff, sum((status <> 'new')::int)::bigint as returning, sum((status in ('same_title', 'same_responsibility'))::int)::bigint as kept from ch group by all) select team, staff, c.returning as \"returning\", kept, round(100 * (0.5 * c.returning + 0.5 * kept) / staff, 6) as index from c",
)
def a16_staff_continuity(spark, sf_dir):
    return agg.staff_continuity(staff(spark, sf_dir))


@query(
    "j14_a17_review_coverage",
    "with q as (select l_linenumber % 4 as metric, l_orderkey as id from lineitem), r as (select o_orderkey as id, o_orderstatus as finding from orders where o_orderkey % 5 = 0), j as (select 'm' || metric as metric, coalesce(finding, 'unreviewed') as finding from q left join r using (id)) select metric, count(*) as queued, sum((finding <> 'unreviewed')::int)::bigint as reviewed from j group by rollup (metric)",
)
def j14_a17_review_coverage(spark, sf_dir):
    queue = _read(spark, sf_dir, "lineitem").selectExpr("concat('m', l_linenumber % 4) as metric", "l_orderkey as id")
    records = _read(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").selectExpr("o_orderkey as id", "o_orderstatus as finding")
    return agg.review_coverage(joins.attach_evidence(queue, records, ["id"]))


@query("a18_pool_by_window", WEEKLY_SQL + " select team, position, w as window_end, round(sum(volume), 6) as volume from weekly, (select unnest([4, 8, 18])::bigint as w) where week <= w group by all")
def a18_pool_by_window(spark, sf_dir):
    return agg.pool_by_window(weekly(spark, sf_dir), ["team", "position"], ["volume"])


#: Samples of every bootstrap.
SAMPLES = 2000
EVAL_SQL = WEEKLY_SQL + ", e as (select position, case when week <= 4 then 4 when week <= 8 then 8 else 18 end as window_end, case player_id % 3 when 0 then 'base' when 1 then 'p12' else 'p24' end as model, volume / 97 as error, team, player_id, week from weekly)"


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).selectExpr("position", "case when week <= 4 then 4 when week <= 8 then 8 else 18 end as window_end", "case player_id % 3 when 0 then 'base' when 1 then 'p12' else 'p24' end as model", "volume / 97 as error", "team", "player_id", "week")


@query(
    "a19_evaluation_summary",
    EVAL_SQL + ", s as (select unnest(['ALL', position]) as scope, window_end, model, error from e), g as (select scope, window_end, model, count(error) as n, avg(error) as m, median(error) as med, quantile_cont(error, 0.75) as p75, sqrt(avg(error * error)) as r from s group by all), b as (select *, max(case when model = 'base' then m end) over (partition by scope, window_end) as base from g) select scope, window_end::bigint as window_end, model, n, round(m, 6) as mean_error, round(med, 6) as median_error, round(p75, 6) as p75_error, round(r, 6) as rmse, round(m - base, 6) + 0.0 as delta, round((base - m) / base, 6) + 0.0 as improvement from b",
)
def a19_evaluation_summary(spark, sf_dir):
    return agg.evaluation_summary(errors(spark, sf_dir), F.array(F.lit("ALL"), F.col("position")), "base")


@query("w1_share_in_group", WEEKLY_SQL + " select player_id, week::bigint as week, round(volume / sum(volume) over (partition by team, week), 6) as share from weekly")
def w1_share_in_group(spark, sf_dir):
    return windows.share_in_group(weekly(spark, sf_dir), ["team", "week"], "volume").select("player_id", "week", "share")


@query(
    "w2_average_rank",
    BOARD_SQL + " select player_id, case when count(*) over (partition by position) = 1 then 0.5 else round((rank() over (partition by position order by size) - 1 + (count(*) over (partition by position, size) - 1) / 2.0) / (count(*) over (partition by position) - 1), 6) end as percentile from board",
)
def w2_average_rank(spark, sf_dir):
    return windows.average_rank_percentile(board(spark, sf_dir), ["position"], "size").select("player_id", "percentile")


@query(
    "w3_midrank",
    BOARD_SQL + ", r as (select position, size from board where player_id % 2 = 0), d as (select distinct position, size from board) select position, size::bigint as size, round((select (count(*) filter (where r.size < d.size) + 0.5 * count(*) filter (where r.size = d.size)) / count(*) from r where r.position = d.position), 6) as percentile from d",
)
def w3_midrank(spark, sf_dir):
    rows = board(spark, sf_dir)
    return windows.midrank_percentile(rows.select("position", "size").distinct(), rows.filter("player_id % 2 = 0"), ["position"], "size")


@query("w4_cume_percentile", BOARD_SQL + " select player_id, round(100 * cume_dist() over (partition by position order by size), 6) as percentile from board")
def w4_cume_percentile(spark, sf_dir):
    return windows.cume_percentile(board(spark, sf_dir), ["position"], "size").select("player_id", "percentile")


@query("w5_ordinal_percentile", BOARD_SQL + " select player_id, round(100.0 * (row_number() over (partition by position order by size, player_id) - 1) / (count(*) over (partition by position) - 1), 1)::double as percentile from board")
def w5_ordinal_percentile(spark, sf_dir):
    return windows.ordinal_percentile(board(spark, sf_dir), ["position"], [F.col("size"), F.col("player_id")]).select("player_id", "percentile")


@query("w6_rank", BOARD_SQL + " select player_id, row_number() over (partition by position order by points desc, player_id) as rank from board")
def w6_rank(spark, sf_dir):
    return windows.rank_in(board(spark, sf_dir), ["position"], [F.desc("points"), F.col("player_id")]).select("player_id", "rank")


@query("w7_keep_best", USAGE_SQL + " select player_id, week::bigint as week, role, round(volume, 6) as volume from usage qualify row_number() over (partition by player_id, week order by volume desc, event_id) = 1")
def w7_keep_best(spark, sf_dir):
    return windows.keep_best(usage(spark, sf_dir), ["player_id", "week"], [-F.col("volume"), F.col("event_id")]).select("player_id", "week", "role", "volume")


@query("w8_top_role", WEEKLY_SQL + " select team, week::bigint as week, player_id as top_player from weekly qualify row_number() over (partition by team, week order by round(volume, 9) desc, player_id) = 1")
def w8_top_role(spark, sf_dir):
    return windows.top_role(weekly(spark, sf_dir), ["team", "week"], "player_id", "volume")


TREND_SQL = WEEKLY_SQL + ", tr as (select player_id, avg(case when week > 6 then volume end) as late, avg(case when week <= 6 then volume end) as early, count(*) as games, arg_max(team, week) as team from weekly where week <= 12 group by player_id)"


@query("w9_half_season_trend", TREND_SQL + " select player_id, round(late, 6) as late, round(early, 6) as early, games, team, round(coalesce(late, 0) - coalesce(early, 0), 6) + 0.0 as trend, late is null as unavailable from tr")
def w9_half_season_trend(spark, sf_dir):
    return windows.half_season_trend(weekly(spark, sf_dir), 12)


@query("w10_rolling_usage", WEEKLY_SQL + " select player_id, round(avg(case when week between 10 and 12 then volume end), 6) as recent, round(avg(case when week between 7 and 9 then volume end), 6) as before from weekly group by player_id")
def w10_rolling_usage(spark, sf_dir):
    return windows.rolling_usage(weekly(spark, sf_dir), 12)


@query(
    "w11_drop_to_kth_next",
    BOARD_SQL + ", r as (select *, row_number() over (partition by position order by points desc, player_id) as p, count(*) over (partition by position) as n from board) select a.player_id, round(greatest(0, a.points - b.points), 6) as drop from r a join r b on a.position = b.position and b.p = least(a.n, a.p + a.size % 7 + 1)",
)
def w11_drop_to_kth_next(spark, sf_dir):
    rows = board(spark, sf_dir).withColumn("k", F.col("size") % 7 + 1)
    return windows.drop_to_kth_next(rows, ["position"], "player_id", "points", "k").select("player_id", "drop")


@query(
    "w12_recent_share",
    "with p as (select o_custkey as draft, o_orderpriority as position, o_orderkey as overall from orders), l as (select * from p qualify row_number() over (partition by draft order by overall desc) <= 6) select draft, position, round(count(*)::double / sum(count(*)) over (partition by draft), 6) as share from l group by draft, position",
)
def w12_recent_share(spark, sf_dir):
    picks = _read(spark, sf_dir, "orders").selectExpr("o_custkey as draft", "o_orderpriority as position", "o_orderkey as overall")
    return windows.recent_share(picks, ["draft"], "overall", 6)


@query("w13_scope_deltas", EVAL_SQL + ", m as (select position, window_end, model, avg(error) as error from e group by all) select m.position, m.window_end::bigint as window_end, m.model, round(m.error, 6) as error, round(m.error - b.error, 6) + 0.0 as delta from m join m b on b.model = 'base' and b.position = m.position and b.window_end = m.window_end where m.model <> 'base'")
def w13_scope_deltas(spark, sf_dir):
    means = errors(spark, sf_dir).groupBy("position", "window_end", "model").agg(F.avg("error").alias("error"))
    return windows.scope_deltas(means, ["position", "window_end"], "model", "error", "base")


@query("t1_top_n", BOARD_SQL + " select position, player_id, points from board qualify row_number() over (partition by position order by points desc, player_id) <= 5")
def t1_top_n(spark, sf_dir):
    return windows.top_n(board(spark, sf_dir), [F.desc("points"), F.col("player_id")], 5, ["position"]).select("position", "player_id", "points")


@query("t2_key_differences", "with a as (select distinct o_custkey as k from orders), b as (select distinct c_custkey as k from customer where c_custkey % 7 <> 0) select k, 'extra' as side from (select k from a except select k from b) union all select k, 'missing' from (select k from b except select k from a)")
def t2_key_differences(spark, sf_dir):
    a = _read(spark, sf_dir, "orders").selectExpr("o_custkey as k")
    return windows.key_differences(a, _read(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").selectExpr("c_custkey as k"), ["k"])


@query("t3_retained", "select 'kept' as side, count(*) as n from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O') union all select 'lost', count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O')")
def t3_retained(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders")
    a, b = rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus = 'O'")
    kept = windows.retained(a, b, ["o_custkey"]).agg(F.lit("kept").alias("side"), F.count("*").alias("n"))
    return kept.unionByName(windows.unresolved_keys(a, b, ["o_custkey"]).agg(F.lit("lost").alias("side"), F.count("*").alias("n")))


@query("t4_observed_universe", "with s as (select p_partkey as id, p_name as name, 0 as s from part union all select s_suppkey, s_name, 1 from supplier union all select c_custkey, c_name, 2 from customer) select id, name from s qualify row_number() over (partition by id order by s, name) = 1")
def t4_observed_universe(spark, sf_dir):
    catalog = _read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name")
    saved = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name")
    return windows.observed_universe([catalog, saved, _read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name")], "id")


@query("t4_observed_universe_all", "with s as (select p_partkey as id, p_name as name, 0 as s from part union all select s_suppkey, s_name, 1 from supplier union all select c_custkey, c_name, 2 from customer) select id, name from s qualify row_number() over (partition by id order by s, name) = 1")
def t4_observed_universe_all(spark, sf_dir):
    catalog = _read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name")
    saved = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name")
    return windows.observed_universe([catalog, saved, _read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name")], "id")


@query("j8_asof_latest", USAGE_SQL.replace("value as volume", "value as volume, ts") + ", f as (select * from usage where ts < timestamp '2024-01-20 00:00:00') select player_id, event_id, role from f where ts = (select max(g.ts) from f g where g.player_id = f.player_id)")
def j8_asof_latest(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").selectExpr("user_id as player_id", "event_id", "event_type as role", "ts")
    return joins.asof_latest(rows, "player_id", "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("player_id", "event_id", "role")


@query("j10_byes", WEEKLY_SQL + ", g as (select distinct team, week from weekly where (team + week) % 3 <> 0), c as (select distinct team, week from weekly) select 'bye' as kind, team, week::bigint as week from c anti join g using (team, week) union all select 'game', team, week from c semi join g using (team, week)")
def j10_byes(spark, sf_dir):
    rows = weekly(spark, sf_dir).select("team", "week").distinct()
    schedule = rows.filter("(team + week) % 3 <> 0")
    bye = joins.bye_weeks(rows, schedule, ["team", "week"]).select(F.lit("bye").alias("kind"), "team", "week")
    return bye.unionByName(joins.scheduled_only(rows, schedule, ["team", "week"]).select(F.lit("game").alias("kind"), "team", "week"))


@query(
    "j12_caller_cohort",
    "with old as (select n_nationkey as team, n_nationkey % 9 as caller from nation), tgt as (select n_nationkey as team, case when n_nationkey % 5 = 0 then null when n_nationkey % 2 = 0 then n_nationkey % 9 else n_nationkey % 13 end as caller from nation), el as (select caller, count(distinct team) as teams, min(team) as anchor from old group by caller), j as (select t.team, t.caller, case when t.caller is null then 'ambiguous' when t.caller = o.caller then 'returning' when teams = 1 then 'changed_with_anchor' when teams > 1 then 'ambiguous' else 'changed_without_anchor' end as cohort, anchor from tgt t left join old o on o.team = t.team left join el on el.caller = t.caller) select team::bigint as team, caller::double as caller, cohort, case when cohort = 'changed_with_anchor' then anchor end::double as anchor_team from j",
)
def j12_caller_cohort(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation")
    prior = nations.selectExpr("n_nationkey as team", "n_nationkey % 9 as caller")
    target = nations.selectExpr("n_nationkey as team", "case when n_nationkey % 5 = 0 then null when n_nationkey % 2 = 0 then n_nationkey % 9 else n_nationkey % 13 end as caller")
    return as_double(joins.caller_cohort(prior, target), "caller", "anchor_team")


@query("j13_exclude_changes", "with c as (select s_nationkey as team, min(s_suppkey % 17 + 1) as first_week from supplier where s_suppkey % 11 = 0 group by all) select n_nationkey::bigint as team, first_week::double as first_week, w as window_end, coalesce(first_week <= w, false) as excluded from nation left join c on c.team = n_nationkey, (select unnest([6, 8])::bigint as w)")
def j13_exclude_changes(spark, sf_dir):
    changes = _read(spark, sf_dir, "supplier").filter("s_suppkey % 11 = 0").selectExpr("s_nationkey as team", "s_suppkey % 17 + 1 as first_week")
    found = joins.exclude_changes(_read(spark, sf_dir, "nation").selectExpr("n_nationkey as team"), changes, spark.createDataFrame([(6,), (8,)], "window_end int"))
    return as_double(found, "first_week")


FVA_SQL = WEEKLY_SQL + ", f as (select team, player_id, sum(volume) as v from weekly where week <= 6 and player_id % 5 <> 0 group by all), a as (select team, player_id, sum(volume) as v from weekly where week > 6 and player_id % 7 <> 0 group by all), fs as (select team, player_id, v / sum(v) over (partition by team) as forecast from f), ac as (select team, player_id, v / sum(v) over (partition by team) as actual from a), fa as (select coalesce(fs.team, ac.team) as team, coalesce(fs.player_id, ac.player_id) as player_id, coalesce(forecast, 0) as forecast, coalesce(actual, 0) as actual, case when fs.team is null then 'later_entrant' else 'opening' end as row_type from fs full join ac on fs.team = ac.team and fs.player_id = ac.player_id)"


def forecast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly(spark, sf_dir)
    shares = lambda condition: windows.share_in_group(rows.filter(condition).groupBy("team", "player_id").agg(F.sum("volume").alias("v")), ["team"], "v")
    early = shares("week <= 6 and player_id % 5 <> 0").select("team", "player_id", F.col("share").alias("forecast"))
    return joins.forecast_vs_actual(early, shares("week > 6 and player_id % 7 <> 0").select("team", "player_id", F.col("share").alias("actual")), ["team", "player_id"])


@query("j16_forecast_vs_actual", FVA_SQL + " select team, player_id, round(forecast, 6) as forecast, round(actual, 6) as actual, row_type from fa")
def j16_forecast_vs_actual(spark, sf_dir):
    return forecast_rows(spark, sf_dir)


@query(
    "e1_room_errors",
    FVA_SQL + " select team, round(sum(abs(forecast - actual)) / 2, 6) as total_variation, round(avg(abs(forecast - actual)), 6) as mean_error, round(sum(case when row_type = 'opening' then actual else 0 end), 6) as coverage, (first(player_id order by round(forecast, 9) desc, player_id) = first(player_id order by round(actual, 9) desc, player_id)) as top_hit from fa group by team",
)
def e1_room_errors(spark, sf_dir):
    return stats.room_errors(forecast_rows(spark, sf_dir), ["team"])


@query(
    "e2_oracle_allocation",
    FVA_SQL + ", act as (select distinct team, week, player_id from weekly where player_id % 3 <> 0 and week % 4 <> 1), pool as (select team, week, sum(volume) as pool from weekly group by all), live as (select a.team, a.week, a.player_id, forecast from act a join fs using (team, player_id)), tot as (select team, week, sum(forecast) as t from live group by all) select team, week::bigint as week, player_id::varchar as player_id, round(pool * forecast / t, 6) as allocated from live join tot using (team, week) join pool using (team, week) union all select team, week, '__UNALLOCATED__', round(pool, 6) from pool anti join tot using (team, week)",
)
def e2_oracle_allocation(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    weights = forecast_rows(spark, sf_dir).filter("row_type = 'opening'").select("team", "player_id", F.col("forecast").alias("weight"))
    active = rows.filter("player_id % 3 <> 0 and week % 4 <> 1").select("team", "week", "player_id").distinct()
    return stats.oracle_allocation(weights, active, rows.groupBy("team", "week").agg(F.sum("volume").alias("pool")), ["team"])


@query("e3_cluster_bootstrap", EVAL_SQL + ", xd as (select position as scope, team as cluster, error - 0.5 as delta from e), " + driver_sql.cluster_bootstrap("xd", SAMPLES, 0.90) + f" select scope, {driver_sql.BOOTSTRAP_COLUMNS} from br")
def e3_cluster_bootstrap(spark, sf_dir):
    rows = errors(spark, sf_dir).withColumn("delta", F.col("error") - F.lit(0.5))
    return stats.paired_cluster_bootstrap(rows, "position", "team", "delta", samples=SAMPLES)


@query("e6_conformal_radius", EVAL_SQL + ", o as (select position, error, row_number() over (partition by position order by error) as i, count(*) over (partition by position) as n from e) select position, round(error, 6) as radius, n from o where i = least(n, ceil((n + 1) * 0.9))")
def e6_conformal_radius(spark, sf_dir):
    return stats.conformal_radius(errors(spark, sf_dir), ["position"], "error")


@query(
    "e7_holdout_coverage",
    EVAL_SQL + ", o as (select position, error, row_number() over (partition by position order by error) as i, count(*) over (partition by position) as n from e where week <= 8), r as (select position, error as radius from o where i = least(n, ceil((n + 1) * 0.9))), h as (select e.position, error - 1.0 as d, radius from e join r using (position) where week > 8) select position, count(*) as rows, sum((abs(d) <= radius)::int)::bigint as covered, sum((d < -radius)::int)::bigint as below, sum((d > radius)::int)::bigint as above, round(avg(2 * radius), 6) as mean_width, round(avg((abs(d) <= radius)::int), 6) as rate from h group by position",
)
def e7_holdout_coverage(spark, sf_dir):
    rows = errors(spark, sf_dir)
    radius = stats.conformal_radius(rows.filter("week <= 8"), ["position"], "error")
    return stats.holdout_coverage(rows.filter("week > 8").select("position", F.lit(1.0).alias("forecast"), F.col("error").alias("actual")), radius, ["position"])


@query(
    "e9_shrunk_team_rate",
    SEASON_SQL + ", v as (select season, team, sum(carries) as amount, sum(games) as games from player group by all), p as (select *, power(0.65, 1999 - season) as w from v where season between 1997 and 1999), t as (select team, sum(w * amount) as x, sum(w * games) as n from p group by team), l as (select sum(w * amount) / sum(w * games) as league from p) select team, round(league, 6) as league, round(x / n, 6) as raw, round((x + 4 * league) / (n + 4), 6) as p4, round((x + 17 * league) / (n + 17), 6) as p17 from t, l",
)
def e9_shrunk_team_rate(spark, sf_dir):
    used = agg.season_usage(season_rows(spark, sf_dir)).groupBy("season", "team").agg(F.sum("carries").alias("amount"), F.sum("games").alias("games"))
    return stats.shrunk_team_rate(used, 2000, 3, [4, 17], 0.65)


@query(
    "e10_brier",
    "with r as (select lang, 0.85 as a, case when n_chars > 1000 then 0.9 else 0.7 end as b, quality as y from documents join labels using (doc_id)) select lang, count(*) as n, round(avg(power(a - y, 2)), 6) as a_brier, round(avg(power(b - y, 2)), 6) as b_brier, round(avg(power(a - y, 2) - power(b - y, 2)), 6) + 0.0 as delta, round(stddev_samp(power(a - y, 2) - power(b - y, 2)) / sqrt(count(*)), 6) as delta_se from r group by lang",
)
def e10_brier(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.selectExpr("lang", "cast(0.85 as double) as a", "cast(case when n_chars > 1000 then 0.9 else 0.7 end as double) as b", "cast(quality as double) as y")
    return stats.brier_scores(rows, ["lang"], ["a", "b"], "y")


@query(
    "e11_spearman",
    BOARD_SQL + ", r as (select position, rank() over (partition by position order by points) + (count(*) over (partition by position, points) - 1) / 2.0 as x, rank() over (partition by position order by size) + (count(*) over (partition by position, size) - 1) / 2.0 as y from board) select position, round(corr(x, y), 6) + 0.0 as spearman, count(*) as n from r group by position",
)
def e11_spearman(spark, sf_dir):
    return stats.spearman(board(spark, sf_dir), ["position"], "points", "size")


@query(
    "e12_tertiles",
    BOARD_SQL + ", c as (select quantile_cont(points, 1 / 3.0::double) as a, quantile_cont(points, 2 / 3.0::double) as b from board where player_id % 2 = 0) select case when points <= a then 'low' when points <= b then 'middle' else 'high' end as tier, count(*) as n from board, c group by tier",
)
def e12_tertiles(spark, sf_dir):
    return stats.tertiles(board(spark, sf_dir), F.col("player_id") % 2 == 0, "points").groupBy("tier").agg(F.count("*").alias("n"))


@query("e14_joint_coverage", WEEKLY_SQL + ", u as (select player_id, bool_and(volume < 300) as ok from weekly group by player_id) select count(*) as units, round(avg(ok::int), 6) as joint_rate from u")
def e14_joint_coverage(spark, sf_dir):
    return stats.joint_coverage(weekly(spark, sf_dir).withColumn("ok", F.col("volume") < 300), "player_id", "ok")


@query(
    "f4_resource_forecasts",
    "with s as (select s_suppkey as team, 60 + s_suppkey % 10 as plays_per_game, 0.5 + (s_suppkey % 20) / 100.0 as pass_rate, 0.05 as qb_scramble_rate, 0.1 as designed_qb_run_share, 0.25 as rb, 0.5 as wr, 0.2 + (s_suppkey % 10) / 100.0 as te from supplier), t as (select *, case when rb + wr + te > 1.05 then null when rb + wr + te > 1 then rb + wr + te else 1 end::double as k from s) "
    "select team, resource, round(pool, 6) as pool from (select team, unnest(['QB_DROPBACKS', 'QB_RUSH_OPPORTUNITIES', 'RB_CARRIES', 'RB_TARGETS', 'WR_TARGETS', 'TE_TARGETS']) as resource, unnest([plays_per_game * pass_rate * 0.9, plays_per_game * pass_rate * qb_scramble_rate + plays_per_game * (1 - pass_rate) * designed_qb_run_share, plays_per_game * (1 - pass_rate) * (1 - designed_qb_run_share) * 0.95, plays_per_game * pass_rate * 0.8 * rb / k, plays_per_game * pass_rate * 0.8 * wr / k, plays_per_game * pass_rate * 0.8 * te / k]::double[]) as pool from t)",
)
def f4_resource_forecasts(spark, sf_dir):
    style = _read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as team", "cast(60 + s_suppkey % 10 as double) as plays_per_game", "0.5D + (s_suppkey % 20) / 100.0D as pass_rate", "0.05D as qb_scramble_rate", "0.1D as designed_qb_run_share", "0.25D as rb_target_share", "0.5D as wr_target_share", "0.2D + (s_suppkey % 10) / 100.0D as te_target_share"
    )
    factors = spark.createDataFrame([(0.9, 0.8, 0.95)], "qb_dropbacks_per_pass_play double, target_per_pass_play double, rb_carries_per_non_qb_rush_play double")
    return forecast.resource_forecasts(style, factors)


@query(
    "f9_role_scenarios",
    WEEKLY_SQL + ", ro as (select team, player_id, 'R' || (player_id % 2) as resource, sum(volume) as weight from weekly group by all), av as (select distinct team, week, player_id, 0.3 + (player_id % 5) / 10.0 as p from weekly), dr as (select *, unnest(range(5000)) as draw from av), live as (select * from dr where ('0x' || substr(md5('7|' || player_id || '|' || week || '|' || draw), 1, 8))::bigint / 4294967296.0 < p), wt as (select l.team, l.week, resource, draw, l.player_id, weight from live l join ro using (team, player_id)), sh as (select *, weight / sum(weight) over (partition by team, week, resource, draw) as share from wt), ag as (select team, week, resource, player_id::varchar as player_id, sum(share) / 5000 as mean_share, count(*) as active_draws from sh group by all), "
    "rm as (select distinct av.team, week, resource from av join ro on av.team = ro.team), fl as (select team, week, resource, count(distinct draw) as f from wt group by all), em as (select team, week, resource, '__UNALLOCATED__', (5000 - coalesce(f, 0)) / 5000.0, 5000 - coalesce(f, 0) from rm left join fl using (team, week, resource) where coalesce(f, 0) < 5000) select team, week::bigint as week, resource, player_id, round(mean_share, 6) as mean_share, active_draws from ag union all select team, week, resource, '__UNALLOCATED__', round((5000 - coalesce(f, 0)) / 5000.0, 6)::double, 5000 - coalesce(f, 0) from rm left join fl using (team, week, resource) where coalesce(f, 0) < 5000",
)
def f9_role_scenarios(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    roles = rows.groupBy("team", "player_id").agg(F.sum("volume").alias("weight")).withColumn("resource", F.concat(F.lit("R"), F.col("player_id") % 2))
    availability = rows.select("team", "week", "player_id").distinct().withColumn("p", 0.3 + (F.col("player_id") % 5) / 10)
    return forecast.role_scenarios(roles, availability, draws=5000, seed=7)


@query(
    "f14_season_watchlist",
    TREND_SQL + ", pl as (select tr.*, case player_id % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position, round(coalesce(late, 0) - coalesce(early, 0), 6) as slope, round(late, 6) as lvl from tr), pc as (select player_id, 100 * cume_dist() over (partition by position order by lvl) as a, 100 * cume_dist() over (partition by position order by slope) as b from pl where late is not null), sc as (select pl.player_id, position, coalesce(0.7 * a + 0.3 * b, 0) as score, late is null as un from pl left join pc using (player_id)), "
    "ow as (select player_id % 3 as league_id, player_id, player_id % 2 = 0 as mine from sc where player_id % 5 < 3), bs as (select league_id, position, arg_min(score, un::int * 1000 + score) as base from ow join sc using (player_id) where mine group by all), lg as (select distinct league_id from ow) "
    "select lg.league_id, sc.player_id, sc.position, round(score, 6) as score, round(score - coalesce(base, 0), 6) + 0.0 as delta, case when ow.mine is null then 'waiver' else 'trade' end as list from lg cross join sc left join ow on ow.league_id = lg.league_id and ow.player_id = sc.player_id left join bs on bs.league_id = lg.league_id and bs.position = sc.position where ow.mine is null or not ow.mine",
)
def f14_season_watchlist(spark, sf_dir):
    trends = windows.half_season_trend(weekly(spark, sf_dir), 12).withColumn("position", F.expr(USAGE["position"].replace("user_id", "player_id")))
    trends = trends.withColumn("late", F.round("late", 6)).withColumn("trend", F.round("trend", 6))
    owners = trends.filter("player_id % 5 < 3").select((F.col("player_id") % 3).alias("league_id"), "player_id", (F.col("player_id") % 2 == 0).alias("mine"))
    return forecast.season_watchlist(trends, owners)


@query(
    "f15_market_board",
    BOARD_SQL + ", p as (select *, 100.0 * (row_number() over (partition by position order by points, player_id) - 1) / (count(*) over (partition by position) - 1) as pc from board), s as (select player_id, position, size, points, round(pc, 1)::double as percentile from p), t as (select *, 100 - 0.35 * (size - 1) + least(6, greatest(-6, (percentile - 50) / 50 * 6)) as score from s) select player_id, position, size::bigint as adp, points as opportunity, percentile, round(score, 6) as score, row_number() over (partition by position order by score desc, player_id) as position_rank from t",
)
def f15_market_board(spark, sf_dir):
    return forecast.market_board(board(spark, sf_dir).select("player_id", "position", F.col("size").alias("adp"), F.col("points").alias("opportunity")))


STARTERS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "K": 1}
REPLACEMENT_SQL = (
    BOARD_SQL
    + ", r as (select *, row_number() over (partition by position order by points desc, player_id) as p from board), fx as (select *, p <= 12 * case position when 'RB' then 2 when 'WR' then 2 else 1 end as used from r), "
    + "fl as (select player_id from fx where not used and position in ('RB', 'WR', 'TE') order by points desc, position desc, p limit 12), u as (select * from fx where used or player_id in (select player_id from fl)), lv as (select position, count(*) as demand, min(points) as replacement from u group by position)"
)


@query("f16_replacement_levels", REPLACEMENT_SQL + " select position, demand, replacement from lv")
def f16_replacement_levels(spark, sf_dir):
    return forecast.replacement_levels(board(spark, sf_dir), 12, STARTERS, [(("RB", "WR", "TE"), 1)])


@query(
    "f17_draft_recommendations",
    REPLACEMENT_SQL + ", k as (select position, replacement, greatest(1, ceil(10 * demand / (select sum(demand) from lv))) as k from lv), o as (select r.*, k.replacement, k.k, count(*) over (partition by r.position) as n from r join k on k.position = r.position) select a.player_id, a.position, round(a.points - a.replacement, 6) + 0.0 as vorp, round(greatest(0, a.points - b.points), 6) as scarcity, round(a.points - a.replacement + 0.5 * greatest(0, a.points - b.points), 6) + 0.0 as score from o a join o b on a.position = b.position and b.p = least(a.n, a.p + a.k)",
)
def f17_draft_recommendations(spark, sf_dir):
    rows = board(spark, sf_dir)
    return forecast.draft_recommendations(rows, forecast.replacement_levels(rows, 12, STARTERS, [(("RB", "WR", "TE"), 1)]), 10)




@query(
    "f18_survival",
    BOARD_SQL + ", b as (select player_id, size * 3.0::double as adp, 2.0 + size % 5 as sd, size * 3.0 - 12 as hi, size * 3.0 + 15 as lo, player_id % 400 as drafts from board), z as (select *, greatest(1.0, hi) as top, (40 - 0.5 - adp) / sd as z0, (greatest(1.0, hi) - 0.5 - adp) / sd as z1, (greatest(greatest(1.0, hi), lo) + 0.5 - adp) / sd as z2 from b), "
    + "u as (select *, "
    + ", ".join(f"0.5 * (1 + sign({z}) * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2.0))) * exp(-{z} * {z} / 2))) as c{i}" for i, z in enumerate(("z0", "z1", "z2")))
    + " from z) select player_id, round(least(0.995, greatest(0.005, drafts / (drafts + 50.0) * least(1, greatest(0, (c2 - c0) / greatest(0.000001, c2 - c1))) + (1 - drafts / (drafts + 50.0)) * (1 - c0))), 6) as survival from u",
)
def f18_survival(spark, sf_dir):
    rows = board(spark, sf_dir).selectExpr("player_id", "size * 3.0D as adp", "2.0D + size % 5 as stdev", "size * 3.0D - 12 as high", "size * 3.0D + 15 as low", "player_id % 400 as drafts")
    return forecast.survival_estimates(rows, F.lit(40.0)).select("player_id", "survival")


@query(
    "c17_f19_opponent_demand",
    "with d as (select c_custkey as draft_id, c_custkey % 50 + 1 as cur, c_custkey % 50 + 1 + c_custkey % 9 as nxt from customer), w as (select c_custkey as draft_id, unnest(range(10)) as owner, 0.5 + (c_custkey * 7 + unnest(range(10)) * 3) % 11 / 10.0 as demand from customer), b as (select draft_id, unnest(range(cur + 1, nxt)) as pick from d where nxt > cur + 1), o as (select draft_id, case when ((pick - 1) // 10) % 2 = 0 then (pick - 1) % 10 else 9 - (pick - 1) % 10 end as owner from b), m as (select draft_id, avg(demand) as mean from w group by all) select o.draft_id, count(*) as picks, round(least(1.9, greatest(0.45, avg(demand) / any_value(mean))), 6) as pressure from o join w on w.draft_id = o.draft_id and w.owner = o.owner join m on m.draft_id = o.draft_id group by o.draft_id",
)
def c17_f19_opponent_demand(spark, sf_dir):
    people = _read(spark, sf_dir, "customer")
    drafts = people.selectExpr("c_custkey as draft_id", "c_custkey % 50 + 1 as current", "c_custkey % 50 + 1 + c_custkey % 9 as next")
    weights = people.selectExpr("c_custkey as draft_id", "explode(sequence(0, 9)) as owner").withColumn("demand", 0.5 + (F.col("draft_id") * 7 + F.col("owner") * 3) % 11 / 10)
    return forecast.opponent_demand(drafts, weights, 10)


@query("f20_tier_cliffs", BOARD_SQL + ", t as (select position, size // 10 as tier, count(*) as remaining, max(points) as best, min(points) as last from board group by all) select position, tier::bigint as tier, remaining, round(best, 6) as best, round(last, 6) as last, round(last - lead(best) over (partition by position order by tier), 6) as drop from t")
def f20_tier_cliffs(spark, sf_dir):
    return forecast.tier_cliffs(board(spark, sf_dir).withColumn("tier", F.floor(F.col("size") / 10)))


@query(
    "f22_coaching_census",
    "with st as (select s_nationkey as team, s_suppkey as person, case s_suppkey % 4 when 0 then 'head_coach' when 1 then 'coordinator' else 'assistant' end as title from supplier), rg as (select n_nationkey as team, n_nationkey % 50 as caller from nation), c as (select team, sum((title = 'head_coach')::int)::bigint as heads, sum((title = 'coordinator')::int)::bigint as coordinators from st group by team) select rg.team::bigint as team, caller::bigint as caller, heads::double as heads, coordinators::double as coordinators, exists (select 1 from st where st.team = rg.team and st.person = rg.caller) as on_staff, coalesce(heads = 1 and coordinators = 1 and exists (select 1 from st where st.team = rg.team and st.person = rg.caller), false) as valid from rg left join c using (team)",
)
def f22_coaching_census(spark, sf_dir):
    staff_rows = _read(spark, sf_dir, "supplier").selectExpr("s_nationkey as team", "s_suppkey as person", "case s_suppkey % 4 when 0 then 'head_coach' when 1 then 'coordinator' else 'assistant' end as title")
    found = forecast.coaching_census(_read(spark, sf_dir, "nation").selectExpr("n_nationkey as team", "n_nationkey % 50 as caller"), staff_rows)
    return as_double(found, "heads", "coordinators")


@query(
    "f23_ownership_replay",
    "with t as (select o_custkey as league_id, o_orderkey as seq, case when o_orderkey % 5 = 0 then 'undo' when o_orderkey % 7 = 0 then 'drop' else 'add' end as kind, o_orderkey % 6 as player_id, o_orderkey % 4 as owner from orders), s as (select *, sum(case when kind = 'undo' then -1 else 1 end) over (partition by league_id order by seq) as lv from t), k as (select *, min(lv) over (partition by league_id order by seq rows between 1 following and unbounded following) as lo from s), f as (select * from k where kind <> 'undo' and (lo is null or lo >= lv) qualify row_number() over (partition by league_id, player_id order by seq desc) = 1) select league_id, player_id, owner from f where kind = 'add'",
)
def f23_ownership_replay(spark, sf_dir):
    log = _read(spark, sf_dir, "orders").selectExpr("o_custkey as league_id", "o_orderkey as seq", "case when o_orderkey % 5 = 0 then 'undo' when o_orderkey % 7 = 0 then 'drop' else 'add' end as kind", "o_orderkey % 6 as player_id", "o_orderkey % 4 as owner")
    return forecast.ownership_replay(log)


@query(
    "c13_depth_weights",
    "with d as (select p_partkey as player_id, case p_type when 'ECONOMY' then 'QB' when 'STANDARD' then 'RB' when 'PROMO' then 'WR' else 'TE' end as position, case when p_size % 11 > 0 then p_size % 11 end as rank from part) select player_id, round(case when rank is null then 0.02 when position = 'QB' then case when rank <= 4 then [1.0, 0.07, 0.015, 0.005][rank] else 0.005 * power(0.55, rank - 4) end when position = 'RB' then case when rank <= 6 then [1.0, 0.55, 0.28, 0.14, 0.07, 0.035][rank] else 0.035 * power(0.55, rank - 6) end when position = 'WR' then case when rank <= 8 then [1.0, 0.90, 0.80, 0.35, 0.22, 0.13, 0.08, 0.05][rank] else 0.05 * power(0.55, rank - 8) end else case when rank <= 6 then [1.0, 0.45, 0.18, 0.08, 0.04, 0.02][rank] else 0.02 * power(0.55, rank - 6) end end::double, 6) as weight from d",
)
def c13_depth_weights(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").selectExpr("p_partkey as player_id", "case p_type when 'ECONOMY' then 'QB' when 'STANDARD' then 'RB' when 'PROMO' then 'WR' else 'TE' end as position", "case when p_size % 11 > 0 then p_size % 11 end as rank")
    return rows.select("player_id", F.round(clean.depth_weight(F.col("position"), F.col("rank")), 6).alias("weight"))


QUERIES["c13_depth_weights"] = c13_depth_weights  # six digits


@query("c6_identity_keys", "select c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) as key from customer")
def c6_identity_keys(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", clean.identity_key(F.col("c_name")).alias("key"))


@query("c9_topic_tags", "select lang, sum(regexp_matches(text, '(?i)stupid|idiot')::int)::bigint as insults, sum(regexp_matches(text, '(?i)licen[cs]e')::int)::bigint as licences from documents group by lang")
def c9_topic_tags(spark, sf_dir):
    tags = clean.topic_tags(F.col("text"), {"insults": "stupid|idiot", "licences": "licen[cs]e"})
    rows = _read(spark, sf_dir, "documents").select("lang", tags.alias("tags"))
    return rows.groupBy("lang").agg(*[F.sum(F.array_contains("tags", t).cast("long")).alias(t) for t in ("insults", "licences")])


@query("q1_duplicate_keys", "select l_orderkey, l_linenumber::bigint as l_linenumber, count(*) as rows from lineitem group by all having count(*) > 1")
def q1_duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q2_range_violations", "select sum((not l_quantity <= 49)::int)::bigint as quantity, sum((not (l_discount between 0 and 0.05))::int)::bigint as discount from lineitem")
def q2_range_violations(spark, sf_dir):
    return quality.range_violations(_read(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") <= 49, "discount": F.col("l_discount").between(0, 0.05)})


@query("q4_reconcile", "select o_orderkey, round(o_totalprice, 6) as total, round(coalesce(p, 0), 6) as parts, round(abs(coalesce(p, 0) - o_totalprice), 6) as error from orders left join (select l_orderkey, sum(l_extendedprice) as p from lineitem group by all) on l_orderkey = o_orderkey")
def q4_reconcile(spark, sf_dir):
    parts = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_extendedprice as part")
    return quality.reconcile(parts, _read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice as total"), ["o_orderkey"], "part", "total")


@query("q5_not_after", "select max(o_orderdate::date)::varchar as latest, datediff('day', max(o_orderdate::date), date '2000-01-01') as age_days, sum((o_orderdate::date > date '2000-01-01')::int)::bigint as late_rows from orders")
def q5_not_after(spark, sf_dir):
    return quality.not_after(_read(spark, sf_dir, "orders"), "o_orderdate", "2000-01-01")


@query("q7_source_inventory", "select 'orders' as component, count(*) as rows, max(o_orderdate::date)::varchar as latest from orders union all select 'events', count(*), max(ts::date)::varchar from events")
def q7_source_inventory(spark, sf_dir):
    return quality.source_inventory({"orders": (_read(spark, sf_dir, "orders"), "o_orderdate"), "events": (_read(spark, sf_dir, "events"), "ts")})


@query("q8_missing_references", "select distinct l_orderkey as key from lineitem anti join (select o_orderkey from orders where o_orderkey % 4 <> 0) on o_orderkey = l_orderkey")
def q8_missing_references(spark, sf_dir):
    return quality.missing_references(_read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as key"), _read(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").selectExpr("o_orderkey as key"), "key")


@query("q9_profile", PLAYS_SQL + " select season::bigint as season, count(*) as rows, round(avg((air_yards is null)::int), 6) as air_yards_null_share, round(avg((shotgun is null)::int), 6) as shotgun_null_share from plays group by season")
def q9_profile(spark, sf_dir):
    return quality.profile(plays(spark, sf_dir), ["season"], ["air_yards", "shotgun"])


RECONCILE_SQL = "with r as (select c_custkey as player_id, c_nationkey as team, case c_custkey % 3 when 0 then 'ACT' when 1 then 'RES' else 'CUT' end as status from customer), c as (select s_suppkey as player_id, s_nationkey as team, case s_suppkey % 4 when 0 then 'ACT' when 1 then 'RES' when 2 then 'CUT' else 'DEV' end as status from supplier)"


@query(
    "j3_reconcile_roster",
    RECONCILE_SQL + " select r.player_id, case when c.status in ('ACT', 'RES', 'DEV') then c.team else r.team end::bigint as team, coalesce(c.status, r.status) as status, case when c.status is null then 'no_catalog' when c.status in ('ACT', 'RES', 'DEV') and c.team <> r.team then 'affiliation' when c.status <> r.status then 'status' end as review from r left join c using (player_id)",
)
def j3_reconcile_roster(spark, sf_dir):
    roster_rows = _read(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "c_nationkey as team", "case c_custkey % 3 when 0 then 'ACT' when 1 then 'RES' else 'CUT' end as status")
    catalog = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as player_id", "s_nationkey as team", "case s_suppkey % 4 when 0 then 'ACT' when 1 then 'RES' when 2 then 'CUT' else 'DEV' end as status")
    return joins.reconcile_roster(roster_rows, catalog, ["ACT", "RES", "DEV"])


@query(
    "j5_snaps_to_players",
    "with c as (select s_suppkey % 60 as other_id, min(s_suppkey) as player_id from supplier where s_suppkey % 60 <> 7 group by 1 having count(distinct s_suppkey) = 1), s as (select o_custkey % 80 as other_id, count(*) as games from orders group by 1) select s.other_id, games, player_id::double as player_id from s left join c using (other_id)",
)
def j5_snaps_to_players(spark, sf_dir):
    catalog = _read(spark, sf_dir, "supplier").filter("s_suppkey % 60 <> 7").selectExpr("s_suppkey % 60 as other_id", "s_suppkey as player_id")
    snaps = _read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 80).alias("other_id")).agg(F.count("*").alias("games"))
    return as_double(joins.snaps_to_players(snaps, catalog), "player_id")


CROSSWALK_SQL = (
    "with ro as (select c_custkey as player_id, c_custkey % 97 as name_key, c_nationkey % 5 as team, c_custkey % 3 as position from customer where c_custkey % 4 <> 1), "
    "mk as (select s_suppkey as source_id, s_suppkey % 120 as name_key, s_nationkey % 5 as team, s_suppkey % 3 as position from supplier), "
    "ex as (select name_key, team, position, min(player_id) as id, count(distinct player_id) as n from ro group by all), lo as (select name_key, position, count(*) as n from ro group by all), "
    "j as (select mk.*, case when ex.n = 1 then ex.id end as pid, ex.n as en, lo.n as ln from mk left join ex using (name_key, team, position) left join lo on lo.name_key = mk.name_key and lo.position = mk.position), "
    "k as (select *, case when pid is not null then count(*) over (partition by pid) end as claims from j), s as (select *, case when claims > 1 then 'review' when claims = 1 then 'resolved' when ln is not null then 'review' else 'unmatched' end as status from k)"
)


@query("j6_market_crosswalk", CROSSWALK_SQL + " select source_id, case when status = 'resolved' then pid end::double as player_id, status from s")
def j6_market_crosswalk(spark, sf_dir):
    roster_rows = _read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 1").selectExpr("c_custkey as player_id", "c_custkey % 97 as name_key", "c_nationkey % 5 as team", "c_custkey % 3 as position")
    market = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as source_id", "s_suppkey % 120 as name_key", "s_nationkey % 5 as team", "s_suppkey % 3 as position")
    return as_double(joins.market_crosswalk(market, roster_rows), "player_id")


@query(
    "j17_caller_episodes",
    "with ce as (select distinct o_custkey % 50 as caller_key, o_orderkey % 8 as team, year(o_orderdate) as season from orders), f as (select * from ce where caller_key in (select c_custkey % 60 from customer where c_custkey % 3 = 0)) select caller_key, team, season::bigint as season, case when season % 4 = 1 and team = 2 then 0.0 else 1.0 end as weight from f union all select n_nationkey::bigint, 99, 2005, 1.0 from nation",
)
def j17_caller_episodes(spark, sf_dir):
    census = _read(spark, sf_dir, "orders").selectExpr("o_custkey % 50 as caller_key", "o_orderkey % 8 as team", "year(o_orderdate) as season").distinct()
    current = _read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey % 60 as caller_key")
    additions = _read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as caller_key", "99L as team", "2005 as season")
    return joins.caller_episodes(census, current, census.filter("season % 4 = 1 and team = 2"), additions)


@query(
    "j18_evidence_dates",
    "with t as (select c_custkey as team, unnest([c_custkey % 40, c_custkey % 23, c_custkey % 90]) as source_id, unnest([0, 1, 2]) as place from customer), s as (select o_orderkey as source_id, o_orderdate::date as published from orders) select team, arg_min(source_id, place) as primary_source, max(published)::varchar as latest from t join s using (source_id) group by team",
)
def j18_evidence_dates(spark, sf_dir):
    teams = _read(spark, sf_dir, "customer").selectExpr("c_custkey as team", "array(c_custkey % 40, c_custkey % 23, c_custkey % 90) as source_ids")
    sources = _read(spark, sf_dir, "orders").selectExpr("o_orderkey as source_id", "to_date(o_orderdate) as published")
    return joins.evidence_dates(teams, sources)


# Ten orders a customer, so that the ids range over all orders; the first id of each is no order's.
CITED = ["-1 - c_custkey", *[f"c_custkey * 10 + {k}" for k in range(10)]]


@query(
    "j18_evidence_dates_all",
    f"with t as (select c_custkey as team, unnest([{', '.join(CITED)}]) as source_id, unnest(range(11)) as place from customer), s as (select o_orderkey as source_id, o_orderdate::date as published from orders) select team, arg_min(source_id, place) as primary_source, max(published)::varchar as latest from t join s using (source_id) group by team",
)
def j18_evidence_dates_all(spark, sf_dir):
    teams = _read(spark, sf_dir, "customer").selectExpr("c_custkey as team", f"array({', '.join(CITED)}) as source_ids")
    return joins.evidence_dates(teams, _read(spark, sf_dir, "orders").selectExpr("o_orderkey as source_id", "to_date(o_orderdate) as published"))


@query(
    "f1_caller_fingerprints",
    SEASON_SQL + ", v as (select season, team, sum(carries) / count(*) as value from player group by all), ow as (select team, sum(power(0.75, 2001 - season) * value) / sum(power(0.75, 2001 - season)) as own, count(*) as anchors from v where team % 3 <> 0 and season < 2001 group by team), lg as (select avg(value) as league from v) select v.team, 'carries' as metric, coalesce(anchors, 0) as anchors, round(coalesce(0.5 * own + 0.3 * value + 0.2 * league, (0.3 * value + 0.2 * league) / 0.5), 6) as forecast from v left join ow using (team), lg where season = 2001",
)
def f1_caller_fingerprints(spark, sf_dir):
    player = agg.season_usage(season_rows(spark, sf_dir))
    rows = player.groupBy("season", "team").agg((F.sum("carries") / F.count("*")).alias("value")).withColumn("metric", F.lit("carries"))
    anchors = rows.filter("team % 3 <> 0 and season < 2001").withColumn("age", 2001 - F.col("season"))
    return forecast.caller_fingerprints(anchors, rows.filter("season = 2001"), rows.groupBy("metric").agg(F.avg("value").alias("value")))


@query(
    "f2_position_environments",
    "with m as (select s_suppkey as team, s_suppkey % 17 as pace, s_suppkey % 13 as volume from supplier), p as (select team, pace, volume, (rank() over (order by pace) - 1 + (count(*) over (partition by pace) - 1) / 2.0) / (count(*) over () - 1) as a, (rank() over (order by volume) - 1 + (count(*) over (partition by volume) - 1) / 2.0) / (count(*) over () - 1) as b from m), s as (select *, round(100 * (0.6 * a + 0.4 * b), 6) as score from p) select team, pace, volume, round(a, 6) as pace_percentile, round(b, 6) as volume_percentile, score from s",
)
def f2_position_environments(spark, sf_dir):
    metrics = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as team", "s_suppkey % 17 as pace", "s_suppkey % 13 as volume")
    return forecast.position_environments(metrics, {"pace": 0.6, "volume": 0.4}).drop("rank")


@query(
    "f6_latent_roles",
    WEEKLY_SQL + ", e as (select team, player_id, sum(volume) / sum(sum(volume)) over (partition by team) as share from weekly group by team, player_id), a as (select team, player_id, share / sum(share) over (partition by team) as act from e where player_id % 4 <> 1), m as (select team, sum(share) as mass from e semi join a using (team, player_id) group by team) select e.team, e.player_id, round(case when act is not null then act * mass else share end, 6) as latent from e left join a using (team, player_id) left join m on m.team = e.team",
)
def f6_latent_roles(spark, sf_dir):
    rows = weekly(spark, sf_dir).groupBy("team", "player_id").agg(F.sum("volume").alias("v"))
    everyone = windows.share_in_group(rows, ["team"], "v").select("team", "player_id", "share")
    active = windows.share_in_group(everyone.filter("player_id % 4 <> 1").withColumnRenamed("share", "s"), ["team"], "s").select("team", "player_id", F.col("share").alias("active_share"))
    return forecast.latent_roles(active, everyone, ["team"]).select("team", "player_id", "latent")


@query(
    "e8_rate_multipliers",
    SEASON_SQL + ", ev as (select player_id, season, team, sum(targets) as high, sum(carries) as base from player group by all), tm2 as (select season, team, sum(high) as th, sum(base) as tb from ev group by all), tg as (select player_id, min(team) as target_team from player where season = 2000 group by player_id), w as (select ev.*, th, tb, target_team, power(0.65, 1999 - ev.season) * case when ev.team = target_team then 1.0 else 0.7 end as w from ev join tm2 using (season, team) join tg using (player_id) where ev.season between 1997 and 1999), "
    "s as (select player_id, target_team, sum(w * high) as h, sum(w * base) as b, sum(w * th) as th, sum(w * tb) as tb, max(season) as last from w group by all), q as (select s.*, exists (select 1 from w where w.player_id = s.player_id and w.season = s.last and w.team = s.target_team) as same from s), r as (select *, (h + 24 * th / tb) / (b + 24) / (th / tb) as raw from q) select player_id, 2000 as target_season, round(h, 6) as high, round(b, 6) as base, round(least(4.0, greatest(0.25, case when same then raw else 1 + 0.45 * (raw - 1) end)), 6) as p24 from r",
)
def e8_rate_multipliers(spark, sf_dir):
    player = agg.season_usage(season_rows(spark, sf_dir))
    events = player.groupBy("player_id", "season", "team").agg(F.sum("targets").alias("high"), F.sum("carries").alias("base"))
    teams = events.groupBy("season", "team").agg(F.sum("high").alias("team_high"), F.sum("base").alias("team_base"))
    targets = player.filter("season = 2000").groupBy("player_id").agg(F.min("team").alias("team")).withColumn("target_season", F.lit(2000))
    return stats.shrunk_rate_multiplier(events, teams, targets, 3, priors=(24,))


PRIORS_SQL = (
    SEASON_SQL
    + ", ev as (select position || '_HIGH' as metric, player_id, season, team, sum(targets) as high, sum(carries) as base from player group by all), tt as (select metric, season, team, sum(high) as th, sum(base) as tb from ev group by all), "
    + "ro as (select metric, team, player_id, base as weight, high > 3 as active from ev where season = 2000), "
    + "w as (select ro.metric, ro.team as role, ro.player_id, ev.season, ev.team, ev.high, ev.base, th, tb, power(0.65, 1999 - ev.season) * case when ev.team = ro.team then 1.0 else 0.7 end as w from ro join ev on ev.metric = ro.metric and ev.player_id = ro.player_id join tt on tt.metric = ev.metric and tt.season = ev.season and tt.team = ev.team where ev.season between 1997 and 1999), "
    + "sm as (select metric, role, player_id, sum(w * high) as h, sum(w * base) as b, sum(w * th) / sum(w * tb) as rate, max(season) as last, max(case when team = role then season end) as own from w group by all), "
    + "mu as (select metric, role as team, player_id, h, b, unnest([12, 24, 48]) as k, rate, last is not distinct from own as same from sm), "
    + "mm as (select metric, team, player_id, h, b, k, least(4.0, greatest(0.25, case when same then (h + k * rate) / (b + k) / rate else 1 + 0.45 * ((h + k * rate) / (b + k) / rate - 1) end)) as m from mu), "
    + "mp as (select metric, team, player_id, any_value(h) as h, any_value(b) as b, max(case when k = 12 then m end) as p12, max(case when k = 24 then m end) as p24, max(case when k = 48 then m end) as p48 from mm group by all), "
    + "bs as (select ro.*, weight / sum(weight) over (partition by metric, team) as base_share from ro), "
    + "jn as (select bs.*, coalesce(h, 0) as high, coalesce(b, 0) as base, coalesce(p12, 1) as p12, coalesce(p24, 1) as p24, coalesce(p48, 1) as p48 from bs left join mp using (metric, team, player_id)), "
    + "sh as (select *, base_share * p12 / sum(base_share * p12) over r as share_p12, base_share * p24 / sum(base_share * p24) over r as share_p24, base_share * p48 / sum(base_share * p48) over r as share_p48 from jn window r as (partition by metric, team)), "
    + "pr as (select *, case when active then share_p24 / sum(case when active then share_p24 end) over (partition by metric, team) end as active_share, share_p24 - base_share as delta from sh)"
)


def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    player = agg.season_usage(season_rows(spark, sf_dir))
    events = player.groupBy(F.concat("position", F.lit("_HIGH")).alias("metric"), "player_id", "season", "team").agg(F.sum("targets").alias("high"), F.sum("carries").alias("base"))
    events = stored(events, "events")
    roles = events.filter("season = 2000").select("metric", "team", "player_id", F.col("base").alias("weight"), (F.col("high") > 3).alias("active"))
    return stored(forecast.high_value_priors(roles, events, 2000), "priors")


@query(
    "f10_high_value_priors",
    PRIORS_SQL + " select metric, team, player_id, round(base_share, 6) as base_share, round(high, 6)::double as high, round(base, 6)::double as base, round(p12, 6)::double as p12, round(p24, 6)::double as p24, round(p48, 6)::double as p48, round(share_p12, 6) as share_p12, round(share_p24, 6) as share_p24, round(share_p48, 6) as share_p48, round(active_share, 6) as active_share, round(least(share_p12, share_p24, share_p48), 6) as share_low, round(greatest(share_p12, share_p24, share_p48), 6) as share_high, round(delta, 6) + 0.0 as delta, case when base <= 0 then 'none' when base < 24 then 'limited' when base < 48 then 'moderate' else 'strong' end as history_support from pr",
)
def f10_high_value_priors(spark, sf_dir):
    return as_double(priors(spark, sf_dir), "high", "base").drop("weight", "active").select("metric", "team", "player_id", "base_share", "high", "base", "p12", "p24", "p48", "share_p12", "share_p24", "share_p48", "active_share", "share_low", "share_high", "delta", "history_support")


@query(
    "f10_high_value_reviews",
    PRIORS_SQL + " select metric, team, player_id::double as player_id, unnest(list_filter([case when base <= 0 and base_share >= 0.001 then 'role_without_history' end, case when base > 0 and base < 24 and base_share >= 0.001 then 'role_with_limited_history' end, case when abs(delta) >= 0.0005 then 'large_adjustment' end], lambda x: x is not null)) as issue from pr union all select metric, team, null, 'no_active_candidate' from pr group by metric, team having not bool_or(active)",
)
def f10_high_value_reviews(spark, sf_dir):
    return as_double(forecast.high_value_reviews(priors(spark, sf_dir), material=0.001, large=0.0005), "player_id")


@query(
    "f11_high_value_scenarios",
    PRIORS_SQL + ", ca as (select team, week, metric, player_id, share_p24 as weight, 0.3 + (player_id % 5) / 10.0 as p, (team + week) % 3 <> 0 as scheduled from pr, (select unnest([1, 2, 3]) as week)), dr as (select *, unnest(range(500)) as draw from ca), on_ as (select *, scheduled and ('0x' || substr(md5('7|' || player_id || '|' || week || '|' || draw), 1, 8))::bigint / 4294967296.0 < p as live from dr), "
    "to_ as (select *, sum(case when live then weight end) over (partition by team, week, metric, draw) as t from on_), sd as (select *, case when live and t > 0 then weight / t else 0.0 end as share from to_), un as (select team, week, metric, count(distinct case when t > 0 then draw end) as f from to_ where scheduled group by all) "
    "select team, week::bigint as week, metric, player_id::varchar as player_id, round(avg(share), 6) as mean_share, round(quantile_cont(share, 0.1), 6) as p10, round(quantile_cont(share, 0.5), 6) as p50, round(quantile_cont(share, 0.9), 6) as p90 from sd group by all union all select team, week, metric, '__UNALLOCATED__', round((500 - f) / 500.0, 6), null, null, null from un where f < 500",
)
def f11_high_value_scenarios(spark, sf_dir):
    found = priors(spark, sf_dir)
    weeks = found.select("team", "player_id").distinct().withColumn("week", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    weeks = weeks.withColumn("p", 0.3 + (F.col("player_id") % 5) / 10).withColumn("scheduled", (F.col("team") + F.col("week")) % 3 != 0)
    return forecast.high_value_scenarios(found, weeks, draws=500, seed=7)


@query(
    "e13_promotion_gate",
    EVAL_SQL + ", ev as (select position as metric, window_end, model, avg(error) as error, count(*) as events from e group by all), m as (select metric, model, avg(error) as mean, count(distinct window_end) as w from ev group by all), b as (select metric, mean as base from m where model = 'base'), d as (select m.metric, max(case when model <> 'base' then mean - base end) as worst, min(w) as w, arg_min(model, case when model <> 'base' then mean end) as best from m join b using (metric) group by m.metric), lst as (select metric, events from ev where model = 'base' and window_end = 18), cp as (select metric, window_end, error - (select error from ev x where x.metric = ev.metric and x.window_end = ev.window_end and x.model = 'base') as dl from ev where model = 'p24'), o as (select metric, sum((dl + 0.05 < 0)::int)::bigint as wins, sum((dl - 0.05 > 0)::int)::bigint as losses from cp group by metric) select d.metric, round(worst, 6) + 0.0 as worst_delta, best as best_model, wins, losses, (w = 3 and events >= 10 and wins >= 2 and losses = 0 and worst < 0) as promoted from d join lst using (metric) join o using (metric)",
)
def e13_promotion_gate(spark, sf_dir):
    rows = errors(spark, sf_dir).groupBy(F.col("position").alias("metric"), "window_end", "model").agg(F.avg("error").alias("error"), F.count("*").alias("events"))
    rows = rows.withColumn("rooms", F.col("events"))
    deltas = windows.scope_deltas(rows, ["metric", "window_end"], "model", "error", "base")
    comparisons = deltas.select("metric", "window_end", F.col("model").alias("challenger"), (F.col("delta") - 0.05).alias("low"), (F.col("delta") + 0.05).alias("high"))
    return stats.promotion_gate(rows, comparisons, "base", "p24", (4, 8, 18), 10, 10)


@query("c14_status_families", "select case event_type when 'click' then 'active_53' when 'view' then 'practice_squad' else 'reserve_other' end as family, count(*) as rows from events group by 1")
def c14_status_families(spark, sf_dir):
    codes = F.expr("case event_type when 'click' then ' act' when 'view' then 'DEV' else 'res' end")
    return _read(spark, sf_dir, "events").select(clean.status_family(codes, F.lit("R99")).alias("family")).groupBy("family").agg(F.count("*").alias("rows"))


@query("c10_points", "select l_orderkey as game_id, l_linenumber::bigint as line, round(coalesce(case when l_partkey % 10 = 0 then 5.0 end, l_quantity * 0.1 + l_tax * 6), 6) as points from lineitem")
def c10_points(spark, sf_dir):
    projected = F.expr("case when l_partkey % 10 = 0 then 5.0D end")
    points = clean.fantasy_points(projected, {"yards": F.col("l_quantity"), "scores": F.col("l_tax")}, {"yards": 0.1, "scores": 6.0})
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("line"), points.alias("points"))


@query("c10_points_all", "select l_orderkey as game_id, l_linenumber::bigint as line, round(coalesce(case when l_partkey % 10 = 0 then 5.0 end, l_quantity * 0.1 + l_tax * 6), 6) as points from lineitem")
def c10_points_all(spark, sf_dir):
    projected = F.expr("case when l_partkey % 10 = 0 then 5.0D end")
    points = clean.fantasy_points(projected, {"yards": F.col("l_quantity"), "scores": F.col("l_tax")}, {"yards": 0.1, "scores": 6.0})
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("line"), points.alias("points"))


@query("f12_f13_event_counts", WEEKLY_SQL + ", p as (select team, sum(volume) as pool from weekly group by team), r as (select team, pool, 0.1 + team / 100.0 as rate from p), s as (select team, week, player_id, volume / sum(volume) over (partition by team, week) as share from weekly) select s.team, player_id, round(sum(pool * rate * share), 6) as season_events from s join r using (team) group by all")
def f12_f13_event_counts(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    pools = rows.groupBy("team").agg(F.sum("volume").alias("pool"))
    rates = pools.select("team", (0.1 + F.col("team") / 100).alias("rate"))
    events = forecast.event_pools(pools, rates, pool_radius=1.0, rate_radius=0.02).select("team", "events")
    return forecast.player_event_counts(rows.select("team", "week", "player_id", F.col("volume").alias("share")), events)


RATE_SQL = (
    PLAYS_SQL
    + ", v as (select season, week, team, sum(pass) as amount, count(distinct game_id) as games from plays group by season, week, team), "
    + "tg as (select unnest([1999, 2000, 2001]) as target), past as (select target, v.*, power(0.65, target - 1 - season) as w from v, tg where season between target - 3 and target - 1), "
    + "t as (select target, team, sum(w * amount) as x, sum(w * games) as n from past group by all), l as (select target, sum(w * amount) / sum(w * games) as league from past group by target), "
    + "act as (select season as target, team, we as window_end, sum(amount) / sum(games) as actual from v, (select unnest([4, 8, 18]) as we) where week <= we group by all), "
    + "pr as (select target, team, unnest(['league', 'raw', 'p4', 'p17']) as model, unnest([league, x / n, (x + 4 * league) / (n + 4), (x + 17 * league) / (n + 17)]) as forecast from t join l using (target)), "
    + "rt as (select pr.*, window_end, actual, abs(forecast - actual) as error from pr join act using (target, team))"
)


def rate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Plays without their players' positions, which no rate reads: joining the roster would shuffle them twice.
    values = _stand_in(spark, sf_dir, "lineitem", PLAYS).groupBy("season", "week", "team").agg(F.sum("pass").alias("amount"), F.countDistinct("game_id").alias("games"))
    return backtests.rate_backtest(values, (1999, 2000, 2001))


@query(
    "e17_rate_backtest",
    RATE_SQL + ", s as (select unnest(['ALL', target::varchar]) as scope, window_end, model, error from rt), g as (select scope, window_end, model, count(*) as n, avg(error) as m, median(error) as md, quantile_cont(error, 0.75) as q, sqrt(avg(error * error)) as r from s group by all), b as (select *, max(case when model = 'league' then m end) over (partition by scope, window_end) as base from g) select scope, window_end::bigint as window_end, model, n, round(m, 6) as mean_error, round(md, 6) as median_error, round(q, 6) as p75_error, round(r, 6) as rmse, round(m - base, 6) + 0.0 as delta, round((base - m) / base, 6) + 0.0 as improvement from b",
)
def e17_rate_backtest(spark, sf_dir):
    return backtests.rate_summary(rate_rows(spark, sf_dir))


@query(
    "e17_holdout_calibration",
    RATE_SQL + ", o as (select window_end, error, row_number() over (partition by window_end order by error) as i, count(*) over (partition by window_end) as n from rt where model = 'p17' and target < 2001), r as (select window_end, error as radius from o where i = least(n, ceil((n + 1) * 0.9))), h as (select rt.window_end, actual - forecast as d, radius from rt join r using (window_end) where model = 'p17' and target = 2001) select window_end::bigint as window_end, count(*) as rows, sum((abs(d) <= radius)::int)::bigint as covered, sum((d < -radius)::int)::bigint as below, sum((d > radius)::int)::bigint as above, round(avg(2 * radius), 6) as mean_width, round(avg((abs(d) <= radius)::int), 6) as rate, round(any_value(radius), 6) as radius from h group by window_end",
)
def e17_holdout_calibration(spark, sf_dir):
    return backtests.holdout_calibration(rate_rows(spark, sf_dir), 2001, "p17")


@query(
    "e15_allocation_backtest",
    WEEKLY_SQL + ", act0 as (select 2024 as season, team, 'R' as resource, week, player_id, volume as amount from weekly where player_id % 7 <> 0), act as (select distinct team, week, player_id from weekly where player_id % 3 <> 0), "
    "wt as (select team, player_id, unnest(['even', 'steep']) as model, unnest([1.0, 1.0 / (1 + player_id % 5)]::double[]) as weight from (select distinct team, player_id from weekly where player_id % 5 <> 0)), pool as (select team, week, sum(amount) as pool from act0 group by all), "
    "live as (select a.team, a.week, w.model, a.player_id, w.weight from act a join wt w using (team, player_id)), tot as (select team, week, model, sum(weight) as t from live group by all), "
    "al as (select l.team, l.week, l.model, l.player_id::varchar as player_id, pool * weight / t as x from live l join tot using (team, week, model) join pool using (team, week) union all select p.team, p.week, m.model, '__UNALLOCATED__', p.pool from pool p cross join (select distinct team as mt, model from wt) m where m.mt = p.team and not exists (select 1 from tot where tot.team = p.team and tot.week = p.week and tot.model = m.model)), "
    "we as (select unnest([4, 8, 18]) as window_end), f as (select team, model, window_end, player_id, sum(x) as f from al, we where week <= window_end group by all), ac as (select team, window_end, player_id::varchar as player_id, sum(amount) as a from act0, we where week <= window_end group by all), am as (select ac.*, model from ac join (select distinct team, model from wt) using (team)), tp as (select team, window_end, sum(pool) as pool from pool, we where week <= window_end group by all), "
    "j as (select coalesce(f.team, am.team) as team, coalesce(f.model, am.model) as model, coalesce(f.window_end, am.window_end) as window_end, coalesce(f.player_id, am.player_id) as player_id, coalesce(f, 0) as f, coalesce(a, 0) as a, f.team is not null as opening from f full join am on f.team = am.team and f.model = am.model and f.window_end = am.window_end and f.player_id = am.player_id), "
    "s as (select j.*, f / pool as fs, a / pool as acs from j join tp using (team, window_end)) select 2024 as season, team, 'R' as resource, model, window_end::bigint as window_end, round(sum(abs(fs - acs)) / 2, 6) as total_variation, round(avg(abs(fs - acs)), 6) as mean_error, round(sum(case when opening then acs else 0 end), 6) as coverage, (first(player_id order by round(fs, 9) desc, player_id) = first(player_id order by round(acs, 9) desc, player_id)) as top_hit from s group by team, model, window_end",
)
def e15_allocation_backtest(spark, sf_dir):
    rows = weekly(spark, sf_dir)
    key = rows.withColumn("season", F.lit(2024)).withColumn("resource", F.lit("R"))
    actual = key.filter("player_id % 7 <> 0").select("season", "team", "resource", "week", "player_id", F.col("volume").alias("amount"))
    active = key.filter("player_id % 3 <> 0").select("season", "team", "week", "player_id").distinct()
    weights = key.filter("player_id % 5 <> 0").select("season", "team", "resource", "player_id").distinct()
    weights = weights.withColumn("even", F.lit(1.0)).withColumn("steep", 1 / (1 + F.col("player_id") % 5)).unpivot(["season", "team", "resource", "player_id"], ["even", "steep"], "model", "weight")
    return backtests.allocation_backtest(weights, active, actual)


TRANSITION_SQL = (
    PLAYS_SQL
    + f", ep as (select * from plays where {ELIGIBLE}), st as (select season, team, sum(pass)::double / count(*) as pass_rate, sum(success)::double / count(*) as success_rate from ep group by all), "
    + "pr as (select team, unnest(['pass_rate', 'success_rate']) as metric, unnest([pass_rate, success_rate]) as value from st where season = 1999), lg as (select metric, median(value) as league from pr group by metric), "
    + "wk as (select we as window_end, team, sum(pass)::double / count(*) as pass_rate, sum(success)::double / count(*) as success_rate from ep, (select unnest([6, 8]) as we) where season = 2000 and week <= we group by all), ac as (select team, window_end, unnest(['pass_rate', 'success_rate']) as metric, unnest([pass_rate, success_rate]) as actual from wk), "
    + "co as (select distinct team, case team % 3 when 0 then 'returning' when 1 then 'changed_with_anchor' else 'changed_without_anchor' end as cohort, case when team % 3 = 1 then team - 1 end as anchor_team from pr), "
    + "j as (select pr.team, pr.metric, cohort, pr.value as persistence, league, an.value as anchor from pr join lg using (metric) join co on co.team = pr.team left join pr an on an.team = co.anchor_team and an.metric = pr.metric), "
    + "f as (select team, metric, cohort, unnest(['persistence', 'shrunken', 'caller_aware']) as model, unnest([persistence, 0.8 * persistence + 0.2 * league, case cohort when 'returning' then 0.95 * persistence + 0.05 * league when 'changed_with_anchor' then 0.7 * anchor + 0.2 * persistence + 0.1 * league else 0.6 * persistence + 0.4 * league end]) as forecast from j), "
    + "tr as (select f.*, window_end, actual, abs(forecast - actual) / 0.05 as error from f join ac using (team, metric) where forecast is not null)"
)


def transitions(spark: SparkSession, sf_dir: str, season: int = 2000) -> DataFrame:
    rows = plays(spark, sf_dir)
    metrics = ["pass_rate", "success_rate"]
    prior = agg.unpivoted(agg.team_style(rows.filter(F.col("season") == season - 1)), ["team"], metrics)
    parts = [agg.unpivoted(agg.team_style(rows.filter(F.col("season") == season), weeks=(1, w)), ["team"], metrics).withColumn("window_end", F.lit(w)) for w in (6, 8)]
    kind = F.expr("case team % 3 when 0 then 'returning' when 1 then 'changed_with_anchor' else 'changed_without_anchor' end")
    cohorts = prior.select("team").distinct().select("team", kind.alias("cohort"), F.expr("case when team % 3 = 1 then team - 1 end").alias("anchor_team"))
    tolerances = spark.createDataFrame([(m, 0.05) for m in metrics], "metric string, tolerance double")
    return backtests.transition_backtest(prior, parts[0].unionByName(parts[1]), cohorts, tolerances)


@query("e18_transition_backtest", TRANSITION_SQL + " select team::bigint as team, metric, cohort, model, window_end::bigint as window_end, round(forecast, 6) as forecast, round(actual, 6) as actual, round(error, 6) as error from tr")
def e18_transition_backtest(spark, sf_dir):
    return transitions(spark, sf_dir).drop("tolerance")


@query(
    "e19_paired_effects",
    TRANSITION_SQL + " select c.team::bigint as team, c.window_end::bigint as window_end, round(avg(c.error - b.error), 6) + 0.0 as paired_delta, count(*) as metrics from tr c join tr b using (team, window_end, metric) where c.model = 'caller_aware' and b.model = 'shrunken' group by all",
)
def e19_paired_effects(spark, sf_dir):
    return backtests.paired_team_effects(transitions(spark, sf_dir))


@query(
    "f7_availability_queue",
    "with r as (select c_custkey as player_id, c_nationkey as team, c_custkey % 4 as position, case c_custkey % 5 when 0 then 'ACT' when 1 then 'RES' when 2 then 'PUP' else 'CUT' end as status from customer), d as (select s_suppkey as player_id, s_nationkey as team, s_suppkey % 4 as position, s_suppkey % 3 + 1 as depth_rank from supplier), m as (select p_partkey as player_id, p_size::double as adp from part where p_type in ('ECONOMY', 'PROMO')), g as (select o_custkey as player_id, count(*) as games from orders group by 1), k as (select r.*, depth_rank, adp, games from r left join d using (player_id, team, position) left join m using (player_id) left join g using (player_id) where status in ('RES', 'PUP') and (depth_rank is not null or adp is not null or games > 0)) select player_id, row_number() over (partition by team order by adp asc nulls last, player_id) as queue_rank from k",
)
def f7_availability_queue(spark, sf_dir):
    roster_rows = _read(spark, sf_dir, "customer").selectExpr("c_custkey as player_id", "c_nationkey as team", "c_custkey % 4 as position", "case c_custkey % 5 when 0 then 'ACT' when 1 then 'RES' when 2 then 'PUP' else 'CUT' end as status")
    depth = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey as player_id", "s_nationkey as team", "s_suppkey % 4 as position", "s_suppkey % 3 + 1 as depth_rank")
    market = _read(spark, sf_dir, "part").filter("p_type in ('ECONOMY', 'PROMO')").selectExpr("p_partkey as player_id", "cast(p_size as double) as adp")
    games = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player_id")).agg(F.count("*").alias("games"))
    return forecast.availability_queue(roster_rows, depth, market, games, ["ACT", "RES", "PUP"]).select("player_id", "queue_rank")


@query(
    "f21_live_board",
    BOARD_SQL + ", b as (select player_id % 3 as draft_id, player_id, position, points / 100 as ds, case player_id % 3 when 0 then 'starter' when 1 then 'flex' else 'bench' end as status, size % 14 + 1 as rd, size % 5 as dr, size * 2 as sv, 0.5 + size % 10 / 10.0 as ps, size % 9 as rn, size % 4 as ov from board), t as (select *, ds + case status when 'starter' then 0.45 + least(1.0, (rd - 1) / 12.0) * 1.2 when 'flex' then 0.25 + least(1.0, (rd - 1) / 12.0) * 0.65 else 0 end + least(2.4, dr * 0.55) + greatest(-1.4, least(1.4, (50 - sv) / 50.0 * 1.4)) + greatest(-0.8, least(0.8, (ps - 1) * 0.9)) + least(1.28, rn * 0.16) - case when position = 'K' and rd < 12 then (12 - rd) * 0.65 else 0 end - case when status = 'bench' then greatest(1, ov + 1) * 0.8 else 0 end as total from b) select draft_id, player_id, round(total, 4) as total from t",
)
def f21_live_board(spark, sf_dir):
    rows = board(spark, sf_dir).selectExpr(
        "player_id % 3 as draft_id", "player_id", "position", "points / 100 as draft_score", "case player_id % 3 when 0 then 'starter' when 1 then 'flex' else 'bench' end as status", "size % 14 + 1 as round", "size % 5 as drop", "size * 2 as survival", "0.5D + size % 10 / 10 as pressure", "size % 9 as run", "size % 4 as over"
    )
    return forecast.live_board(rows).select("draft_id", "player_id", F.round("total", 4).alias("total"))
