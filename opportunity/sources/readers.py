"""Typed readers. Every reader goes through Spark's own sources, so any file system works."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opportunity.functions.clean import canonical_team, draft_position, finite, flag01, integral, lookup, skill_position, word_bool
from opportunity.operators.joins import asof_latest
from opportunity.operators.windows import keep_best
from opportunity.quality import QualityError, assert_range, assert_unique

#: Seasons of one read.
MOST_SEASONS = 500
PLAY_NUMBERS = ("yardline_100", "yards_gained", "air_yards", "epa", "wp", "pass_oe", "half_seconds_remaining", "ydstogo")
PLAY_WHOLE = ("season", "week", "qtr", "down")
PLAY_FLAGS = ("qb_kneel", "qb_spike", "qb_scramble", "pass", "rush", "shotgun", "no_huddle", "success", "goal_to_go")
PLAY_TEXT = ("game_id", "play_id", "receiver_player_id", "rusher_player_id")
CHARTING_FLAGS = ("is_motion", "is_play_action", "is_screen_pass", "is_rpo", "is_trick_play", "is_qb_out_of_pocket", "is_qb_sneak")
# Fixed values.
MARKET_POSITIONS = {"QB": "QB", "RB": "RB", "WR": "WR", "TE": "TE", "PK": "K", "K": "K", "DEF": "DST", "DST": "DST", "D/ST": "DST"}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raises if a column is missing; others are left alone."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise QualityError(f"columns missing: {', '.join(missing)}")
    return df


def read_text_table(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """A CSV file, plain or gzip, with a header; all columns as text."""
    return require_columns(spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=False), required)


def _blank_to_null(name: str):
    return F.when(F.trim(name) != "", F.trim(name))


def read_plays(spark: SparkSession, path: str, season: int | None = None, season_type: str = "REG", weeks: tuple[int, int] | None = None) -> DataFrame:
    """Plays of one season type and week range; a row of another season is an error."""
    raw = read_text_table(spark, path, [*PLAY_WHOLE, "season_type", "posteam", "game_id", "play_id"])
    have = set(raw.columns)
    columns = [integral(F.col(c)).cast("int").alias(c) for c in PLAY_WHOLE]
    columns += [(finite(F.col(c)) if c in have else F.lit(None).cast("double")).alias(c) for c in PLAY_NUMBERS]
    columns += [(flag01(F.col(c)) if c in have else F.lit(None).cast("int")).alias(c) for c in PLAY_FLAGS]
    columns += [(_blank_to_null(c) if c in have else F.lit(None).cast("string")).alias(c) for c in PLAY_TEXT]
    plays = raw.select(*columns, F.upper(F.trim("posteam")).alias("team"), F.upper(F.trim("season_type")).alias("season_type"))
    if season is not None:
        assert_range(plays, {"season": F.coalesce(F.col("season") == season, F.lit(True))})
    plays = plays.filter(F.col("season_type") == season_type)
    return plays if weeks is None else plays.filter(F.col("week").between(*weeks))


def read_charting(spark: SparkSession, path: str) -> DataFrame:
    """Charting flags by game and play; a duplicate key is an error."""
    raw = read_text_table(spark, path)
    game, play = next(c for c in raw.columns if c.endswith("game_id")), next(c for c in raw.columns if c.endswith("play_id"))
    flags = [word_bool(F.col(c)).alias(c) for c in CHARTING_FLAGS if c in raw.columns]
    more = [F.upper(_blank_to_null(c)).alias(n) for c, n in (("qb_location", "qb_location"), ("read_thrown", "read_code")) if c in raw.columns]
    backs = [integral(F.col("n_offense_backfield")).cast("int").alias("backfield")] if "n_offense_backfield" in raw.columns else []
    found = raw.select(_blank_to_null(game).alias("game_id"), _blank_to_null(play).alias("play_id"), *flags, *more, *backs)
    assert_unique(found, ["game_id", "play_id"])
    return found


def read_weekly_rosters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: one row per season, week, team and player of skill positions in weeks 1-18 (the first in the file), and the rows for review."""
    raw = read_text_table(spark, path, ["season", "week", "team", "position", "status", "full_name", "gsis_id", "game_type"])
    # Rows of one split are numbered in order, and splits by where they start.
    raw = raw.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_order"))
    rows = raw.select(
        integral(F.col("season")).cast("int").alias("season"), integral(F.col("week")).cast("int").alias("week"), canonical_team(F.col("team")).alias("team"),
        skill_position(F.col("position")).alias("position"), _blank_to_null("gsis_id").alias("player_id"), F.trim("full_name").alias("player_name"),
        F.upper(F.trim("status")).alias("status"), F.upper(F.trim("game_type")).alias("game_type"), "_order",
    ).filter("game_type = 'REG' and week between 1 and 18 and position <> 'OTHER'").drop("game_type")
    keys = ["season", "week", "team", "player_id"]
    known = rows.filter("player_id is not null")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
    ranked = known.withColumn("_place", place).drop("_order")
    review = rows.filter("player_id is null").drop("_order").withColumn("reason", F.lit("missing_id")).unionByName(ranked.filter("_place > 1").drop("_place").withColumn("reason", F.lit("duplicate")))
    return ranked.filter("_place = 1").drop("_place"), review


def read_opening_depth(spark: SparkSession, paths: Mapping[str, str], cutoffs: DataFrame) -> DataFrame:
    """Opening depth rows of two layouts: ``weekly`` (week 1 of a season) and ``dated`` (last time before the cutoff).

    ``cutoffs`` has season and cutoff (a date). A dated row belongs to the season whose cutoff is the
    next one after it; of each season and team the last time stays.
    """
    parts = []
    if "weekly" in paths:
        raw = read_text_table(spark, paths["weekly"], ["season", "club_code", "week", "game_type", "depth_team", "formation", "gsis_id", "position"])
        rows = raw.filter((F.upper(F.trim("game_type")) == "REG") & (integral(F.col("week")) == 1) & (F.lower(F.trim("formation")) == "offense"))
        parts.append(rows.select(integral(F.col("season")).cast("int").alias("season"), canonical_team(F.col("club_code")).alias("team"), skill_position(F.col("position")).alias("position"), _blank_to_null("gsis_id").alias("player_id"), integral(F.col("depth_team")).cast("int").alias("depth_rank")))
    if "dated" in paths:
        raw = read_text_table(spark, paths["dated"], ["dt", "team", "gsis_id", "pos_abb", "pos_rank"])
        rows = raw.select(F.to_timestamp(F.trim("dt")).alias("dt"), canonical_team(F.col("team")).alias("team"), skill_position(F.col("pos_abb")).alias("position"), _blank_to_null("gsis_id").alias("player_id"), integral(F.col("pos_rank")).cast("int").alias("depth_rank"))
        bounds = sorted((r.cutoff, r.season) for r in cutoffs.select("season", F.col("cutoff").cast("timestamp").alias("cutoff")).distinct().limit(MOST_SEASONS + 1).collect())
        if len(bounds) > MOST_SEASONS:
            raise QualityError(f"more than {MOST_SEASONS} cutoffs")
        season = F.lit(None).cast("int")
        for cutoff, number in reversed(bounds):
            season = F.when(F.col("dt") < F.lit(cutoff), number).otherwise(season)
        dated = asof_latest(rows.withColumn("season", season).filter("season is not null"), ["season", "team"], "dt")
        parts.append(dated.select("season", "team", "position", "player_id", "depth_rank"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return keep_best(found.filter("player_id is not null and position <> 'OTHER'"), ["season", "team", "position", "player_id"], [F.coalesce("depth_rank", F.lit(1 << 30))])


def read_weekly_opportunities(spark: SparkSession, path: str) -> DataFrame:
    """Dropbacks, carries and targets per player and week; blanks are 0; a duplicate key is an error."""
    raw = read_text_table(spark, path, ["player_id", "position", "season", "week", "season_type", "team", "attempts", "sacks_suffered", "carries", "targets"])
    number = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
    rows = raw.filter(F.upper(F.trim("season_type")) == "REG").select(
        integral(F.col("season")).cast("int").alias("season"), integral(F.col("week")).cast("int").alias("week"), canonical_team(F.col("team")).alias("team"), skill_position(F.col("position")).alias("position"),
        _blank_to_null("player_id").alias("player_id"), (number("attempts") + number("sacks_suffered")).alias("dropbacks"), number("carries").alias("carries"), number("targets").alias("targets"),
    ).filter("week between 1 and 18")
    assert_unique(rows.filter("player_id is not null"), ["season", "week", "team", "player_id"])
    return rows


def read_schedule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Two team rows for each game, and the first day of each season's week 1."""
    raw = read_text_table(spark, path, ["game_id", "season", "game_type", "week", "gameday", "away_team", "home_team"])
    games = raw.filter(F.upper(F.trim("game_type")) == "REG").select(
        F.trim("game_id").alias("game_id"), integral(F.col("season")).cast("int").alias("season"), integral(F.col("week")).cast("int").alias("week"), F.to_date(F.trim("gameday")).alias("gameday"),
        canonical_team(F.col("away_team")).alias("away"), canonical_team(F.col("home_team")).alias("home"),
    )
    sides = F.array(F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.lit("away").alias("home_away")), F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.lit("home").alias("home_away")))
    rows = games.select("game_id", "season", "week", "gameday", F.explode(sides).alias("side")).select("game_id", "season", "week", "gameday", "side.*")
    return rows, games.filter("week = 1").groupBy("season").agg(F.min("gameday").alias("cutoff"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Player catalog; ids must be unique."""
    raw = read_text_table(spark, path, ["gsis_id", "display_name"])
    rows = raw.select(_blank_to_null("gsis_id").alias("player_id"), F.trim("display_name").alias("name"), *[_blank_to_null(c).alias(c) for c in ("pfr_id", "espn_id", "latest_team", "status") if c in raw.columns])
    assert_unique(rows.filter("player_id is not null"), ["player_id"])
    return rows


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Season roster: one row for each season and player."""
    raw = read_text_table(spark, path, ["season", "team", "position", "full_name", "gsis_id", "status"])
    more = [_blank_to_null(c).alias(n) for c, n in (("pfr_id", "other_id"), ("week", "week")) if c in raw.columns]
    rows = raw.select(
        integral(F.col("season")).cast("int").alias("season"), canonical_team(F.col("team")).alias("team"), skill_position(F.col("position")).alias("position"),
        _blank_to_null("gsis_id").alias("player_id"), F.trim("full_name").alias("name"), F.upper(F.trim("status")).alias("status"), *more,
    )
    assert_unique(rows.filter("player_id is not null"), ["season", "player_id"])
    return rows


def read_snap_counts(spark: SparkSession, path: str) -> DataFrame:
    """Offensive snaps of each player and game of the regular season, by the second id."""
    raw = read_text_table(spark, path, ["season", "game_id", "game_type", "week", "player", "pfr_player_id", "team", "offense_snaps"])
    rows = raw.filter(F.upper(F.trim("game_type")) == "REG").select(
        integral(F.col("season")).cast("int").alias("season"), F.trim("game_id").alias("game_id"), integral(F.col("week")).cast("int").alias("week"), canonical_team(F.col("team")).alias("team"),
        F.trim("player").alias("name"), _blank_to_null("pfr_player_id").alias("other_id"), F.coalesce(finite(F.col("offense_snaps")), F.lit(0.0)).alias("snaps"),
    )
    assert_range(rows, {"snaps": F.col("snaps") >= 0})
    return rows


def read_adp(spark: SparkSession, path: str) -> DataFrame:
    """Draft positions of a JSON document with ``players``; positions mapped, ranges checked."""
    raw = spark.read.json(path, multiLine=True)
    rows = raw.select(F.explode("players").alias("p")).select("p.*")
    found = rows.select(
        F.col("player_id").cast("string").alias("source_player_id"), F.trim("name").alias("name"), lookup(MARKET_POSITIONS, F.upper(F.trim("position"))).alias("position"), F.upper(F.trim("team")).alias("team"),
        F.col("bye").cast("int").alias("bye"), F.col("adp").cast("double").alias("adp"), F.col("times_drafted").cast("int").alias("drafts"), F.col("high").cast("int").alias("high"), F.col("low").cast("int").alias("low"), F.col("stdev").cast("double").alias("stdev"),
    )
    assert_range(found, {"position": F.col("position").isNotNull(), "range": F.col("high") <= F.col("low"), "bye": F.col("bye").between(1, 18), "adp": F.col("adp") > 0, "stdev": F.col("stdev") >= 0})
    assert_unique(found, ["source_player_id"])
    return found.orderBy("adp", "source_player_id")


def read_season_usage(spark: SparkSession, path: str, season: int) -> DataFrame:
    """Weekly usage of one season and four positions; bad counts and duplicates are errors."""
    raw = read_text_table(spark, path, ["player_id", "position", "team", "season", "season_type", "week", "targets", "carries", "attempts"])
    share = finite(F.col("target_share")) if "target_share" in raw.columns else F.lit(None).cast("double")
    rows = raw.filter((integral(F.col("season")) == season) & (F.upper(F.trim("season_type")) == "REG") & F.upper(F.trim("position")).isin("QB", "RB", "WR", "TE")).select(
        F.trim("player_id").alias("player_id"), F.upper(F.trim("position")).alias("position"), F.upper(F.trim("team")).alias("team"), integral(F.col("week")).cast("int").alias("week"),
        *[finite(F.col(c)).alias(c) for c in ("targets", "carries", "attempts")], share.alias("target_share"),
    )
    assert_range(rows, {"week": F.col("week").between(1, 18), **{c: F.col(c) >= 0 for c in ("targets", "carries", "attempts")}, "share": F.coalesce(F.col("target_share").between(0, 1), F.lit(True))})
    assert_unique(rows, ["player_id", "week"])
    return rows


def read_closed_table(spark: SparkSession, path: str, text: Sequence[str], numbers: Mapping[str, float | None]) -> DataFrame:
    """A CSV with a closed set of columns; blanks take the default of their column."""
    raw = read_text_table(spark, path)
    if unknown := sorted(set(raw.columns) - set(text) - set(numbers)):
        raise QualityError(f"unknown columns: {', '.join(unknown)}")
    columns = [(F.trim(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in text]
    for name, default in numbers.items():
        value = finite(F.col(name)) if name in raw.columns else F.lit(None).cast("double")
        columns.append((value if default is None else F.coalesce(value, F.lit(float(default)))).alias(name))
    return raw.select(*columns)


# Columns of the two tables and what a blank means.
PROJECTION_TEXT = ("player_id", "name", "position", "team")
PROJECTION_NUMBERS = {
    "bye_week": None, "adp": None, "projected_points": None, "floor_points": None, "ceiling_points": None,
    "passing_yards": 0.0, "passing_touchdowns": 0.0, "interceptions": 0.0, "rushing_yards": 0.0, "rushing_touchdowns": 0.0, "receptions": 0.0, "receiving_yards": 0.0, "receiving_touchdowns": 0.0,
    "two_point_conversions": 0.0, "fumbles_lost": 0.0, "return_touchdowns": 0.0, "field_goals_0_39": 0.0, "field_goals_40_49": 0.0, "field_goals_50_plus": 0.0, "extra_points": 0.0,
    "team_offense_rating": 0.5, "offensive_line_rating": 0.5, "role_security": 0.5, "injury_risk": 0.0, "upside_rating": 0.5, "opportunity_rating": 0.5, "high_value_usage_rating": 0.5,
    "competition_rating": 0.5, "efficiency_rating": 0.5, "receiving_role_rating": 0.5, "rushing_floor_rating": 0.5, "weekly_variance": 0.5,
}
PROJECTION_RATINGS = tuple(c for c in PROJECTION_NUMBERS if c.endswith("_rating") or c in ("role_security", "injury_risk", "weekly_variance"))
PROFILE_RATINGS = (
    "pass_volume_rating", "rush_volume_rating", "qb_play_rating", "play_caller_rating", "pass_blocking_rating", "run_blocking_rating", "pace_rating", "scoring_environment_rating", "positive_game_script_rating", "continuity_rating",
)


def _typed(spark: SparkSession, path: str, text: Sequence[str], numbers: Mapping[str, float | None]) -> DataFrame:
    """``read_closed_table`` whose text columns must be there and whose numbers, if not blank, must be finite; no rows are an error."""
    raw = read_text_table(spark, path, list(text))
    given = [c for c in numbers if c in raw.columns]
    bad = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when((F.trim(c) != "") & finite(F.col(c)).isNull(), F.lit(c)) for c in given]))
    if found := raw.select(bad.alias("bad")).filter(F.size("bad") > 0).limit(1).collect():
        raise QualityError(f"not a number: {found[0].bad[0]}")
    rows = read_closed_table(spark, path, text, numbers)
    if not rows.limit(1).count():
        raise QualityError("the table has no rows")
    return rows


def read_projections(spark: SparkSession, path: str) -> DataFrame:
    """Projected players; blank counts are 0, blank ratings neutral, and a blank bye, market position or total unknown.

    Teams are upper-cased, positions as in drafts. A player without an id, name or team, an id that is
    there twice, another position, a rating outside 0 to 1, a bye outside 1 to 18, a floor above the
    ceiling and a broken number are errors.
    """
    rows = _typed(spark, path, PROJECTION_TEXT, PROJECTION_NUMBERS)
    rows = rows.withColumn("team", F.upper("team")).withColumn("position", draft_position(F.col("position")))
    assert_range(rows, {
        **{c: F.coalesce(F.col(c) != "", F.lit(False)) for c in ("player_id", "name", "team")},
        "bye_week": F.col("bye_week").isNull() | (F.col("bye_week").between(1, 18) & (F.col("bye_week") == F.floor("bye_week"))),
        "position": F.coalesce(F.col("position").isin("QB", "RB", "WR", "TE", "K", "DST"), F.lit(False)),
        "floor": F.coalesce(F.col("floor_points") <= F.col("ceiling_points"), F.lit(True)),
        **{c: F.col(c).between(0, 1) for c in PROJECTION_RATINGS},
    })
    assert_unique(rows, ["player_id"])
    return rows.withColumn("bye_week", F.col("bye_week").cast("int"))


def read_team_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Ratings of teams, 0 to 1; a blank or absent one is neutral (0.5). A team that is there twice is an error."""
    rows = _typed(spark, path, ("team",), {c: 0.5 for c in PROFILE_RATINGS}).withColumn("team", F.upper("team"))
    assert_range(rows, {"team": F.coalesce(F.col("team") != "", F.lit(False)), **{c: F.col(c).between(0, 1) for c in PROFILE_RATINGS}})
    assert_unique(rows, ["team"])
    return rows


def with_profiles(players: DataFrame, profiles: DataFrame) -> DataFrame:
    """Players with their team's ratings; a team without a profile has neutral ones."""
    return players.join(profiles.select("team", *PROFILE_RATINGS), "team", "left").fillna(0.5, list(PROFILE_RATINGS))


EVIDENCE_SCHEMA = """
sources array<struct<id:string,url:string,published:string>>,
teams array<struct<team:string,scheme_family:string,scheme_continuity:double,returning_starters_fraction:double,
  staff:array<struct<name:string,roles:array<string>,continuity:string,influence_weight:double,is_head_coach:boolean,is_play_caller:boolean,
    completed_playcalling_seasons:double,playcaller_confirmation:string,source_ids:array<string>>>,
  anchors:array<struct<team:string,season:int,weight:double,reason:string>>,
  claims:array<struct<id:string,source_id:string,confidence:double,certainty_effect:double,dimensions:array<string>,metric_signals:map<string,double>>>>>,
records array<struct<id:string,season:int,team:string,player_id:string,metrics:array<string>,finding:string,source_ids:array<string>>>
"""


def read_evidence(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested evidence as flat tables: sources, teams, staff, anchors, claims, claim_signals and records.

    ``staff`` has a row for each person of a team, ``anchors`` for each past season that a team's
    caller is judged by, ``claim_signals`` for each metric of a claim and ``records`` for each metric
    of a reviewed record. Parts that a document lacks give no rows.
    """
    raw = spark.read.schema(EVIDENCE_SCHEMA).json(path, multiLine=True)
    teams = raw.select(F.explode("teams").alias("t")).select("t.*")
    claims = teams.select("team", F.explode("claims").alias("c"))
    return {
        "sources": raw.select(F.explode("sources").alias("s")).select("s.id", "s.url", F.to_date("s.published").alias("published")),
        "teams": teams.select("team", "scheme_family", "scheme_continuity", "returning_starters_fraction"),
        "staff": teams.select("team", F.explode("staff").alias("s")).select("team", "s.*"),
        "anchors": teams.select("team", F.explode("anchors").alias("a")).select("team", F.col("a.team").alias("anchor_team"), "a.season", "a.weight", "a.reason"),
        "claims": claims.select("team", "c.id", "c.source_id", "c.confidence", "c.certainty_effect", "c.dimensions"),
        "claim_signals": claims.select("team", F.col("c.id").alias("claim_id"), F.explode("c.metric_signals").alias("metric", "signal")),
        "records": raw.select(F.explode("records").alias("r")).select("r.id", "r.season", "r.team", "r.player_id", F.explode("r.metrics").alias("metric"), "r.finding", "r.source_ids"),
    }


def read_news(spark: SparkSession, path: str, per_feed: int) -> DataFrame:
    """Items of RSS files with all fields, the first of each guid and the first ``per_feed`` of each file, in document order.

    A feed is read up to each end of an item, so a large one is read by as many tasks as it has blocks; an
    item's place is its block's start and its number in the block. An item that is no XML is an error.
    """
    raw = spark.read.option("lineSep", "</item>").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    found = raw.select(F.col("_metadata.file_path").alias("feed"), place.alias("place"), F.regexp_extract("value", r"(?s)<item(?:\s[^>]*)?>.*$", 0).alias("item")).filter("item <> ''")
    schema = "title string, link string, guid string, pubDate string, source string"
    parsed = found.select("feed", "place", F.from_xml(F.concat("item", F.lit("</item>")), schema, {"mode": "FAILFAST", "rowTag": "item"}).alias("i"))
    items = parsed.select("feed", "place", *[F.trim(F.col(f"i.{c}")).alias(c) for c in ("title", "link", "guid", "pubDate", "source")])
    items = items.withColumn("guid", F.coalesce(F.when(F.col("guid") != "", F.col("guid")), F.col("link")))
    full = items.filter(F.least(*[F.length(F.coalesce(c, F.lit(""))) for c in ("title", "link", "guid", "pubDate", "source")]) > 0)
    one = keep_best(full, ["feed", "guid"], [F.col("place")])
    kept = F.row_number().over(Window.partitionBy("feed").orderBy("place"))
    return one.withColumn("_place", kept).filter(F.col("_place") <= per_feed).drop("_place", "place")
