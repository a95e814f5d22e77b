"""Joins. Sides are broadcast only where a parameter or a count says how small they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opportunity.quality import QualityError, assert_rule, assert_unique


#: Stands for what no player of a room got.
UNALLOCATED = "__UNALLOCATED__"
#: Window ends of a job.
MOST_WINDOWS = 64
#: Joined on in place of a blank id, so that rows without one are spread.
BLANK_KEYS = 1024


def with_positions(plays: DataFrame, roster: DataFrame, player: str, name: str) -> DataFrame:
    """Adds the position of ``player`` from ``roster`` (player_id, position); UNKNOWN if it has none, null for no player.

    Blank ids never match: they are joined on a key of their own, one of ``BLANK_KEYS`` by a hash of
    the row, so they do not pile up in one task. The plays are read once.
    """
    blank = F.concat(F.lit("~"), F.pmod(F.xxhash64(*plays.columns), F.lit(BLANK_KEYS)))
    known = roster.select(F.concat(F.lit("="), F.col("player_id")).alias("_key"), F.col("position").alias(name))
    joined = plays.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(player)), blank)).join(known, "_key", "left").drop("_key")
    return joined.withColumn(name, F.when(F.col(player).isNotNull(), F.coalesce(name, F.lit("UNKNOWN"))))


def with_charting(plays: DataFrame, charting: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of charting flags; ``charted`` tells whether a play had a row."""
    return plays.join(charting.withColumn("charted", F.lit(True)), list(keys), "left").withColumn("charted", F.coalesce("charted", F.lit(False)))


def checked_charting(plays: DataFrame, charting: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J2 with its errors: a charting key that is doubled on a matched play, and no match at all."""
    matched = charting.select(*keys).join(plays.select(*keys).distinct(), list(keys), "left_semi")
    assert_unique(matched, keys)
    if matched.isEmpty():
        raise QualityError("no play has a charting row")
    return with_charting(plays, charting, keys)


def reconcile_roster(roster: DataFrame, catalog: DataFrame, affiliated: Sequence[str]) -> DataFrame:
    """Catalog status wins; catalog team wins only with an affiliated status; ``review`` names conflicts."""
    own = catalog.select("player_id", F.col("team").alias("catalog_team"), F.col("status").alias("catalog_status"))
    joined = roster.join(own, "player_id", "left")
    status = F.coalesce("catalog_status", "status")
    trusted = F.col("catalog_status").isin(*affiliated)
    review = F.when(F.col("catalog_status").isNull(), "no_catalog").when(trusted & (F.col("catalog_team") != F.col("team")), "affiliation").when(F.col("catalog_status") != F.col("status"), "status")
    return joined.select("player_id", F.when(trusted, F.coalesce("catalog_team", "team")).otherwise(F.col("team")).alias("team"), status.alias("status"), review.alias("review"))


def roster_id_conflicts(roster: DataFrame, catalog: DataFrame) -> DataFrame:
    """Players whose second id differs between roster and catalog (player_id, other_id)."""
    own = catalog.select("player_id", F.col("other_id").alias("catalog_other"))
    found = roster.select("player_id", "other_id").join(own, "player_id").filter(F.col("other_id") != F.col("catalog_other"))
    return found.select("player_id", "other_id", "catalog_other", F.lit("id_conflict").alias("review"))


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_high")).filter(F.col(value) == F.col("_high")).drop("_high")


def resolve_identity(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows`` (player_id, other_id) resolved by id, else by a unique other id; else a reason.

    Where both sides have a team, a resolved player of another team is a ``team_mismatch``.
    """
    teams = "team" in rows.columns and "team" in catalog.columns
    by_id = catalog.select(F.col("player_id").alias("_id"), F.lit(True).alias("_known"))
    by_other = catalog.filter(F.col("other_id").isNotNull()).groupBy("other_id").agg(F.min("player_id").alias("_low"), F.max("player_id").alias("_high"))
    joined = rows.join(by_id, F.col("player_id") == F.col("_id"), "left").join(by_other, "other_id", "left")
    unique = F.col("_low") == F.col("_high")
    found = F.when(F.col("_known"), F.col("player_id")).when(F.col("player_id").isNull() & unique, F.col("_low"))
    reason = (
        F.when(F.col("_known") & unique & (F.col("_low") != F.col("player_id")), "conflict")
        .when(F.col("_known"), F.lit(None))
        .when(F.col("player_id").isNotNull(), "unknown_id")
        .when(F.col("_low").isNull(), "unmatched")
        .when(~unique, "ambiguous")
    )
    out = joined.select(*rows.columns, found.alias("resolved_id"), reason.alias("reason"))
    if not teams:
        return out
    own = catalog.select(F.col("player_id").alias("resolved_id"), F.col("team").alias("_team"))
    other = F.col("_team") != F.col("team")
    return out.join(own, "resolved_id", "left").select(*rows.columns, "resolved_id", F.when(F.col("reason").isNull() & other, "team_mismatch").otherwise(F.col("reason")).alias("reason"))


def snaps_to_players(snaps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Snaps by a second id that names exactly one player; the others keep a null player_id."""
    return snaps.join(unique_by(catalog, "other_id", "player_id"), "other_id", "left")


def snap_reviews(snaps: DataFrame, catalog: DataFrame, keys: Sequence[str] = ("season", "team", "other_id", "name")) -> DataFrame:
    """One row for each season, team, id and name of snaps whose second id names no one or several."""
    known = catalog.filter(F.col("other_id").isNotNull()).groupBy("other_id").agg(F.countDistinct("player_id").alias("_n"))
    joined = snaps.select(*keys).distinct().join(known, "other_id", "left").filter("_n is null or _n <> 1")
    return joined.select(*keys, F.when(F.col("_n").isNull(), "unmatched").otherwise("ambiguous").alias("reason"))


def market_crosswalk(market: DataFrame, roster: DataFrame) -> DataFrame:
    """``market`` (source_id, name_key, team, position) to ``roster`` (player_id, name_key, team, position).

    ``roster`` may have name_keys, an array of aliases, in place of name_key. Positions that the
    roster's scope lacks (kickers and team defences) are ``out_of_scope``. One candidate by name, team and position is resolved; by name and position only it goes to
    review; several source rows on one player are all demoted to review.
    """
    if "name_keys" in roster.columns:
        roster = roster.select("player_id", "team", "position", F.explode(F.array_distinct("name_keys")).alias("name_key"))
    exact = roster.groupBy("name_key", "team", "position").agg(F.min("player_id").alias("exact_id"), F.countDistinct("player_id").alias("exact_n"))
    loose = roster.groupBy("name_key", "position").agg(F.countDistinct("player_id").alias("loose_n"))
    joined = market.join(exact, ["name_key", "team", "position"], "left").join(loose, ["name_key", "position"], "left")
    found = F.when(F.col("exact_n") == 1, F.col("exact_id"))
    joined = joined.withColumn("player_id", found)
    # Rows without a candidate are counted apart: a window over null ids would be one group.
    taken = joined.filter("player_id is not null").groupBy("player_id").agg(F.count("*").alias("claims"))
    joined = joined.join(taken, "player_id", "left")
    status = F.when(F.col("position").cast("string").isin("K", "DST"), "out_of_scope").when(F.col("claims") > 1, "review").when(F.col("claims") == 1, "resolved").when(F.coalesce("loose_n", "exact_n").isNotNull(), "review").otherwise("unmatched")
    return joined.select("source_id", F.when(status == "resolved", F.col("player_id")).alias("player_id"), status.alias("status"))


def match_feed(players: DataFrame, feed: DataFrame) -> DataFrame:
    """Alerts by id, else by name, team and position where those name one feed row."""
    by_id = feed.filter("player_id is not null").groupBy("player_id").agg(F.min("alert").alias("by_id"))
    by_name = feed.groupBy("name_key", "team", "position").agg(F.min("alert").alias("by_name"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    joined = players.join(by_id, "player_id", "left").join(by_name, ["name_key", "team", "position"], "left")
    return joined.withColumn("alert", F.coalesce("by_id", "by_name")).filter("alert is not null").select("player_id", "alert")


def asof_latest(df: DataFrame, by: str | Sequence[str], ts: str, before: Column | None = None) -> DataFrame:
    """All rows at the last ``ts`` of each ``by`` (strictly before a bound, where one is given).

    The last time is a small aggregate that is joined back; no window sorts the history.
    """
    keys = [by] if isinstance(by, str) else list(by)
    rows = df if before is None else df.filter(F.col(ts) < before)
    last = rows.groupBy(*keys).agg(F.max(ts).alias(ts))
    return rows.join(last, [*keys, ts], "left_semi")


def prior_history(targets: DataFrame, history: DataFrame, lookback: int, decay: float = 0.65, moved: float = 0.70) -> DataFrame:
    """History of the ``lookback`` seasons before each target, with a weight.

    ``targets`` has player_id, target_season and team; ``history`` player_id, season, team and
    measures. Seasons are strictly before the target's.
    """
    own = targets.select("player_id", "target_season", F.col("team").alias("target_team"))
    joined = history.join(own, "player_id").filter((F.col("season") < F.col("target_season")) & (F.col("season") >= F.col("target_season") - lookback))
    weight = F.pow(F.lit(decay), F.col("target_season") - 1 - F.col("season")) * F.when(F.col("team") == F.col("target_team"), 1.0).otherwise(moved)
    return joined.withColumn("weight", weight)


def scheduled_only(df: DataFrame, schedule: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have a game."""
    return df.join(schedule.select(*keys).distinct(), list(keys), "left_semi")


def bye_weeks(teams: DataFrame, schedule: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have none."""
    return teams.join(schedule.select(*keys).distinct(), list(keys), "left_anti")


def staff_changes(prior: DataFrame, current: DataFrame) -> DataFrame:
    """``current`` staff (team, person, title, duty) against the prior year's."""
    old = prior.groupBy("team", "person").agg(F.collect_set("title").alias("titles"), F.collect_set("duty").alias("duties"))
    joined = current.join(old, ["team", "person"], "left")
    status = (
        F.when(F.col("titles").isNull(), "new")
        .when(F.array_contains("titles", F.col("title")), "same_title")
        .when(F.array_contains("duties", F.col("duty")), "same_responsibility")
        .otherwise("changed_responsibility")
    )
    return joined.select(*current.columns, status.alias("status"))


def caller_cohort(prior: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` callers (team, caller) against the callers of the year before."""
    same = prior.select("team", F.col("caller").alias("prior_caller"))
    elsewhere = prior.filter("caller is not null").groupBy("caller").agg(F.countDistinct("team").alias("teams"), F.min("team").alias("anchor_team"))
    joined = target.join(same, "team", "left").join(elsewhere, "caller", "left")
    cohort = (
        F.when(F.col("caller").isNull(), "ambiguous")
        .when(F.col("caller") == F.col("prior_caller"), "returning")
        .when(F.col("teams") == 1, "changed_with_anchor")
        .when(F.col("teams") > 1, "ambiguous")
        .otherwise("changed_without_anchor")
    )
    return joined.select("team", "caller", cohort.alias("cohort"), F.when(cohort == "changed_with_anchor", F.col("anchor_team")).alias("anchor_team"))


def exclude_changes(teams: DataFrame, changes: DataFrame, windows: DataFrame) -> DataFrame:
    """Each team with each window end; excluded where a replacement began in the window.

    ``windows`` holds the few window ends of a job; more than ``MOST_WINDOWS`` are an error.
    """
    first = changes.groupBy("team").agg(F.min("first_week").alias("first_week"))
    ends = sorted(r.window_end for r in windows.select("window_end").distinct().limit(MOST_WINDOWS + 1).collect())
    if len(ends) > MOST_WINDOWS:
        raise QualityError("too many window ends")
    kind = windows.schema["window_end"].dataType
    joined = teams.join(first, "team", "left").withColumn("window_end", F.explode(F.array(*[F.lit(w).cast(kind) for w in ends]) if ends else F.array().cast(f"array<{kind.simpleString()}>")))
    return joined.withColumn("excluded", F.coalesce(F.col("first_week") <= F.col("window_end"), F.lit(False)))


def attach_evidence(queue: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviewed records on queue rows; rows without one are ``unreviewed``."""
    return queue.join(records, list(keys), "left").withColumn("finding", F.coalesce("finding", F.lit("unreviewed")))


def checked_evidence(queue: DataFrame, records: DataFrame, keys: Sequence[str], identity: Sequence[str] = ()) -> DataFrame:
    """J14 with its errors: a record without a queue row, two records for one, and another ``identity`` (such as a name)."""
    assert_unique(records, keys)
    if lost := records.join(queue, list(keys), "left_anti").select(*keys).limit(1).collect():
        raise QualityError(f"record without a queue row: {lost[0].asDict()}")
    own = records.select(*keys, *[F.col(c).alias(f"_{c}") for c in identity])
    for column in identity:
        assert_rule(queue.join(own, list(keys)), F.col(column).eqNullSafe(F.col(f"_{column}")), f"record and queue differ in {column}")
    return attach_evidence(queue, records.drop(*identity), keys)


def attach_reviews(weekly: DataFrame, season: DataFrame, reviews: DataFrame) -> DataFrame:
    """Season-level reviews on weekly rows; ``agrees`` tells whether required and present match."""
    joined = weekly.join(season, "player_id", "left").join(reviews, "player_id", "left")
    return joined.withColumn("agrees", F.coalesce("required", F.lit(False)) == F.col("review").isNotNull())


def checked_reviews(weekly: DataFrame, season: DataFrame, reviews: DataFrame) -> DataFrame:
    """J15 with its error: a review that is required and missing, or present and not required."""
    joined = attach_reviews(weekly, season, reviews)
    assert_rule(joined, F.col("agrees"), "reviews required and present do not match")
    return joined.drop("agrees")


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer on a room's players; a missing side is 0. What no player got is ``unallocated``."""
    left, right = forecast.withColumn("_f", F.lit(True)), actual.withColumn("_a", F.lit(True))
    joined = left.join(right, list(keys), "full_outer")
    kind = F.when(F.col("player_id").cast("string") == UNALLOCATED, "unallocated").when(F.col("_f"), "opening").otherwise("later_entrant")
    return joined.select(*keys, F.coalesce("forecast", F.lit(0.0)).alias("forecast"), F.coalesce("actual", F.lit(0.0)).alias("actual"), kind.alias("row_type"))


def caller_episodes(census: DataFrame, current: DataFrame, exclusions: DataFrame, additions: DataFrame) -> DataFrame:
    """Past episodes (caller_key, team, season) of current callers; excluded ones weigh 0; added ones join them."""
    found = census.join(current.select("caller_key").distinct(), "caller_key", "left_semi")
    keys = ["caller_key", "team", "season"]
    found = found.select(*keys).join(exclusions.select(*keys).withColumn("_out", F.lit(True)), keys, "left")
    found = found.select(*keys, F.when(F.col("_out"), 0.0).otherwise(1.0).alias("weight"))
    return found.unionByName(additions.select(*keys).withColumn("weight", F.lit(1.0)))


def checked_episodes(census: DataFrame, current: DataFrame, exclusions: DataFrame, additions: DataFrame, style: DataFrame) -> DataFrame:
    """J17 with its errors: an exclusion of no episode, an addition that is one already, an anchor without a style row.

    ``style`` has team and season; anchors are the episodes that weigh more than 0.
    """
    keys = ["caller_key", "team", "season"]
    own = census.join(current.select("caller_key").distinct(), "caller_key", "left_semi").select(*keys)
    assert_unique(additions, keys)
    for rows, message in ((exclusions.select(*keys).join(own, keys, "left_anti"), "exclusion of no episode"), (additions.select(*keys).join(own, keys, "left_semi"), "addition of a known episode")):
        if found := rows.limit(1).collect():
            raise QualityError(f"{message}: {found[0].asDict()}")
    episodes = caller_episodes(census, current, exclusions, additions)
    if lost := episodes.filter("weight > 0").join(style, ["team", "season"], "left_anti").limit(1).collect():
        raise QualityError(f"anchor without a style row: {lost[0].asDict()}")
    return episodes


def evidence_dates(teams: DataFrame, sources: DataFrame) -> DataFrame:
    """``teams`` (team, source_ids) with the first source's id and the latest date."""
    # Spark takes exploded rows to be as few as those of ``teams`` and would broadcast them all.
    rows = teams.select("team", F.posexplode("source_ids").alias("place", "source_id")).join(sources.hint("merge"), "source_id")
    return rows.groupBy("team").agg(F.min_by("source_id", "place").alias("primary_source"), F.max("published").alias("latest"))
