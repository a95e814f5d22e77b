"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opportunity.functions.clean import event_flags, play_flags, safe_ratio
from opportunity.functions.stored import stored
from opportunity.operators.ranges import percentiles_by_rank
from opportunity.quality import QualityError, assert_range

#: Numeric columns of plays that ``team_style`` reads, beside its keys.
PLAY_COLUMNS = ("down", "qtr", "pass", "rush", "qb_kneel", "qb_spike", "qb_scramble", "wp", "yardline_100", "air_yards", "yards_gained", "pass_oe", "shotgun", "no_huddle", "success", "epa")
#: Charting rates: name, column, and the value that counts.
CHARTING_RATES = {
    "motion_rate": "is_motion",
    "play_action_rate": "is_play_action",
    "screen_pass_rate": "is_screen_pass",
    "rpo_rate": "is_rpo",
    "qb_out_of_pocket_rate": "is_qb_out_of_pocket",
    "qb_sneak_rate": "is_qb_sneak",
}


# Counts of targets by read code.
READ_CODES = {
    "first_read_targets": "0",
    "second_read_targets": "1",
    "third_later_read_targets": "2",
    "designed_targets": "DES",
    "checkdown_targets": "CHK",
    "scramble_drill_targets": "SD",
}
# Plausible ratios of resource pools.
CONVERSION_BOUNDS = {
    "qb_dropbacks_per_pass_play": (0.70, 1.05),
    "target_per_pass_play": (0.55, 1.00),
    "rb_carries_per_non_qb_rush_play": (0.50, 1.10),
}


def share_of(flag: Column, known: Column) -> Column:
    """Share of rows with ``flag`` among the rows where ``known`` holds; null if there are none."""
    return safe_ratio(F.sum(F.when(known & flag, 1).when(known, 0)).cast("double"), F.sum(F.when(known, 1)))


def team_style(plays: DataFrame, weeks: tuple[int, int] | None = None, charted: bool = False) -> DataFrame:
    """A1: style rates per season and team.

    ``plays`` has season, week, team, game_id, PLAY_COLUMNS, receiver_position and
    rusher_position (null for no player), and with ``charted`` also the charting columns and, for
    multi_back_rate, the number of backs in the backfield where charted. Each
    rate has its own denominator: the rows where its input is known. Games are counted by
    grouping to games first, so that all sums stay partial aggregates.
    """
    if weeks is not None:
        plays = plays.filter(F.col("week").between(*weeks))
    c = {name: F.col(name) for name in PLAY_COLUMNS}
    flags = play_flags(c)
    rows = plays.select("*", *[flag.alias(f"_{name}") for name, flag in flags.items()]).filter("_eligible")
    is_pass, is_rush = F.col("pass") == 1, F.col("rush") == 1
    scramble = F.coalesce(F.col("qb_scramble") == 1, F.lit(False))
    target = is_pass & F.col("receiver_position").isNotNull()
    yes = F.lit(True)
    sums: dict[str, tuple[Column, Column]] = {
        "pass_rate": (is_pass, yes),
        "neutral_early_down_pass_rate": (is_pass, F.col("_neutral")),
        "shotgun_rate": (F.col("shotgun") == 1, F.col("shotgun").isNotNull()),
        "no_huddle_rate": (F.col("no_huddle") == 1, F.col("no_huddle").isNotNull()),
        "red_zone_pass_rate": (is_pass, F.col("_red_zone")),
        "deep_attempt_rate": (F.col("_deep"), is_pass & F.col("air_yards").isNotNull()),
        "qb_scramble_rate": (scramble, is_pass),
        "designed_qb_run_share": (F.coalesce(F.col("rusher_position") == "QB", F.lit(False)) & ~scramble, is_rush),
        "explosive_play_rate": (F.col("_explosive"), yes),
        "success_rate": (F.col("success") == 1, F.col("success").isNotNull()),
    }
    for position in ("RB", "WR", "TE", "OTHER", "UNKNOWN"):
        sums[f"{position.lower()}_target_share"] = (F.col("receiver_position") == position, target)
    if charted:
        for name, column in CHARTING_RATES.items():
            sums[name] = (F.col(column), F.col("charted") & F.col(column).isNotNull())
        sums["under_center_rate"] = (F.col("qb_location") == "U", F.col("charted") & F.col("qb_location").isin("U", "S", "P"))
        sums["pistol_rate"] = (F.col("qb_location") == "P", F.col("charted") & F.col("qb_location").isin("U", "S", "P"))
        sums["charting_coverage_rate"] = (F.col("charted"), yes)
        if "backfield" in plays.columns:
            sums["multi_back_rate"] = (F.col("backfield") >= 2, F.col("charted") & F.col("backfield").isNotNull())
    means = {"neutral_pass_oe": F.when(F.col("_neutral"), F.col("pass_oe")), "mean_air_yards": F.when(is_pass, F.col("air_yards")), "epa_per_play": F.col("epa")}
    parts = [F.count("*").alias("plays")]
    for name, (flag, known) in sums.items():
        parts += [F.sum(F.when(known & flag, 1).otherwise(0)).alias(f"{name}_n"), F.sum(F.when(known, 1).otherwise(0)).alias(f"{name}_d")]
    for name, value in means.items():
        parts += [F.sum(value).alias(f"{name}_n"), F.count(value).alias(f"{name}_d")]
    games = rows.groupBy("season", "team", "game_id").agg(*parts)
    names = [*sums, *means]
    totals = games.groupBy("season", "team").agg(
        F.count("game_id").alias("games"), F.sum("plays").alias("plays"), *[F.sum(f"{n}_{x}").alias(f"{n}_{x}") for n in names for x in "nd"]
    )
    rates = [safe_ratio(F.col(f"{n}_n").cast("double"), F.col(f"{n}_d")).alias(n) for n in names]
    return totals.select("season", "team", "games", "plays", (F.col("plays") / F.col("games")).alias("plays_per_game"), *rates)


def mode_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A2: the most frequent value of each key, the smallest of equal ones; and how many values it had."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value)))[value].alias(value), F.count("*").alias("values"))


def player_week_events(plays: DataFrame, read_from: int, first_read_from: int) -> DataFrame:
    """A3: event counts per player and week, from targets and carries.

    ``plays`` has season, week, team, receiver_id, rusher_id, position of each, the columns of
    ``event_flags`` and read_code; it may have charted (whether a play has a charting row; else a
    read code tells) and receiver_name and rusher_name, of which the most frequent is kept. Read
    counts are null in seasons without charting, first reads in seasons before they were charted:
    missing is not zero.
    """
    charted = F.col("charted") if "charted" in plays.columns else F.col("read_code").isNotNull()
    named = [F.col(f"{x}_name") if f"{x}_name" in plays.columns else F.lit(None).cast("string") for x in ("receiver", "rusher")]
    keys = ["season", "week", "team", "player_id", "position"]
    columns = ("yardline_100", "air_yards", "down", "ydstogo", "qtr", "half_seconds_remaining", "qb_scramble", "goal_to_go")
    shared = [F.col(x) for x in ("season", "week", "team", *columns)]
    targets = plays.filter("pass = 1 and receiver_id is not null").select(*shared, F.col("receiver_id").alias("player_id"), F.col("receiver_position").alias("position"), "read_code", charted.alias("charted"), named[0].alias("player_name"), F.lit("target").alias("kind"))
    carries = plays.filter("rush = 1 and rusher_id is not null").select(*shared, F.col("rusher_id").alias("player_id"), F.col("rusher_position").alias("position"), F.lit(None).cast("string").alias("read_code"), F.lit(False).alias("charted"), named[1].alias("player_name"), F.lit("carry").alias("kind"))
    rows = targets.unionByName(carries)
    flags = event_flags({name: F.col(name) for name in (*columns, "position")})
    is_target = F.col("kind") == "target"
    counts = [F.sum(F.when(is_target, 1).otherwise(0)).alias("targets"), F.sum(F.when(~is_target, 1).otherwise(0)).alias("carries")]
    for name, flag in flags.items():
        own = is_target if "target" in name else ~is_target
        counts.append(F.sum(F.when(own & flag, 1).otherwise(0)).alias(name))
    air = F.round(F.sum(F.when(is_target, F.coalesce("air_yards", F.lit(0.0))).otherwise(0.0)), 3).alias("target_air_yards")
    codes = {name: F.col("read_code") == code for name, code in READ_CODES.items()}
    reads = {"charted_targets": F.col("charted"), "read_labeled_targets": F.col("read_code").isNotNull(), **codes}
    read_counts = [F.sum(F.when(is_target & F.coalesce(flag, F.lit(False)), 1).otherwise(0)).alias(name) for name, flag in reads.items()]
    out = rows.groupBy(*keys).agg(*counts, air, *read_counts)
    for name in reads:
        start = first_read_from if name == "first_read_targets" else read_from
        out = out.withColumn(name, F.when(F.col("season") >= start, F.col(name)))
    if "receiver_name" not in plays.columns:
        return out
    names = mode_with_ties(rows, keys, "player_name").select(*[F.col(k).alias(f"_{k}") for k in keys], "player_name")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return out.join(names, same, "left").drop(*[f"_{k}" for k in keys])


def team_week_events(events: DataFrame, counts: Sequence[str]) -> DataFrame:
    """A4: roll-up to season, week, team and position; sums of nulls only stay null."""
    return events.groupBy("season", "week", "team", "position").agg(F.count("*").alias("player_count"), *[F.sum(c).alias(c) for c in counts])


def event_coverage(events: DataFrame) -> DataFrame:
    """A5: coverage of event rows per season: mapped players, charting rows, labels and codes of no known kind."""
    known = F.lit(0)
    for name in READ_CODES:
        known = known + F.coalesce(F.col(name), F.lit(0))
    mapped = F.sum(F.when(F.col("position") != "UNKNOWN", F.col("targets")).otherwise(0))
    return events.groupBy("season").agg(
        F.countDistinct("team").alias("teams"),
        F.countDistinct("week").alias("weeks"),
        F.sum("targets").alias("targets"),
        safe_ratio(mapped.cast("double"), F.sum("targets")).alias("mapped_rate"),
        safe_ratio(F.sum("charted_targets").cast("double"), F.sum("targets")).alias("charted_rate"),
        safe_ratio(F.sum("read_labeled_targets").cast("double"), F.sum("targets")).alias("label_rate"),
        F.sum(F.col("read_labeled_targets") - known).alias("unknown_codes"),
    )


def source_review(exceptions: DataFrame, coverage: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ("season", "issue")) -> DataFrame:
    """Exception counts by ``by`` (season, issue and, where asked, week, team, player and detail), and one row for
    each coverage rule that a season breaks."""
    found = exceptions.groupBy(*by).agg(F.count("*").alias("rows"))
    for name, broken in rules.items():
        row = coverage.filter(broken).select("season", F.lit(name).alias("issue"), F.lit(1).cast("long").alias("rows"))
        found = found.unionByName(row, allowMissingColumns=True)
    return found


def season_usage(weekly: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """Season totals per player, team and team-position totals, and shares.

    ``weekly`` has season, week, team, player_id, position, game_id, carries and targets, may have
    dropbacks, and has snaps, unless ``snaps`` (season, team, player_id, game_id, snaps) is a table of
    its own; players without a row there have no snaps. Team snaps are the sum over games of the
    most snaps any player had.
    """
    counts = [c for c in ("carries", "targets", "dropbacks") if c in weekly.columns]
    own = [F.sum("snaps").alias("snaps")] if snaps is None else []
    player = weekly.groupBy("season", "team", "player_id", "position").agg(F.countDistinct("game_id").alias("games"), *[F.sum(c).alias(c) for c in counts], *own)
    if snaps is not None:
        totals = snaps.groupBy("season", "team", "player_id").agg(F.sum("snaps").alias("snaps"))
        player = player.join(totals, ["season", "team", "player_id"], "left")
    game = (weekly if snaps is None else snaps).groupBy("season", "team", "game_id").agg(F.max("snaps").alias("game_snaps"))
    team = game.groupBy("season", "team").agg(F.sum("game_snaps").alias("team_snaps"))
    room = player.groupBy("season", "team", "position").agg(*[F.sum(c).alias(f"room_{c}") for c in counts])
    joined = player.join(team, ["season", "team"], "left").join(room, ["season", "team", "position"])
    shares = {"carry_share": "carries", "target_share": "targets", "dropback_share": "dropbacks"}
    joined = joined.withColumns({name: safe_ratio(F.col(c), F.col(f"room_{c}")) for name, c in shares.items() if c in counts})
    return joined.withColumn("snap_share", safe_ratio(F.col("snaps"), F.col("team_snaps")))


def historical_share(weighted: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Weighted share, games and seasons of what ``prior_history`` returns, the teams of the latest season and whether
    the target's team is among them."""
    latest = F.max(F.struct("season", "team"))
    seasons = weighted.groupBy("player_id", "target_season", "target_team", "season").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    last = seasons.groupBy("player_id", "target_season", "target_team").agg(F.max(F.struct("season", "teams"))["teams"].alias("latest_teams"))
    out = weighted.groupBy("player_id", "target_season", "target_team").agg(
        safe_ratio(F.sum(F.col("weight") * F.col(numerator)), F.sum(F.col("weight") * F.col(denominator))).alias("share"),
        F.sum(F.col("weight") * F.col("games")).alias("weighted_games"),
        F.countDistinct("season").alias("season_count"),
        latest["team"].alias("latest_team"),
    )
    out = out.withColumn("share", F.coalesce("share", F.lit(0.0))).join(last, ["player_id", "target_season", "target_team"])
    return out.withColumn("same_team", F.array_contains("latest_teams", F.col("target_team")))


def conversion_factors(usage: DataFrame, style: DataFrame, latest: int, pairs: Mapping[str, tuple[str, str]], decay: float = 0.65, bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Ratios of recency-weighted totals over season and team; one row.

    With ``bounds`` a usage row without a style row, and a ratio outside its bounds, are errors.
    """
    if bounds is not None and (lost := usage.join(style, ["season", "team"], "left_anti").select("season", "team").limit(1).collect()):
        raise QualityError(f"usage without style: {lost[0].asDict()}")
    joined = usage.join(style, ["season", "team"]).withColumn("_w", F.pow(F.lit(decay), F.lit(latest) - F.col("season")))
    found = joined.agg(*[safe_ratio(F.sum(F.col("_w") * F.col(x)), F.sum(F.col("_w") * F.col(y))).alias(name) for name, (x, y) in pairs.items()])
    if bounds is not None:
        found = stored(found, "factors")
        assert_range(found, {name: F.col(name).between(*bounds[name]) for name in pairs if name in bounds})
    return found


def status_cohort_counts(rows: DataFrame) -> DataFrame:
    """A10: trials and successes by family and by active flag, each by position and for all, per season and week.

    ``rows`` has season, week, family, position and active (0 or 1 outcome).
    """
    flag = F.when(F.col("family") == "active_53", "active_53").otherwise("nonactive")
    families = F.array_distinct(F.array(F.col("family"), flag))
    spread = rows.select("season", "week", "active", F.explode(families).alias("family"), "position").select("season", "week", "active", "family", F.explode(F.array(F.col("position"), F.lit("ALL"))).alias("position"))
    return spread.groupBy("season", "week", "family", "position").agg(F.count("*").alias("trials"), F.sum("active").cast("long").alias("successes"))


def leave_one_out(counts: DataFrame, keys: Sequence[str], by: str, values: Sequence[str]) -> DataFrame:
    """The sum over all other ``by`` of the same keys."""
    totals = counts.groupBy(*keys).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    joined = counts.join(totals, list(keys))
    return joined.select(*keys, by, *[(F.col(f"_{v}") - F.col(v)).alias(v) for v in values])


def cohort_fallback(rows: DataFrame, counts: DataFrame, levels: Sequence[tuple[str, Column, Column]], min_n: int = 30) -> DataFrame:
    """The first level with ``min_n`` trials, else the last one, labelled weak.

    ``levels`` has a name and the family and position that the level looks up, for each row's week.
    """
    out = rows
    for k, (_, family, position) in enumerate(levels):
        side = counts.select(F.col("week"), F.col("family").alias(f"_f{k}"), F.col("position").alias(f"_p{k}"), F.col("trials").alias(f"_n{k}"), F.col("successes").alias(f"_s{k}"))
        out = out.withColumn(f"_f{k}", family).withColumn(f"_p{k}", position).join(side, ["week", f"_f{k}", f"_p{k}"], "left")
    last = len(levels) - 1
    enough = [F.coalesce(F.col(f"_n{k}") >= min_n, F.lit(False)) for k in range(len(levels))]
    trials, successes, level = F.col(f"_n{last}"), F.col(f"_s{last}"), F.when(enough[last], levels[last][0]).otherwise(f"weak_{levels[last][0]}")
    for k in range(last - 1, -1, -1):
        trials = F.when(enough[k], F.col(f"_n{k}")).otherwise(trials)
        successes = F.when(enough[k], F.col(f"_s{k}")).otherwise(successes)
        level = F.when(enough[k], F.lit(levels[k][0])).otherwise(level)
    return out.select(*rows.columns, trials.alias("trials"), successes.alias("successes"), level.alias("level"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weight; rows without a value do not count."""
    known = value.isNotNull()
    return safe_ratio(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def weighted_std(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation per key, by moments."""
    v, w = F.col(value), F.col(weight)
    out = df.filter(v.isNotNull()).groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_x"), F.sum(w * v * v).alias("_xx"))
    mean = safe_ratio(F.col("_x"), F.col("_w"))
    spread = F.sqrt(F.greatest(F.lit(0.0), safe_ratio(F.col("_xx"), F.col("_w")) - mean * mean))
    return out.select(*keys, mean.alias("mean"), spread.alias("std"))


def mad_stability(df: DataFrame, keys: Sequence[str], value: str, weight: str, tolerance: float) -> DataFrame:
    """1 / (1 + weighted mean absolute deviation / tolerance); 0.45 for one known value, 0.20 for none."""
    means = df.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(weight)).alias("_mean"), F.count(value).alias("_n"))
    joined = df.join(means, list(keys))
    out = joined.groupBy(*keys).agg(weighted_mean(F.abs(F.col(value) - F.col("_mean")), F.col(weight)).alias("_mad"), F.first("_n").alias("_n"))
    return out.select(*keys, F.when(F.col("_n") == 0, 0.20).when(F.col("_n") == 1, 0.45).otherwise(1 / (1 + F.col("_mad") / tolerance)).alias("stability"))


def unpivoted(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def league_median(style: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("season",)) -> DataFrame:
    """Exact median of each metric over teams, nulls ignored."""
    rows = unpivoted(style, [*keys, "team"], metrics)
    return rows.groupBy(*keys, "metric").agg(F.median("value").alias("median"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Percentiles with linear interpolation, from counts of the values."""
    return percentiles_by_rank(df, keys, value, points)


# Fixed values.
CORE_RESPONSIBILITIES = ("head_coach", "offensive_coordinator", "quarterbacks", "running_backs", "wide_receivers", "tight_ends", "offensive_line")


def staff_continuity(changes: DataFrame) -> DataFrame:
    """Counts by status and an index of 100 * (0.5 returning + 0.5 kept) share."""
    kept = F.sum(F.when(F.col("status").isin("same_title", "same_responsibility"), 1).otherwise(0))
    returning = F.sum(F.when(F.col("status") != "new", 1).otherwise(0))
    out = changes.groupBy("team").agg(F.count("*").alias("staff"), returning.alias("returning"), kept.alias("kept"))
    return out.withColumn("index", 100 * (0.5 * F.col("returning") + 0.5 * F.col("kept")) / F.col("staff"))


def core_continuity(prior: DataFrame, current: DataFrame, responsibilities: Sequence[str] = CORE_RESPONSIBILITIES) -> DataFrame:
    """Retained, changed and comparable core responsibilities per team, and the share of retained ones.

    Both sides have team, person and duty. A duty is comparable if both years have a holder, and
    retained if one of them is the same.
    """
    sides = prior.withColumn("_now", F.lit(0)).unionByName(current.withColumn("_now", F.lit(1))).filter(F.col("duty").isin(*responsibilities))
    held = sides.groupBy("team", "duty", "person").agg(F.max(1 - F.col("_now")).alias("_then"), F.max("_now").alias("_now"))
    duty = held.groupBy("team", "duty").agg(F.max("_then").alias("_then"), F.max("_now").alias("_now"), F.max(F.col("_then") * F.col("_now")).alias("_both"))
    flags = {"comparable": F.col("_then") * F.col("_now"), "retained": F.col("_both")}
    out = duty.groupBy("team").agg(*[F.sum(v).cast("long").alias(n) for n, v in flags.items()])
    out = current.select("team").distinct().join(out, "team", "left").fillna(0, ["comparable", "retained"])
    out = out.withColumn("changed", F.col("comparable") - F.col("retained")).withColumn("unavailable", F.lit(len(responsibilities)) - F.col("comparable"))
    return out.withColumn("core_share", F.coalesce(safe_ratio(F.col("retained").cast("double"), F.col("comparable")), F.lit(0.0)))


def continuity_index(changes: DataFrame, core: DataFrame) -> DataFrame:
    """100 * (0.5 returning + 0.5 core) share of each team, from ``staff_continuity`` and ``core_continuity``."""
    joined = staff_continuity(changes).drop("index").join(core, "team")
    return joined.withColumn("index", 100 * (0.5 * F.col("returning") / F.col("staff") + 0.5 * F.col("core_share")))


INCONCLUSIVE = "reviewed_inconclusive_model_retained"


def review_coverage(queue: DataFrame) -> DataFrame:
    """Queued and reviewed rows, by metric and overall (metric null)."""
    return queue.rollup("metric").agg(F.count("*").alias("queued"), F.sum(F.when(F.col("finding") != "unreviewed", 1).otherwise(0)).alias("reviewed"))


def review_outcomes(queue: DataFrame, inconclusive: str = INCONCLUSIVE) -> DataFrame:
    """A17 in full: also inconclusive, resolved and unreviewed rows and the reviewed share (1 without rows)."""
    out = queue.rollup("metric").agg(
        F.count("*").alias("queued"), F.sum(F.when(F.col("finding") != "unreviewed", 1).otherwise(0)).alias("reviewed"), F.sum(F.when(F.col("finding") == inconclusive, 1).otherwise(0)).alias("inconclusive")
    )
    out = out.withColumn("resolved", F.col("reviewed") - F.col("inconclusive")).withColumn("unreviewed", F.col("queued") - F.col("reviewed"))
    return out.withColumn("share", F.coalesce(safe_ratio(F.col("reviewed").cast("double"), F.col("queued")), F.lit(1.0)))


def pool_by_window(weekly: DataFrame, keys: Sequence[str], values: Sequence[str], windows: Sequence[int] = (4, 8, 18)) -> DataFrame:
    """Totals from week 1 through each window end; weeks are summed first, once."""
    weeks = weekly.groupBy(*keys, "week").agg(*[F.sum(v).alias(v) for v in values])
    ends = F.array(*[F.lit(w) for w in windows])
    spread = weeks.withColumn("window_end", F.explode(F.filter(ends, lambda w: w >= F.col("week"))))
    return spread.groupBy(*keys, "window_end").agg(*[F.sum(v).alias(v) for v in values])


def evaluation_summary(rows: DataFrame, scopes: Column, baseline: str) -> DataFrame:
    """Errors per scope, window and model, and against the baseline model.

    ``rows`` has window_end, model and error, and may have top_hit, whose mean is the hit rate;
    ``scopes`` is an array column of the scopes a row is in.
    """
    more = [F.avg(F.col("top_hit").cast("double")).alias("hit_rate")] if "top_hit" in rows.columns else []
    spread = rows.withColumn("scope", F.explode(scopes))
    out = spread.groupBy("scope", "window_end", "model").agg(
        F.count("error").alias("n"), F.avg("error").alias("mean_error"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), *more
    )
    out = out.join(percentiles_by_rank(spread, ["scope", "window_end", "model"], "error", {"median_error": 0.5, "p75_error": 0.75}), ["scope", "window_end", "model"])
    base = F.max(F.when(F.col("model") == baseline, F.col("mean_error"))).over(Window.partitionBy("scope", "window_end"))
    return out.withColumn("delta", F.col("mean_error") - base).withColumn("improvement", safe_ratio(base - F.col("mean_error"), base))
