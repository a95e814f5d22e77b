"""Cleaning columns and scalar rules. Everything here is a column expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TEAM_ALIASES = {
    "ARZ": "ARI",
    "BLT": "BAL",
    "CLV": "CLE",
    "HST": "HOU",
    "JAC": "JAX",
    "LA": "LAR",
    "OAK": "LV",
    "SD": "LAC",
    "STL": "LAR",
    "WSH": "WAS",
}
# Fixed values.
DEPTH_WEIGHTS = {
    "QB": (1.0, 0.07, 0.015, 0.005),
    "RB": (1.0, 0.55, 0.28, 0.14, 0.07, 0.035),
    "WR": (1.0, 0.90, 0.80, 0.35, 0.22, 0.13, 0.08, 0.05),
    "TE": (1.0, 0.45, 0.18, 0.08, 0.04, 0.02),
}
# Fixed values.
HISTORY_STATUS = {
    "ACT": "active_53",
    "INA": "active_53",
    "DEV": "practice_squad",
    "PUP": "return_eligible_reserve",
    "EXE": "exempt_suspended",
    "SUS": "exempt_suspended",
}
# Fixed values.
RESERVE_CODES = {
    "R04": "return_eligible_reserve",
    "R48": "return_eligible_reserve",
    "R05": "reserve_nfi",
    "R27": "reserve_nfi",
    "R47": "reserve_nfi",
    "R49": "reserve_nfi",
    "R30": "exempt_suspended",
    "R33": "exempt_suspended",
    "R40": "exempt_suspended",
}
# Fixed values.
CURRENT_STATUS = {
    "ACT": "active_53",
    "DEV": "practice_squad",
    "PUP": "return_eligible_reserve",
    "RSR": "return_eligible_reserve",
    "RSN": "reserve_nfi",
    "RES": "reserve_other",
    "SUS": "exempt_suspended",
    "EXE": "exempt_suspended",
}
# Fixed values.
EVIDENCE_STATUS = {
    "practice_squad": "practice_squad",
    "reserve_pup": "return_eligible_reserve",
    "reserve_injured_designated_for_return": "return_eligible_reserve",
    "reserve_injured": "reserve_other",
    "commissioners_exempt": "exempt_suspended",
}
# Fixed values.
EVIDENCE_BANDS = ((80, "strong_role_evidence"), (65, "moderate_role_evidence"), (50, "limited_role_evidence"))
# Fixed values.
TOPICS = {
    "play_calling": r"\b(play.?call(?:er|ing)?|call(?:ing|s)? plays?|coordinator)\b",
    "scheme_style": r"\b(scheme|system|offense|tempo|motion|formation|play.?action|rpo)\b",
    "offensive_line": r"\b(offensive line|o-line|lineman|guard|tackle|center)\b",
    "injury_availability": r"\b(injur|recover|return|absen|questionable|pup|reserve)\w*\b",
    "role_usage": r"\b(starter|starting|depth chart|rotation|snaps?|targets?|carries|routes?)\b",
    "quarterback": r"\b(quarterback|\bqb\b)\b",
    "running_back": r"\b(running back|\brb\b|backfield)\b",
    "receiver_tight_end": r"\b(receiver|wideout|tight end|\bwr\b|\bte\b)\b",
}
# Responsibilities of offensive staff and what a title says for each.
RESPONSIBILITIES = {
    "offensive_coordinator": r"offens(?:iv)?e coordinator",
    "quarterbacks": r"quarterback",
    "running_backs": r"running back",
    "wide_receivers": r"wide receiver",
    "tight_ends": r"tight end",
    "offensive_line": r"offens(?:iv)?e line",
    "pass_game": r"pass(?:ing)? game",
    "run_game": r"run(?:ning)? game",
    "offensive_assistant": r"assistant|quality control|analyst",
}


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a small fixed map, null where the key is missing."""
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])[key]


def finite(col: Column) -> Column:
    """A number, or null for blanks, words, NaN and infinities."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def integral(col: Column) -> Column:
    """A whole number, or null."""
    number = finite(col)
    return F.when(number == F.floor(number), number.try_cast("long"))


def flag01(col: Column) -> Column:
    """0 or 1, or null."""
    number = integral(col)
    return F.when(number.isin(0, 1), number.cast("int"))


def word_bool(col: Column) -> Column:
    """TRUE or 1, FALSE or 0, else null."""
    word = F.upper(F.trim(col))
    return F.when(word.isin("TRUE", "1"), True).when(word.isin("FALSE", "0"), False)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(numerator, denominator)


def skill_position(col: Column) -> Column:
    """C4: RB, WR, TE, QB or OTHER."""
    word = F.upper(F.trim(col))
    return F.when(word.isin("RB", "FB", "HB"), "RB").when(word.isin("WR", "TE", "QB"), word).otherwise("OTHER")


def fantasy_position(col: Column) -> Column:
    """C4: as ``skill_position``, with K and null for others."""
    word = F.upper(F.trim(col))
    return F.when(word.isin("RB", "FB", "HB"), "RB").when(word.isin("WR", "TE", "QB"), word).when(word.isin("K", "PK"), "K")


def draft_position(col: Column) -> Column:
    """C4: team defences under one name."""
    word = F.upper(F.trim(col))
    return F.when(word.isin("D/ST", "DEF", "DST"), "DST").otherwise(word)


def canonical_team(col: Column) -> Column:
    """One code for each team."""
    word = F.upper(F.trim(col))
    return F.coalesce(lookup(TEAM_ALIASES, word), word)


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without marks: characters with one plain base, their bases, and those with several."""
    one, bases, several = [], [], {}
    for code in range(0xA0, 0x10000):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char).casefold() if not unicodedata.combining(c))
        if plain == char or 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        if len(plain) == 1:
            one.append(char)
            bases.append(plain)
        elif plain.isascii() and plain.isalnum():
            several[char] = plain
    return "".join(one), "".join(bases), several


def folded_name(col: Column) -> Column:
    """A name without case, accents and compatibility forms (NFKD, by a table made from the Unicode data)."""
    one, bases, several = _folds()
    name = F.translate(F.regexp_replace(F.lower(col), r"\p{M}", ""), one, bases)
    for base in sorted(set(several.values())):
        chars = "".join(c for c, plain in several.items() if plain == base)
        name = F.regexp_replace(name, f"[{chars}]", base)
    return name


def identity_key(col: Column) -> Column:
    """C6, by tokens: letters and digits of a folded name, without generational suffixes at its end."""
    name = F.trim(F.regexp_replace(folded_name(col), r"[^a-z0-9]+", " "))
    name = F.regexp_replace(name, r"^(?:(?:jr|sr|ii|iii|iv|v)(?: |$))+$", "")
    return F.regexp_replace(F.regexp_replace(name, r"(?: (?:jr|sr|ii|iii|iv|v))+$", ""), " ", "")


def identity_end(col: Column) -> Column:
    """C6, by the end of the string: letters and digits of a folded name, less one suffix at the end."""
    return F.regexp_replace(F.regexp_replace(folded_name(col), r"[^\p{L}\p{N}]", ""), r"(?:iii|ii|iv|jr|sr)$", "")


def name_aliases(*names: Column) -> Column:
    """The distinct identity keys of several names, without empty ones."""
    keys = F.array(*[F.coalesce(identity_key(n), F.lit("")) for n in names])
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def staff_side(role: Column) -> Column:
    """Side of a staff title, by the first group of words that it has."""
    text = F.lower(role)
    offense = r"offens(?:iv)?e|quarterback|running back|wide receiver|tight end|pass(?:ing)? game|run(?:ning)? game"
    return (
        F.when(text.rlike(r"^head coach(?:$|/| &| and )"), "head_coach")
        .when(text.rlike(r"defens(?:iv)?e|lineback|secondary"), "defense")
        .when(text.rlike(r"special teams|kicking|punter|return game"), "special_teams")
        .when(text.rlike(r"strength|performance|conditioning"), "performance")
        .when(text.rlike(offense), "offense")
        .otherwise("other")
    )


def staff_responsibilities(role: Column, side: Column) -> Column:
    """Sorted responsibilities of a title; head coaches have their own, only offensive staff have others."""
    text = F.lower(role)
    found = [F.when((side == "offense") & text.rlike(pattern), F.lit(name)) for name, pattern in RESPONSIBILITIES.items()]
    return F.array_sort(F.array_compact(F.array(F.when(side == "head_coach", F.lit("head_coach")), *found)))


def topic_tags(headline: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    """Names of the topics whose pattern a headline has, in the order given."""
    return F.array_compact(F.array(*[F.when(headline.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in topics.items()]))


def fantasy_points(projected: Column, stats: Mapping[str, Column], scoring: Mapping[str, float]) -> Column:
    """Projected points where given, else the sum of stats times their modifiers."""
    total = F.lit(0.0)
    for name, weight in scoring.items():
        total = total + F.coalesce(stats[name], F.lit(0.0)) * weight
    return F.coalesce(projected, total)


def points_range(points: Column, floor: Column, ceiling: Column) -> tuple[Column, Column]:
    """Floor and ceiling where given, else the points."""
    return F.coalesce(floor, points), F.coalesce(ceiling, points)


def depth_weight(position: Column, rank: Column, fullback: Column | None = None, resource: Column | None = None) -> Column:
    """Weight of a depth rank; beyond the table the last one falls by 0.55 a rank; 0.02 without a rank."""
    out = F.lit(None).cast("double")
    for name, weights in DEPTH_WEIGHTS.items():
        table = F.array(*[F.lit(w) for w in weights])
        past = F.lit(weights[-1]) * F.pow(F.lit(0.55), rank - len(weights))
        out = F.when(position == name, F.when(rank <= len(weights), F.get(table, rank.cast("int") - 1)).otherwise(past)).otherwise(out)
    out = F.when(rank.isNull() | (rank < 1), 0.02).otherwise(out)
    if fullback is not None and resource is not None:
        out = out * F.when(fullback & resource.endswith("CARRIES"), 0.08).when(fullback & resource.endswith("TARGETS"), 0.15).otherwise(1.0)
    return out


def status_family(status: Column, description: Column) -> Column:
    """C14: cohort family of a historical roster status; null for unknown ones."""
    code, detail = F.upper(F.trim(status)), F.upper(F.trim(description))
    reserve = F.coalesce(lookup(RESERVE_CODES, detail), F.lit("reserve_other"))
    return F.when(code == "RES", reserve).otherwise(lookup(HISTORY_STATUS, code))


def current_status_family(status: Column, evidence: Column) -> Column:
    """C14: cohort family of a current roster status; what evidence says goes first. Null for unknown ones."""
    return F.coalesce(lookup(EVIDENCE_STATUS, F.lower(F.trim(evidence))), lookup(CURRENT_STATUS, F.upper(F.trim(status))))


def score_band(score: Column, bands: Sequence[tuple[float, str]] = EVIDENCE_BANDS, lowest: str = "weak_role_evidence") -> Column:
    """The first band whose bound the score reaches; null scores stay null."""
    out = F.lit(lowest)
    for bound, name in reversed(bands):
        out = F.when(score >= bound, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def volume(position: Column, attempts: Column, carries: Column, targets: Column) -> Column:
    """Opportunities that count for a position."""
    return F.when(position == "QB", attempts + carries).when(position == "RB", carries + targets).otherwise(targets)


def snake_owner(overall: Column, teams: Column) -> Column:
    """C17: slot (from 0) that owns an overall pick (from 1); the order turns each round."""
    turn, place = F.floor((overall - 1) / teams), F.pmod(overall - 1, teams)
    return F.when(turn % 2 == 0, place).otherwise(teams - 1 - place).cast("int")


def next_pick(current: Column, slot: Column, teams: Column) -> Column:
    """C17: the first overall pick after ``current`` that the slot owns."""
    return F.array_min(F.filter(F.sequence(current + 1, current + 2 * teams), lambda p: snake_owner(p, teams) == slot))


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by the five-term rational approximation of erf."""
    # Fixed values.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * z)
    erf = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def lineup_status(count: Column, fixed: Column, flex_excess: Column, flex_slots: Column, flex_eligible: Column) -> Column:
    """Starter below the fixed slots, flex while eligible excess is below the flex slots, else bench."""
    return F.when(count < fixed, "starter").when(flex_eligible & (flex_excess < flex_slots), "flex").otherwise("bench")


def roster_needs(statuses: Mapping[str, Column], turn: Column, late: Sequence[str] = ("K", "DST"), from_round: int = 11) -> Column:
    """The positions that are starter or flex, those of ``late`` only from a round on, in the order given."""
    needs = []
    for position, status in statuses.items():
        open_ = status.isin("starter", "flex")
        needs.append(F.when(open_ & (turn >= from_round) if position in late else open_, F.lit(position)))
    return F.array_compact(F.array(*needs))


def play_flags(p: dict[str, Column]) -> dict[str, Column]:
    """C11: situation flags of a play, from its columns by name."""
    known = (p["pass"] + p["rush"]) == 1
    return {
        "eligible": F.coalesce(p["down"].between(1, 4) & known & (F.coalesce(p["qb_kneel"], F.lit(0)) != 1) & (F.coalesce(p["qb_spike"], F.lit(0)) != 1), F.lit(False)),
        "neutral": F.coalesce(p["down"].isin(1, 2) & p["qtr"].between(1, 3) & p["wp"].between(0.20, 0.80), F.lit(False)),
        "red_zone": F.coalesce(p["yardline_100"] <= 20, F.lit(False)),
        "deep": F.coalesce((p["pass"] == 1) & (p["air_yards"] >= 15), F.lit(False)),
        "explosive": F.coalesce(((p["pass"] == 1) & (p["yards_gained"] >= 20)) | ((p["rush"] == 1) & (p["yards_gained"] >= 10)), F.lit(False)),
    }


def event_flags(p: dict[str, Column]) -> dict[str, Column]:
    """Situations of targets and carries, by count name."""
    yard, air, down, togo = p["yardline_100"], p["air_yards"], p["down"], p["ydstogo"]
    late = p["qtr"].isin(2, 4) & p["half_seconds_remaining"].between(0, 120)
    short = (togo > 0) & (togo <= 2)
    scramble = F.coalesce(p["qb_scramble"] == 1, F.lit(False))
    flags = {
        "targets_with_air_yards": air.isNotNull(),
        "deep_targets": air >= 15,
        "end_zone_targets": air >= yard,
        "red_zone_targets": yard <= 20,
        "inside_10_targets": yard <= 10,
        "two_minute_targets": late,
        "third_fourth_down_targets": down.isin(3, 4),
        "red_zone_carries": yard <= 20,
        "inside_10_carries": yard <= 10,
        "inside_5_carries": yard <= 5,
        "goal_to_go_carries": p["goal_to_go"] == 1,
        "short_yardage_carries": short,
        "third_fourth_short_carries": short & down.isin(3, 4),
        "two_minute_carries": late,
        "qb_scramble_carries": (p["position"] == "QB") & scramble,
        "designed_qb_carries": (p["position"] == "QB") & ~scramble,
        "designed_qb_red_zone_carries": (p["position"] == "QB") & ~scramble & (yard <= 20),
        "designed_qb_inside_10_carries": (p["position"] == "QB") & ~scramble & (yard <= 10),
        "designed_qb_inside_5_carries": (p["position"] == "QB") & ~scramble & (yard <= 5),
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}
