"""F9's draws as bit strings and F23's replay by ranges, against plain versions."""

import hashlib
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from opportunity.plans import draws, forecast, ownership
from opportunity.quality import QualityError

# F23 ---------------------------------------------------------------------------------------

SCHEMA = "league_id long, seq long, kind string, player_id string, owner long, slot string"


def log(leagues, length, seed, undo=0.35, checked=False):
    rng, rows = random.Random(seed), []
    for league in range(leagues):
        owned: dict = {}
        history: deque = deque(maxlen=100)
        for seq in range(length):
            kind = rng.choices(["undo", "drop", "add"], [undo, 0.2, 0.8 - undo])[0]
            player = f"p{rng.randrange(12)}"
            if checked and (kind == "undo" and not history or kind == "drop" and player not in owned):
                kind = "add"
            if kind == "undo":
                if history:
                    owned = history.pop()
            else:
                history.append(dict(owned))
                owned.pop(player, None)
                if kind == "add":
                    owned[player] = 1
            rows.append((league, seq * 3 + league, kind, None if kind == "undo" else player, rng.randrange(4) if kind == "add" else None, rng.choice(ownership.SLOTS) if kind == "add" else None))
    return rows


def replayed(rows, bound):
    out = {}
    for league in {r[0] for r in rows}:
        owners, history = {}, deque(maxlen=bound)
        for _, _, kind, player, owner, slot in sorted((r for r in rows if r[0] == league), key=lambda r: r[1]):
            if kind == "undo":
                if history:
                    owners = history.pop()
                continue
            history.append(dict(owners))
            owners.pop(player, None)
            if kind == "add":
                owners[player] = (owner, slot)
        out |= {(league, p): s for p, s in owners.items()}
    return out


@pytest.mark.parametrize(("leagues", "length", "undo", "bound"), [(5, 60, 0.35, 100), (3, 400, 0.45, 7), (1, 900, 0.55, 3), (4, 30, 0.0, 2), (2, 200, 0.7, 1)])
def test_states_equal_the_stack(spark, leagues, length, undo, bound):
    rows = log(leagues, length, length, undo)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("_note", "depth")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        try:
            got = {(r.league_id, r.player_id): (r.owner, r.slot) for r in ownership.ownership_states(df, bound).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == replayed(rows, bound)


def test_one_league_is_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("league_id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 2, "undo").otherwise("add").alias("kind"), (F.col("id") % 50).cast("string").alias("player_id"), (F.col("id") % 7).alias("owner"), F.lit("Bench").alias("slot"))
    dealt = ownership._dealt(rows)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 100_000
    plain = replayed([tuple(r) for r in rows.collect()], 100)
    assert {(r.league_id, r.player_id): (r.owner, r.slot) for r in ownership.ownership_states(rows).collect()} == plain


def test_bad_transactions(spark):
    good = log(3, 80, 4, checked=True)
    df = spark.createDataFrame(good, SCHEMA)
    assert ownership.rejected_transactions(df).collect() == []
    assert {(r.league_id, r.player_id): (r.owner, r.slot) for r in ownership.checked_ownership(df).collect()} == replayed(good, 100)
    bad = [
        (10, 1, "undo", None, None, None), (11, 1, "drop", "a", None, None), (12, 1, "add", "a", 1, "Bench"), (12, 2, "undo", None, None, None), (12, 3, "drop", "a", None, None), (12, 4, "undo", None, None, None), (12, 5, "undo", None, None, None),
        (13, 1, "add", "a", 1, "Sofa"), (14, 1, "add", "", 1, "IR"), (15, 1, "add", "a", 1, "IR"), (15, 2, "drop", "a", None, None), (15, 3, "drop", "a", None, None), (16, 1, "add", "a", 1, "IR"), (16, 2, "drop", "a", None, None), (16, 3, "undo", None, None, None), (16, 4, "drop", "a", None, None),
    ]
    found = {(r.league_id, r.seq, r.reason) for r in ownership.rejected_transactions(spark.createDataFrame([*good, *bad], SCHEMA)).collect()}
    assert found == {(10, 1, "nothing_to_undo"), (11, 1, "already_unowned"), (12, 3, "already_unowned"), (13, 1, "unknown_slot"), (14, 1, "no_player"), (15, 3, "already_unowned")}
    with pytest.raises(QualityError):
        ownership.checked_ownership(spark.createDataFrame(bad, SCHEMA))


# F9 ----------------------------------------------------------------------------------------


def test_shares_equal_plain_draws(spark, monkeypatch):
    monkeypatch.setattr(draws, "PLAYERS", 3)
    rng = np.random.default_rng(3)
    roles = [(t, r, p, float(rng.random())) for t in (1, 2) for r in ("A", "B") for p in range(8) if (p + t) % 3]
    roles += [(1, "A", 50, 0.0), (3, "A", 60, 1.0)]
    chance = [(t, w, p, None if p == 5 else 0.15 * (p % 7), (t + w) % 3 != 0) for t in (1, 2, 3) for w in (1, 2) for p in [*range(8), 50, 60]]
    n = 400
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    roles_df, chance_df = frame(roles, "team int, resource string, player_id long, weight double"), frame(chance, "team int, week int, player_id long, p double, scheduled boolean")
    on = {(w, p): np.array([q is not None and int(hashlib.md5(f"9|{p}|{w}|{d}".encode()).hexdigest()[:8], 16) / 2**32 < q for d in range(n)]) for _, w, p, q, _ in chance}
    want, empty = {}, {}
    for t, w, s in {(t, w, s) for t, w, _, _, s in chance}:
        for r in "AB":
            room = [(p, x) for tt, rr, p, x in roles if (tt, rr) == (t, r)]
            total = sum((x * on[w, p] for p, x in room), np.zeros(n))
            for p, x in room:
                share = np.where(on[w, p] & (total > 0) & s, x / np.where(total > 0, total, 1), 0.0)
                want[t, w, r, str(p)] = [share.mean(), *np.percentile(share, [10, 50, 90])]
            if room and s and (total <= 0).any():
                empty[t, w, r] = (total <= 0).mean()
    got = {(r.team, r.week, r.resource, r.player_id): [r.mean_share, r.p10, r.p50, r.p90] for r in forecast.scenario_shares(roles_df, chance_df, n, 9).collect()}
    assert {k[:3]: v[0] for k, v in got.items() if k[3] == "__UNALLOCATED__"} == pytest.approx(empty)
    own = {k: v for k, v in got.items() if k[3] != "__UNALLOCATED__"}
    assert own.keys() == want.keys()
    for k in want:
        assert own[k] == pytest.approx(want[k])
