"""season transactions of many leagues replayed by ranges, so that one long history is many tasks' work.

A league's history is a stack of at most ``bound`` changes: a change is put on it (the oldest one
falls off at the bottom and stands for good), an undo takes the last one back, or does nothing on an
empty stack. How deep the stack is after a stretch of changes is ``min(high, max(low, depth + sum))`` of
how deep it was before: such stretches compose, so the depth at the start of each range comes from
one small row a range. Then each range matches its undos with its own changes; those left over reach
back into earlier ranges by their number alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opportunity.functions.stored import stored
from opportunity.operators.ranges import running_total
from opportunity.quality import QualityError

SLOTS = ("Starter", "Bench", "IR")
#: Changes that a history keeps.
BOUND = 100


def _leagues(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], pa.RecordBatch]]:
    """(league, range), the steps and the rows of each stretch; a stretch that spans batches comes in parts."""
    for batch in batches:
        keys = list(zip(batch.column("_league").to_pylist(), batch.column("_range").to_pylist(), strict=True))
        steps, start = batch.column("_step").to_pylist(), 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                yield keys[start], steps[start:end], batch.slice(start, end - start)
                start = end


def _summaries(bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Depth after each stretch, from an empty and from a full stack."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, int]] = {}
        for key, steps, _ in _leagues(batches):
            low, high = held.pop(key, (0, bound))
            for step in steps:
                low, high = (min(bound, low + 1), min(bound, high + 1)) if step > 0 else (max(0, low - 1), max(0, high - 1))
            if held:
                yield from _rows(held)
                held = {}
            held[key] = (low, high)
        if held:
            yield from _rows(held)

    def _rows(held: dict[tuple, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        (league, place), (low, high) = next(iter(held.items()))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (league, place, low, high)], ["_league", "_range", "low", "high"])

    return mapped


def _matched(bound: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Changes that their own stretch leaves, counted from its last one, and undos that reach into earlier stretches."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depth, stack, back = None, 0, [], 0
        for key, steps, rows in _leagues(batches):
            if key != now:
                if now is not None:
                    yield from left(now, stack, back)
                now, depth, stack, back = key, rows.column("_start")[0].as_py(), [], 0
            for step, seq in zip(steps, rows.column("seq").to_pylist(), strict=True):
                if step > 0:
                    depth = min(bound, depth + 1)
                    stack.append(seq)
                elif depth:
                    depth -= 1
                    if stack:
                        stack.pop()
                    else:
                        back += 1
        if now is not None:
            yield from left(now, stack, back)

    def left(key: tuple, stack: list, back: int) -> Iterator[pa.RecordBatch]:
        n, size = len(stack), len(stack) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * size, pa.int64()), pa.array([key[1]] * size, pa.int64()), pa.array([*stack, None], pa.int64()), pa.array([*range(n, 0, -1), None], pa.int64()), pa.array([None] * n + [back], pa.int64()), pa.array([None] * n + [n], pa.int64())],
            ["_league", "_range", "seq", "from_last", "back", "left"],
        )

    return mapped


def _dealt(transactions: DataFrame) -> DataFrame:
    """Rows in ranges of (league, seq), with a step of 1 or -1, in the work folder."""
    ranges = int(transactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = transactions.withColumn("_league", F.xxhash64("league_id")).withColumn("_step", F.when(F.col("kind") == "undo", -1).otherwise(1))
    dealt = stored(rows.repartitionByRange(ranges, "_league", "seq").withColumn("_range", F.spark_partition_id().cast("long")), "transactions")
    clash = dealt.groupBy("_league").agg(F.min("league_id").alias("a"), F.max("league_id").alias("b")).filter("a <> b")
    if clash.limit(1).count():
        raise QualityError("two leagues share a hash")
    return dealt


def _ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """Each range in one task, in order."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(ranges, "_range").sortWithinPartitions("_range", "_league", "seq").select("_league", "_range", "_step", "seq", *columns)


def _starts(dealt: DataFrame, bound: int) -> DataFrame:
    """_league, _range and _start: the depth of the stack before each stretch."""
    found = _ordered(dealt).mapInArrow(_summaries(bound), "_league long, _range long, low long, high long")
    sums = dealt.groupBy("_league", "_range").agg(F.sum("_step").alias("sum"))
    parts = found.join(sums, ["_league", "_range"]).groupBy("_league").agg(F.array_sort(F.collect_list(F.struct("_range", "low", "high", "sum"))).alias("parts"))
    # A league has one part a range at most.
    zero = F.struct(F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<_range:bigint,_start:bigint>>").alias("out"))
    step = lambda acc, p: F.struct(F.least(p["high"], F.greatest(p["low"], acc["depth"] + p["sum"])).alias("depth"), F.concat(acc["out"], F.array(F.struct(p["_range"].alias("_range"), acc["depth"].alias("_start")))).alias("out"))
    return parts.select("_league", F.explode(F.aggregate("parts", zero, step)["out"]).alias("p")).select("_league", "p.*")


def standing_changes(transactions: DataFrame, bound: int = BOUND) -> DataFrame:
    """the changes (rows of ``transactions`` that are no undo) that no undo has taken back.

    ``seq`` tells a league's rows apart. Rows by range are written to the work folder while the plan is built.
    """
    dealt = _dealt(transactions)
    rows = dealt.join(_starts(dealt, bound), ["_league", "_range"])
    found = stored(_ordered(rows, "_start").mapInArrow(_matched(bound), "_league long, _range long, seq long, from_last long, back long, left long"), "matched")
    # From the last range back: what later ranges take, first from the last changes of the one before.
    parts = found.filter("left is not null").groupBy("_league").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_range", "back", "left")))).alias("parts"))
    zero = F.struct(F.lit(0).cast("long").alias("due"), F.array().cast("array<struct<_range:bigint,gone:bigint>>").alias("out"))
    step = lambda acc, p: F.struct((acc["due"] - F.least(acc["due"], p["left"]) + p["back"]).alias("due"), F.concat(acc["out"], F.array(F.struct(p["_range"].alias("_range"), F.least(acc["due"], p["left"]).alias("gone")))).alias("out"))
    gone = parts.select("_league", F.explode(F.aggregate("parts", zero, step)["out"]).alias("p")).select("_league", "p.*")
    kept = found.filter("seq is not null").join(gone, ["_league", "_range"]).filter(F.col("from_last") > F.col("gone")).select("_league", "seq")
    return dealt.filter("_step > 0").join(kept, ["_league", "seq"], "left_semi").select(*transactions.columns)


def ownership_states(transactions: DataFrame, history: int = BOUND) -> DataFrame:
    """F23 in full: owner and slot of each owned player of each league.

    ``transactions`` has league_id, seq, kind (add, drop or undo), player_id, owner and slot. Undos reach
    back over the last ``history`` changes only; one on an empty history does nothing.
    """
    kept = standing_changes(transactions.select("league_id", "seq", "kind", "player_id", "owner", "slot"), history)
    last = kept.groupBy("league_id", "player_id").agg(F.max_by(F.struct("kind", "owner", "slot"), "seq").alias("s"))
    return last.filter("s.kind = 'add'").select("league_id", "player_id", "s.owner", "s.slot")


def _owned_before(rows: DataFrame) -> DataFrame:
    """Each change with whether its player was owned before it; ``rows`` are changes and the undos that take one back.

    At a level of the history a change is followed by the undo that takes it back, if any. So a player's own changes
    are brackets too, and what holds before a change is the last one that opened the level below it.
    """
    step = F.col("_step").cast("long")
    leveled = running_total(rows, ["league_id"], [F.col("seq")], step).withColumnRenamed("_upto", "_after").drop("_all").withColumn("_bracket", F.when(F.col("_step") > 0, F.col("_after")).otherwise(F.col("_after") + 1))
    same = Window.partitionBy("league_id", "_bracket").orderBy("seq")
    known = leveled.withColumn("_who", F.when(F.col("_step") > 0, F.col("player_id")).otherwise(F.lag("player_id").over(same)))
    mine = running_total(known, ["league_id", "_who"], [F.col("seq")], step).withColumnRenamed("_upto", "_own").drop("_all")
    # A change opens its level and asks for the one below; undone levels are opened again before they are asked for.
    sides = F.array(F.struct((F.col("_own") - 1).alias("level"), F.lit(None).cast("string").alias("opened"), F.lit(True).alias("asks")), F.struct(F.col("_own").alias("level"), F.col("kind").alias("opened"), F.lit(False).alias("asks")))
    both = mine.filter("_step > 0").select("league_id", "seq", "kind", "_who", F.explode(sides).alias("s"))
    before = F.last("s.opened", ignorenulls=True).over(Window.partitionBy("league_id", "_who", "s.level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_before", before).filter("s.asks").select("league_id", "seq", "kind", F.col("_who").alias("player_id"), F.when(F.col("s.level") > 0, F.col("_before") == "add").otherwise(False).alias("owned"))


def rejected_transactions(transactions: DataFrame, bound: int = BOUND, slots: tuple[str, ...] = SLOTS) -> DataFrame:
    """league_id, seq and reason of each league's first transaction that is an error.

    ``no_player``: a change without a player; ``unknown_slot``: an add to another slot than ``slots``;
    ``nothing_to_undo``: an undo on an empty history; ``already_unowned``: a drop of a player whom no one owns.
    Rows after a league's first error are not judged.
    """
    dealt = _dealt(transactions.select("league_id", "seq", "kind", "player_id", "slot"))
    rows = dealt.join(_starts(dealt, bound), ["_league", "_range"])

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depth = None, 0
        for key, steps, part in _leagues(batches):
            if key != now:
                now, depth = key, part.column("_start")[0].as_py()
            out = []
            for step in steps:
                out.append(depth)
                depth = min(bound, depth + 1) if step > 0 else max(0, depth - 1)
            yield pa.RecordBatch.from_arrays([part.column("_league"), part.column("seq"), pa.array(out, pa.int64())], ["_league", "seq", "depth"])

    deep = _ordered(rows, "_start").mapInArrow(depths, "_league long, seq long, depth long")
    rows = stored(dealt.join(deep, ["_league", "seq"]), "depths")
    owned = _owned_before(rows.filter("_step > 0 or depth > 0").select("league_id", "seq", "kind", "player_id", "_step"))
    reason = (
        F.when((F.col("_step") < 0) & (F.col("depth") == 0), "nothing_to_undo")
        .when((F.col("_step") > 0) & (F.coalesce(F.col("player_id").cast("string"), F.lit("")) == ""), "no_player")
        .when((F.col("kind") == "add") & ~F.coalesce(F.col("slot").isin(*slots), F.lit(False)), "unknown_slot")
        .when((F.col("kind") == "drop") & ~F.col("owned"), "already_unowned")
    )
    found = rows.join(owned.select("league_id", "seq", "owned"), ["league_id", "seq"], "left").select("league_id", "seq", reason.alias("reason")).filter("reason is not null")
    return found.groupBy("league_id").agg(F.min(F.struct("seq", "reason")).alias("f")).select("league_id", "f.seq", "f.reason")


def checked_ownership(transactions: DataFrame, history: int = BOUND) -> DataFrame:
    """``ownership_states``; a transaction that is an error raises."""
    if found := rejected_transactions(transactions, history).limit(1).collect():
        raise QualityError(f"transaction {found[0].asDict()}")
    return ownership_states(transactions, history)
