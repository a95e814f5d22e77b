"""Mixing sources to target weights, with DataFrame functions only.

A source with the share p of all tokens gets the weight ``p ** a / sum(p ** a)``. The exponent
``a`` is found by bisection on [0, 1]: the largest ``a`` that reaches a target entropy (as a
share of the largest possible one), or the smallest that keeps every source within a limit of
repetitions. Both change with ``a`` in one direction only. Five turns of the bisection are one
small aggregate over the sources, for the 31 exponents that these turns can ask for; the shares
never come to the driver.

The weights are realised as blocks. A source's budget is its weight times the total budget. It
is filled by whole passes over the source and one more, partial, pass. For a partial pass the
documents stand in the order of a keyed hash of (seed, pass, document); that permutation is cut
into blocks by hash range, as many as documents in each; whole blocks are taken while they fit, and the last block is taken
document by document until the next one would pass the budget. Only that one block of each
source is sorted, so no source meets in one task.

Tokens are the pieces between runs of white space, one at least, so that empty and null texts
count too. The total budget is a multiple of all tokens, or (None) as many as it takes to have
every document once: the source with the fewest passes then has exactly one. A null source is a
source of its own. Repeated rows are mixed as separate rows. An empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opportunity.llm.common import broadcast_if_small, written

#: Rounds of five turns of the bisection each.
ROUNDS, TURNS = 8, 5


def token_column(text: str = "text"):
    return F.size(F.split(F.coalesce(F.col(text), F.lit("")), "[ \t\n\r]+")).cast("long")


def source_shares(sized: DataFrame) -> DataFrame:
    """source, docs, tokens and share of ``sized`` (source, n_tokens); one row for each source."""
    totals = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    totals = written(totals, "source-totals")
    whole = totals.agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("sources"))
    return totals.crossJoin(F.broadcast(whole)).withColumn("share", F.col("tokens") / F.col("all_tokens"))  # one row on the right


def _powers(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """For each exponent the entropy, and the most and the fewest passes over a source for a budget of all tokens."""
    rows = shares.select("share", F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    power = F.pow("share", F.col("a"))
    passes = power / F.col("share")
    found = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(passes).alias("top"), F.min(passes).alias("low"))
    return {r.a: (math.log(r.z) - r.a * r.s / r.z, r.top / r.z, r.low / r.z) for r in found.collect()}  # a row for each exponent


def find_exponent(shares: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = 1.0) -> float:
    """Bisection for a target entropy (share of log of the number of sources) or a limit of repetitions.

    ``budget`` is the number of tokens of the mix as a multiple of all tokens.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a limit of repetitions")
    most = math.log(max(1, shares.count()))

    def flat_enough(measures: tuple[float, float, float]) -> bool:
        got, top, fewest = measures
        if entropy is not None:
            return got >= entropy * most - 1e-12
        return top * (1 / fewest if budget is None else budget) > repeats

    low, width = 0.0, 1.0
    ends = _powers(shares, [0.0, 1.0])
    if not ends or flat_enough(ends[1.0]):
        return 1.0
    if not flat_enough(ends[0.0]):
        return 0.0
    for _ in range(ROUNDS):
        width /= 1 << TURNS  # all exponents are whole multiples of a power of two
        measures = _powers(shares, [low + k * width for k in range(1, 1 << TURNS)])
        low += width * sum(flat_enough(m) for m in measures.values())
    return low if entropy is not None else low + width


def mix_plan(shares: DataFrame, exponent: float, budget: float | None = 1.0) -> DataFrame:
    """source, weight, budget in tokens, whole passes and what is left for the partial pass."""
    power = F.pow("share", F.lit(exponent))
    total = shares.agg(F.sum(power).alias("z"), F.min(power / F.col("share")).alias("fewest"))
    planned = shares.crossJoin(F.broadcast(total)).withColumn("weight", power / F.col("z"))  # one row on the right
    scale = F.col("z") / F.col("fewest") if budget is None else F.lit(float(budget))
    planned = planned.withColumn("budget_tokens", F.round(F.col("weight") * F.col("all_tokens") * scale).cast("long"))
    planned = planned.withColumn("passes", F.floor(F.col("budget_tokens") / F.col("tokens")))
    return planned.select("source", "docs", "tokens", "weight", "budget_tokens", "passes", (F.col("budget_tokens") - F.col("passes") * F.col("tokens")).alias("rest_tokens"))


def realised(rows: DataFrame, plan: DataFrame, seed: int = 17, sized: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, source, n_tokens and more) with the copies that the plan gives each row.

    ``sized`` holds the same rows without the other columns, where it is cheaper to read.
    """
    plan = written(plan, "mix-plan").select(F.col("source").alias("_source"), "docs", "weight", "passes", "rest_tokens")
    plan = broadcast_if_small(plan)
    key = ["source"]
    draw = F.xxhash64(F.lit(seed), F.col("passes"), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("n_tokens"))
    uniform = F.pmod("_draw", F.lit(1 << 40)) / F.lit(float(1 << 40))
    blocks = F.ceil(F.sqrt("docs"))  # as many blocks as documents in a block

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return df.withColumn("_draw", draw).withColumn("_block", F.floor(uniform * blocks))

    sums = placed(rows if sized is None else sized).groupBy("source", "_block", "rest_tokens").agg(F.sum("n_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_block"))
    cut = written(sums.withColumn("_upto", upto).select(*key, "_block", (F.col("_upto") - F.col("_sum")).alias("_before"), "_upto", "rest_tokens"), "mix-blocks")
    edge = cut.filter("_before <= rest_tokens and _upto > rest_tokens")
    edge = edge.select(F.col("source").alias("_source"), F.col("_block").alias("_edge"), "_before")
    # At most one row for each source; the blocks before it are whole, those after it have no share.
    keyed = placed(rows).join(broadcast_if_small(edge), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    whole = F.col("_edge").isNull() | (F.col("_block") < F.col("_edge"))
    inside = keyed.filter(F.col("_block") == F.col("_edge"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("copies", (F.col("passes") + F.when(F.col("_before") + running <= F.col("rest_tokens"), 1).otherwise(0)).cast("long"))
    outside = keyed.filter(F.col("_edge").isNull() | (F.col("_block") != F.col("_edge")))
    outside = outside.withColumn("copies", (F.col("passes") + F.when(whole, 1).otherwise(0)).cast("long"))
    return outside.unionByName(inside).drop("_draw", "_block", "_edge", "_before", "rest_tokens", "docs", "passes")


def mixed(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = 1.0, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, weight of the source and copies of each document."""
    sized = written(docs.select("doc_id", "source", token_column().alias("n_tokens")), "mix-sizes")
    shares = source_shares(sized)
    exponent = find_exponent(shares, entropy, repeats, budget)
    return realised(sized, mix_plan(shares, exponent, budget), seed)


def mixed_documents(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = 1.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source"), token_column().alias("n_tokens"))
    sized = written(own.drop("row"), "mix-sizes")
    shares = source_shares(sized)
    plan = mix_plan(shares, find_exponent(shares, entropy, repeats, budget), budget)
    rows = realised(own, plan, seed, sized).filter("copies > 0")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
