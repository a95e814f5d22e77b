"""Data-quality checks, reconciliation and content hashes.

Checks raise ``QualityError`` and read at most one offending row, or one row of counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A table breaks a rule."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q1: keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Q1: raises on a duplicate key, naming one."""
    if found := duplicate_keys(df, keys).limit(1).collect():
        raise QualityError(f"duplicate key {found[0].asDict()}")


def range_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Q2: one row with the number of rows that break each rule; a null result breaks it."""
    return df.agg(*[F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)).alias(name) for name, rule in rules.items()])


def assert_range(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Q2: raises if any rule is broken."""
    if broken := {k: v for k, v in range_violations(df, rules).first().asDict().items() if v}:
        raise QualityError(f"rules broken: {broken}")


def assert_rule(df: DataFrame, rule: Column, message: str) -> None:
    """Q3: raises on a row that does not keep a rule."""
    if df.filter(~F.coalesce(rule, F.lit(False))).limit(1).collect():
        raise QualityError(message)


def reconcile(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: str, total: str) -> DataFrame:
    """Q4: error of the summed parts against each total."""
    sums = parts.groupBy(*keys).agg(F.sum(part).alias("parts"))
    return totals.join(sums, list(keys), "left").select(*keys, total, F.coalesce("parts", F.lit(0.0)).alias("parts")).withColumn("error", F.abs(F.col("parts") - F.col(total)))


def assert_reconciled(parts: DataFrame, totals: DataFrame, keys: Sequence[str], part: str, total: str, tolerance: float = 1e-6) -> None:
    """Q4: raises on a group whose parts miss its total by more than ``tolerance``."""
    off = reconcile(parts, totals, keys, part, total).filter(~F.coalesce(F.col("error") <= tolerance, F.lit(False)))
    if found := off.limit(1).collect():
        raise QualityError(f"parts do not sum to the total: {found[0].asDict()}")


def not_after(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Q5: latest date, age in days at the cutoff, and rows after it."""
    day = F.to_date(F.lit(cutoff))
    return df.agg(F.max(F.to_date(date)).alias("latest"), F.datediff(day, F.max(F.to_date(date))).cast("long").alias("age_days"), F.sum(F.when(F.to_date(date) > day, 1).otherwise(0)).alias("late_rows"))


def assert_not_after(df: DataFrame, date: str, cutoff: str) -> None:
    """Q5: raises if a row is dated after the cutoff."""
    if not_after(df, date, cutoff).first().late_rows:
        raise QualityError(f"{date} has rows after {cutoff}")


def table_fingerprint(df: DataFrame) -> str:
    """Q6: hash of a table's rows, in any order; equal rows count each."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"h{k}") for k in range(8)]
    row = df.agg(F.count("*").alias("rows"), *parts).first()
    return hashlib.sha256("|".join([*sorted(df.columns), *map(str, row)]).encode()).hexdigest()


def bundle_fingerprint(tables: Mapping[str, str], parameters: Mapping[str, object]) -> str:
    """Q6: one hash over the names and hashes of tables, and parameters."""
    text = "|".join([*(f"{k}={v}" for k, v in sorted(tables.items())), *(f"{k}={v!r}" for k, v in sorted(parameters.items()))])
    return hashlib.sha256(text.encode()).hexdigest()


def source_inventory(tables: Mapping[str, tuple[DataFrame, str]], as_of: str | None = None) -> DataFrame:
    """Q7: rows and latest date of each table, by name; with ``as_of`` also its age in days then and its hash (Q6)."""
    parts = [df.agg(F.lit(name).alias("component"), F.count("*").alias("rows"), F.max(F.to_date(date)).alias("latest")) for name, (df, date) in tables.items()]
    if as_of is not None:
        hashes = [table_fingerprint(df) for df, _ in tables.values()]
        parts = [p.withColumn("age_days", F.datediff(F.to_date(F.lit(as_of)), "latest").cast("long")).withColumn("hash", F.lit(h)) for p, h in zip(parts, hashes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_references(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Q8: keys of the children that no parent has."""
    return children.select(key).distinct().join(parents.select(key), key, "left_anti")


def profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Q9: rows and the share of nulls of each column, by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_share") for c in columns])


def profile_snapshot(df: DataFrame, counts: Sequence[str], shares: Mapping[str, Column], conflicts: Mapping[str, Column]) -> DataFrame:
    """Q9: one row: how many distinct values and rows, the mean and the most of each share, and rows in conflict."""
    parts = [F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"{c}_values") for c in counts]]
    parts += [x for name, value in shares.items() for x in (F.avg(value).alias(f"mean_{name}"), F.max(value).alias(f"max_{name}"))]
    return df.agg(*parts, *[F.sum(F.when(F.coalesce(rule, F.lit(False)), 1).otherwise(0)).alias(name) for name, rule in conflicts.items()])


def row_differences(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Q10: the rows that only one side has, with side (recomputed or stored)."""
    columns = recomputed.columns
    held = stored.select(*columns)
    return recomputed.exceptAll(held).withColumn("side", F.lit("recomputed")).unionByName(held.exceptAll(recomputed).withColumn("side", F.lit("stored")))


def decision_differences(evaluations: DataFrame, comparisons: DataFrame, decision: DataFrame, baseline: str, windows: Sequence[int], digits: int = 9) -> DataFrame:
    """Q10: E13 run again from stored evaluations and comparisons, and where the stored decision differs; numbers are compared as rounded."""
    from opportunity.stats import two_stage_gate

    same = lambda df: df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return row_differences(same(two_stage_gate(evaluations, comparisons, baseline, windows)), same(decision))


def radius_differences(rows: DataFrame, radii: DataFrame, keys: Sequence[str], error: str, coverage: float = 0.90, digits: int = 9) -> DataFrame:
    """Q10: E6 run again from the scored rows, and where the stored radii differ."""
    from opportunity.stats import conformal_radius

    again = conformal_radius(rows, keys, error, coverage).select(*keys, F.round("radius", digits).alias("radius"))
    return row_differences(again, radii.select(*keys, F.round("radius", digits).alias("radius")))


def assert_no_differences(differences: DataFrame, what: str = "decision") -> None:
    """Q10: raises on what ``decision_differences`` or ``radius_differences`` finds, naming one row."""
    if found := differences.limit(1).collect():
        raise QualityError(f"the stored {what} is not what its inputs give: {found[0].asDict()}")


def assert_reproduces(recomputed: DataFrame, stored: DataFrame, what: str = "decision") -> None:
    """Q10: raises unless a stored result has just the rows that its inputs give again."""
    if not same_rows(recomputed, stored.select(*recomputed.columns)):
        raise QualityError(f"the stored {what} is not what its inputs give")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Q10: whether two tables hold the same rows, each as often."""
    columns = sorted(a.columns)
    return a.select(*columns).exceptAll(b.select(*columns)).isEmpty() and b.select(*columns).exceptAll(a.select(*columns)).isEmpty()
