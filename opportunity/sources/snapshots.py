"""Snapshots: tables that are written once, with a manifest, and read back only unchanged."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opportunity.quality import QualityError, table_fingerprint
from opportunity.sources.readers import require_columns


def write_snapshot(df: DataFrame, root: str, label: str) -> str:
    """Writes ``df`` under ``root/label`` and a manifest row beside it; never overwrites.

    The hash is of what was written, not of the plan, so a rerun of a lost task cannot differ from it.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{label}"
    df.write.mode("errorifexists").parquet(f"{path}/data")
    stored = spark.read.parquet(f"{path}/data")
    digest = table_fingerprint(stored)
    manifest = stored.agg(F.count("*").alias("rows")).select(F.lit(label).alias("label"), "rows", F.array(*[F.lit(c) for c in stored.columns]).alias("fields"), F.lit(digest).alias("fingerprint"))
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return digest


def read_verified(spark: SparkSession, root: str, label: str, required: Iterable[str] = (), allow_empty: bool = False) -> DataFrame:
    """The snapshot's table, if its content still has the manifest's hash."""
    path = f"{root.rstrip('/')}/{label}"
    manifest = spark.read.parquet(f"{path}/manifest").first()
    stored = require_columns(spark.read.parquet(f"{path}/data"), required)
    if table_fingerprint(stored) != manifest.fingerprint:
        raise QualityError(f"snapshot {label} has changed since it was written")
    if not manifest.rows and not allow_empty:
        raise QualityError(f"snapshot {label} is empty")
    return stored
