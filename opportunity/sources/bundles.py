"""Bundles of tables under one hash tree, so that a changed part is named and read alone.

A table's rows are dealt into parts by a hash of its key. A part's hash is made of its rows in any order, a
table's of its parts, the bundle's of its tables and parameters. Parts are folders, so those that two trees
tell apart can be read without the others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from opportunity.quality import QualityError
from opportunity.sources.readers import require_columns

#: Parts of a table.
PARTS = 64


def part_of(columns: Sequence[str], parts: int = PARTS) -> Column:
    """The part of a row: the first 32 bits of a hash of its key's text, modulo ``parts``. Null and empty text differ."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % parts).cast("int")


def part_hashes(df: DataFrame, keys: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Q6: part, rows and digest of each part that has rows, from sums of the rows' hashes."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    rows = df.select(part_of(keys, parts).alias("part"), digest.alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"_h{k}") for k in range(8)]
    out = rows.groupBy("part").agg(F.count("*").alias("rows"), *words)
    return out.select("part", "rows", F.sha2(F.concat_ws("|", "rows", *[f"_h{k}" for k in range(8)]), 256).alias("digest"))


def bundle_tree(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], parts: int = PARTS) -> DataFrame:
    """Q6: table, part, rows and digest of all tables; a table without ``keys`` is dealt by all its columns."""
    found = [part_hashes(df, keys.get(name, sorted(df.columns)), parts).select(F.lit(name).alias("table"), "part", "rows", "digest") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, found)


def table_hashes(tree: DataFrame) -> dict[str, str]:
    """Q6: one hash a table, over its parts (PARTS rows a table at most)."""
    part = F.concat_ws(":", F.lpad(F.col("part").cast("string"), 10, "0"), "digest")
    rows = tree.groupBy("table").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256).alias("hash")).collect()
    return {r.table: r.hash for r in rows}


def bundle_hash(tables: Mapping[str, str], parameters: Mapping[str, object]) -> str:
    """Q6: the root: names and hashes of the tables, and parameters."""
    text = "|".join([*(f"{k}={v}" for k, v in sorted(tables.items())), *(f"{k}={v!r}" for k, v in sorted(parameters.items()))])
    return hashlib.sha256(text.encode()).hexdigest()


def tree_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q6: table, part and what happened to it (changed, missing or added), from two trees alone."""
    both = old.select("table", "part", F.col("digest").alias("_o")).join(new.select("table", "part", F.col("digest").alias("_n")), ["table", "part"], "full_outer")
    what = F.when(F.col("_n").isNull(), "missing").when(F.col("_o").isNull(), "added").when(F.col("_o") != F.col("_n"), "changed")
    return both.select("table", "part", what.alias("change")).filter("change is not null")


def write_bundle(tables: Mapping[str, DataFrame], root: str, label: str, keys: Mapping[str, Sequence[str]] | None = None, parts: int = PARTS, parameters: Mapping[str, object] | None = None) -> str:
    """Writes the tables, a folder for each part, their tree and a manifest under ``root/label``; never overwrites. Returns the root hash."""
    keys, parameters = keys or {}, parameters or {}
    spark, path = next(iter(tables.values())).sparkSession, f"{root.rstrip('/')}/{label}"
    for name, df in tables.items():
        own = keys.get(name, sorted(df.columns))
        # Rows of a part come from every task; a hot part is several files.
        df.withColumn("_part", part_of(own, parts)).write.mode("errorifexists").partitionBy("_part").parquet(f"{path}/data/{name}")
    held = {name: spark.read.schema(df.schema).parquet(f"{path}/data/{name}").select(*df.columns) for name, df in tables.items()}
    tree = bundle_tree(held, keys, parts)
    tree.write.mode("errorifexists").parquet(f"{path}/tree")
    digest = bundle_hash(table_hashes(spark.read.parquet(f"{path}/tree")), parameters)
    rows = [(label, digest, parts, name, ",".join(tables[name].columns), ",".join(keys.get(name, sorted(tables[name].columns))), tables[name].schema.json()) for name in sorted(tables)]
    spark.createDataFrame(rows, "label string, root string, parts int, table string, columns string, keys string, schema string").write.mode("errorifexists").parquet(f"{path}/manifest")
    return digest


def read_parts(spark: SparkSession, root: str, label: str, table: str, parts: Iterable[int] | None = None) -> DataFrame:
    """A table of a bundle, or only some of its parts, by their folders."""
    path = f"{root.rstrip('/')}/{label}"
    own = spark.read.parquet(f"{path}/manifest").filter(F.col("table") == table).first()
    if own is None:
        raise QualityError(f"bundle {label} has no table {table}")
    held = spark.read.schema(StructType.fromJson(json.loads(own.schema)).add("_part", IntegerType())).parquet(f"{path}/data/{table}")
    if parts is not None:
        held = held.filter(F.col("_part").isin([int(p) for p in parts]))
    return held.select(*own["columns"].split(","))


def bundle_differences(spark: SparkSession, root: str, label: str, only: Mapping[str, Iterable[int]] | None = None) -> DataFrame:
    """What the stored files no longer share with the stored tree. ``only`` names parts by table; others are not read."""
    path = f"{root.rstrip('/')}/{label}"
    manifest = spark.read.parquet(f"{path}/manifest").collect()  # a row a table
    tree, found = spark.read.parquet(f"{path}/tree"), []
    for row in manifest:
        if only is not None and row.table not in only:
            continue
        asked = None if only is None else sorted(only[row.table])
        now = part_hashes(read_parts(spark, root, label, row.table, asked), row["keys"].split(","), row.parts).withColumn("table", F.lit(row.table))
        before = tree.filter(F.col("table") == row.table)
        found.append(tree_differences(before if asked is None else before.filter(F.col("part").isin(asked)), now))
    return reduce(DataFrame.unionByName, found)


def read_bundle(spark: SparkSession, root: str, label: str, required: Mapping[str, Iterable[str]] | None = None, parameters: Mapping[str, object] | None = None, allow_empty: bool = False) -> dict[str, DataFrame]:
    """The tables of a bundle, if tree, parameters and every part are what was written; the error names one part."""
    path = f"{root.rstrip('/')}/{label}"
    manifest = spark.read.parquet(f"{path}/manifest").collect()  # a row a table
    hashes = table_hashes(spark.read.parquet(f"{path}/tree"))
    if bundle_hash(hashes, parameters or {}) != manifest[0].root:
        raise QualityError(f"the tree or the parameters of bundle {label} have changed")
    if found := bundle_differences(spark, root, label).limit(1).collect():
        raise QualityError(f"bundle {label}: part {found[0]['part']} of {found[0]['table']} is {found[0]['change']}")
    if not allow_empty and (empty := sorted({r.table for r in manifest} - set(hashes))):
        raise QualityError(f"bundle {label}: {empty[0]} is empty")
    return {r.table: require_columns(read_parts(spark, root, label, r.table), (required or {}).get(r.table, ())) for r in manifest}
