"""Shared pieces: table access, the shared work folder, stage cuts and size checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows up to which a side may be broadcast; the count is always taken first.
BROADCAST_ROWS = 200_000
#: Bytes up to which a side of wide rows may be broadcast; their sum is always taken first.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches for what is run inside, so that Python workers stay small next to a full heap."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """Return memory that is free in this Python worker to the machine: the worker stays for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: What this Python worker holds for the next task of the same work.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """``make()``, held in this Python worker under ``name`` until a task of other work begins."""
    if name not in _KEPT:
        let_go()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """Drop what ``kept`` holds, and give its memory back with what earlier stages have left."""
    _KEPT.clear()
    give_back()


def giving_back(work: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a task, with free memory given back at its end.

    Only work that ``keeps`` finds again what earlier tasks of this worker have ``kept``.
    """

    @wraps(work)
    def mapped(batches: Iterator) -> Iterator:
        if _KEPT and not keeps:
            let_go()
        try:
            yield from work(batches)
        finally:
            give_back()

    return mapped


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back: what follows survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose row count was checked; beyond the bound Spark shuffles it."""
    return F.broadcast(df) if small(df, rows) else df


def light(df: DataFrame, column: str, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written side has at most ``size`` bytes in ``column``, which holds nearly all of them."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first().n <= size


def broadcast_if_light(df: DataFrame, column: str, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written side whose bytes were summed first."""
    return F.broadcast(df) if light(df, column, size) else df


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def beside_texts(rows: DataFrame, begin: Callable[[], Callable[[list], dict[str, list]]], added: str) -> DataFrame:
    """The columns of ``rows`` but ``text``, and the ``added`` ones (a schema) that a batch's texts give.

    ``begin`` is called once a task. The other columns stay in Arrow: pandas would hold 64-bit ids
    beside a null as doubles and lose their last bits.
    """
    kept = [c for c in rows.columns if c != "text"]
    new = StructType.fromDDL(added)
    fields = to_arrow_schema(new)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for batch in batches:
            made = work(batch.column("text").to_pylist())
            columns = [*(batch.column(c) for c in kept), *(pa.array(made[f.name], f.type) for f in fields)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *fields.names])
            del made, columns

    return rows.mapInArrow(giving_back(mapped), StructType([*rows.select(*kept).schema.fields, *new.fields]))
