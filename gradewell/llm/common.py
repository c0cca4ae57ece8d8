"""Shared small helpers: scratch tables, packages on executors, Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, ship_package


try:
    LIBC = ctypes.CDLL("libc.so.6")
    LIBC.malloc_trim  # noqa: B018 - glibc only
except (OSError, AttributeError):
    LIBC = None

#: Bytes of text that Python code inside tasks works on at once; its arrays take some 100 times that.
SLICE = 1 << 18


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with this package importable on executors whatever their path is, and with
    Arrow batches of at most 4 MB (or one row): a task's memory doesn't grow with the texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def give_back(tokenizer: bool = False) -> None:
    """Return memory that earlier batches and stages took to the system. Python workers live
    through many tasks; without this their allocators keep what the largest one took. Compiled
    tokenizer states stay only for tasks that use them."""
    compiled = sys.modules.get("gradewell.llm.bpe_transducer")
    if compiled is not None and not tokenizer:
        compiled.forget()
    gc.collect()
    trim()


def trim() -> None:
    """Give free memory back without a search for garbage: at the end of short tasks."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, deleted when the application ends."""
    return scratch_dir(spark, f"llm-{name}")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read from there: cuts lineage, and
    survives the loss of the executors that made them."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    column = batch.column(name)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return [b"" if t is None else t for t in column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def runs(sizes: list[int], most: int):
    """Index ranges of consecutive rows, closed once their sizes sum to ``most``."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)
