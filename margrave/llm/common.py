"""Helpers shared by the corpus operators: tables, the shared folder, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

#: The six ASCII white-space characters that separate words: [\x20\x09-\x0D].
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written under the shared folder, so that no later job depends on shuffle files of lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/margrave/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{name}-{self.count}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            self._delete(df.scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run within hand at most so many rows at once to Python, which bounds memory where a row is large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: The operator whose tasks this worker process ran last, and what empties the caches that they left.
_KEPT: list[tuple[str, Callable[[], None]]] = []


def worker_of(operator: str, empty: Callable[[], None] = lambda: None) -> None:
    """At the start of a Python task: Spark reuses worker processes, so what another operator's tasks kept here is given back first.

    empty: empties what this operator's tasks keep from one to the next.
    """
    if _KEPT and _KEPT[-1][0] != operator:
        import pyarrow as pa

        _KEPT.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    _KEPT[:] = [(operator, empty)]


def text_of(column: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ([^\\x20\\x09-\\x0D]+) of a text; none for an empty text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once a row: a lambda variable isn't inlined as an alias may be."""
    return F.transform(F.array(value), use)[0]


def fingerprint(*columns: Column) -> list[Column]:
    """Two 64-bit hashes with independent seeds, h1 and h2: together a 128-bit fingerprint."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("margrave"), *columns).alias("h2")]
