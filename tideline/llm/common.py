"""Shared plumbing: scratch tables in the shared folder, lineage cuts, and memory that workers give back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"

#: Paths made since the outermost scope was entered; None outside of scopes.
_scope: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it. In local mode, where driver and executors are one
    process, a folder of our own if none is named; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/tideline/{label}-{uuid.uuid4().hex}"
    for paths in _scope[-1:]:
        paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the scratch tables made within: for callers that have written their result by then."""
    _scope.append([])
    try:
        yield
    finally:
        for path in _scope.pop():
            remove(spark, path)


#: Settings while a table is written: shuffle files go as soon as it is, as nothing reads them afterwards; Arrow batches
#: of texts stay small on both sides, whatever the length of the texts.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write df as Parquet."""
    with settings(df.sparkSession, WRITING):
        df.write.mode(mode).parquet(path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_given: list[float] = [0.0]


def give_back(every: float = 0.0) -> None:
    """Return the memory of dropped arrays to the system; workers are used again by later stages. Not again within
    so many seconds."""
    if time.monotonic() < _given[0] + every:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass
    _given[0] = time.monotonic()


#: What a worker keeps for the next partitions of the same stage, at most one thing.
_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What make gives, kept in the worker until a function of another stage begins there."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _begin(keep: str | None) -> None:
    if _kept and keep not in _kept:
        _kept.clear()
        give_back()


def lean(each: Callable[[Iterator], Iterator], keep: str | None = None) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back when its partition ends, but for what is kept under a key."""

    def run(batches: Iterator) -> Iterator:
        _begin(keep)
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def lean_group(each: Callable) -> Callable:
    """The same for a function over one group, or over one group of each of two tables."""

    def one(group: pa.Table) -> pa.Table:
        _begin(None)
        try:
            return each(group)
        finally:
            give_back(3.0)

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        _begin(None)
        try:
            return each(left, right)
        finally:
            give_back(3.0)

    return two if each.__code__.co_argcount == 2 else one


def tasks(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(wanted: str, *taken: list[str]) -> str:
    """A column name that no list holds, in any case."""
    used = {c.lower() for names in taken for c in names}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
