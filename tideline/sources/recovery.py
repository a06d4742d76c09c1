"""Opening a folder of byte-format files: CURRENT, manifest, logs and tables become one change log.

CURRENT names the manifest; its edits are replayed to the live tables and the counters; live tables must be on disk;
logs at or above the manifest's log number (or equal to the one before it) are replayed in order of number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import Corruption
from ..operators import manifest
from . import kvlog

COMPARATOR = "bytewise"


@dataclass
class Recovered:
    entries: DataFrame
    files: DataFrame
    log_number: int
    prev_log: int
    next_file: int
    last_sequence: int


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of the folder: path, name, number, type, length."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").withColumn("name", F.element_at(F.split("path", "/"), -1))
    number, kind = manifest.parse_name(F.col("name"))
    return files.withColumns({"number": number, "type": kind})


def _content(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise Corruption(f"{path} is missing")
    return bytes(row.content)


def manifest_name(spark: SparkSession, path: str) -> str:
    current = _content(spark, f"{path}/CURRENT")
    if not current.endswith(b"\n"):
        raise Corruption("CURRENT doesn't end in a newline")
    return current[:-1].decode()


def read_edits(spark: SparkSession, path: str) -> list[kvlog.Edit]:
    """The manifest's edits, on the driver: they describe files, not data."""
    return [kvlog.Edit.decode(r) for r in kvlog.read_log(_content(spark, f"{path}/{manifest_name(spark, path)}"))]


def snapshot_edit(edits: list[kvlog.Edit]) -> kvlog.Edit:
    """One edit with the state after all: last scalar that is given, last pointer of a level, live files in order."""
    out, pointers, live = kvlog.Edit(), {}, {}
    for e in edits:
        for name in ("comparator", *kvlog.Edit.SCALARS.values()):
            if getattr(e, name) is not None:
                setattr(out, name, getattr(e, name))
        pointers |= dict(e.pointers)
        for level, number in e.deleted:
            live.pop((level, number), None)
        live |= {(f[0], f[1]): f for f in e.added}
    out.pointers, out.added = sorted(pointers.items()), sorted(live.values(), key=lambda f: (f[0], f[3], f[1]))
    return out


def recover(spark: SparkSession, path: str) -> Recovered:
    path = path.rstrip("/")
    state = snapshot_edit(read_edits(spark, path))
    if state.comparator not in (None, COMPARATOR):
        raise Corruption(f"keys are ordered {state.comparator}, not {COMPARATOR}")
    for name in ("next_file", "log_number", "last_sequence"):
        if getattr(state, name) is None:
            raise Corruption(f"the manifest has no {name}")
    prev = state.prev_log or 0
    files = spark.createDataFrame([tuple(f) for f in state.added], "level int, number long, file_size long, smallest binary, largest binary")
    there = listing(spark, path).filter("number is not null")
    missing = [r.number for r in manifest.missing_files(files, there).collect()]
    if missing:
        raise Corruption(f"live tables are missing: {sorted(missing)}")
    live = {f[1] for f in state.added}
    rows = there.filter("type in ('log', 'table')").select("path", "number", "type").collect()
    logs = sorted(int(r.number) for r in rows if r.type == "log" and (r.number >= state.log_number or r.number == prev))
    paths = {int(r.number): r.path for r in rows}
    empty = spark.createDataFrame([], kvlog.ENTRY)
    tables = kvlog.scan_tables(spark, [paths[n] for n in sorted(live)]) if live else empty
    tail = kvlog.scan_logs(spark, [paths[n] for n in logs]) if logs else empty
    last = tail.agg(F.max("seq")).first()[0] or 0
    used = max([*live, *(int(r.number) for r in rows), 0])
    return Recovered(tables.unionByName(tail), files, state.log_number, prev, max(state.next_file, used + 1), max(state.last_sequence, last))
