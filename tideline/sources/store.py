"""Writing folders of byte-format files: tables and logs from DataFrames, manifest, CURRENT.

Executors encode, a file a row; files are of MAX_FILE_BYTES or so, and the driver hands them to the store one by one. The
order is that of a store that may stop at any time: tables and logs first, then the manifest, then CURRENT, which names
it, by a rename."""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import manifest
from ..operators.order import Ranges
from ..operators.write import entry_size
from . import kvlog
from .files import HadoopFiles, MemoryFiles

Files = HadoopFiles | MemoryFiles
_FILE = "content binary, smallest binary, largest binary, last long"


def table_name(number: int) -> str:
    return f"{number:06d}.ldb"


def log_name(number: int) -> str:
    return f"{number:06d}.log"


def _encoded(rows: DataFrame, encode) -> DataFrame:
    """A row a range: encode(rows) gives the row's values for the entries (k, seq, op, v) of the range, in any order."""
    schema = pa.schema([("content", pa.binary()), ("smallest", pa.binary()), ("largest", pa.binary()), ("last", pa.int64())])

    def one(group: pa.Table) -> pa.Table:
        held = [(bytes(k), s, o, bytes(v or b"")) for k, s, o, v in zip(*(group[c].to_pylist() for c in ("k", "seq", "op", "v")), strict=True)]
        return pa.table([pa.array([v], f.type) for v, f in zip(encode(held), schema, strict=True)], schema=schema)

    return rows.select("_range", "k", "seq", "op", "v").groupBy("_range").applyInArrow(one, _FILE)


def write_tables(files: Files, entries: DataFrame, first: int, file_bytes: int = manifest.MAX_FILE_BYTES, **options) -> list[tuple[int, int, bytes, bytes, int]]:
    """(number, bytes, smallest, largest, last sequence) of the tables, numbered from first on, that hold entries (k, seq,
    op, v) in order of key, newest first. options: those of kvlog.write_table."""
    rows = entries.select("k", "seq", "op", F.coalesce("v", F.lit(b"")).alias("v"))
    size = rows.agg(F.sum(entry_size(F.octet_length("k"), F.octet_length("v")))).first()[0] or 0
    ranges = Ranges(rows, "k", count=int(size // file_bytes) + 1)

    def encode(held: list[tuple]) -> tuple:
        keys = [(codec.internal_key(k, s, o), v) for k, s, o, v in sorted(held, key=lambda r: (r[0], -r[1], -r[2]))]
        return kvlog.write_table(keys, **options), keys[0][0], keys[-1][0], max(r[1] for r in held)

    out = []
    # A key stays whole, as a level's tables must not share one.
    for r in _encoded(rows.withColumn("_range", ranges.column()), encode).toLocalIterator():
        files.write(table_name(first + len(out)), bytes(r.content))
        out.append((first + len(out), len(r.content), bytes(r.smallest), bytes(r.largest), r.last))
    return sorted(out, key=lambda f: kvlog._place(f[2]))


def write_logs(files: Files, entries: DataFrame, first: int, logs: int = 1, batch_rows: int = 100) -> list[tuple[int, int]]:
    """(number, last sequence) of the logs, numbered from first on, that hold entries (k, seq, op, v) in order of sequence;
    sequences without a gap share a batch."""
    ranges = Ranges(entries, "seq", count=logs)
    def encode(held: list[tuple]) -> tuple:
        records, batch, start = [], [], None
        for k, s, o, v in sorted(held, key=lambda r: (r[1], -r[2])):
            if batch and (s != start + len(batch) or len(batch) == batch_rows):
                records.append(kvlog.write_batch(start, batch))
                batch = []
            start = start if batch else s
            batch.append((o, k, v if o else b""))
        records.append(kvlog.write_batch(start, batch))
        return kvlog.write_log(records), b"", b"", max(r[1] for r in held)

    out = []
    for r in _encoded(entries.withColumn("_range", ranges.column()), encode).orderBy("last").toLocalIterator():
        files.write(log_name(first + len(out)), bytes(r.content))
        out.append((first + len(out), r.last))
    return out


def write_manifest(files: Files, number: int, edits: list[kvlog.Edit]) -> None:
    """A manifest of these edits, and CURRENT naming it."""
    name = f"MANIFEST-{number:06d}"
    files.write(name, kvlog.write_log([e.encode() for e in edits]))
    files.write("CURRENT", name.encode() + b"\n")


def write_history(files: Files, events: DataFrame, first: int, file_bytes: int = manifest.MAX_FILE_BYTES) -> int:
    """File events (edit_no, level, number, kind, file_size, smallest, largest) as manifests, numbered from first on, in order
    of edit_no, deletes before adds; returns how many there are. Each event is an edit that has edit_no as its last sequence.

    However long the history, each of its manifests is of file_bytes or so, encoded and read by a task of its own, and the
    driver holds one at a time. A store opens from a single manifest, so there is no CURRENT."""
    names = ["edit_no", "level", "number", "kind", "file_size", "smallest", "largest"]
    rows = events.select(*names)
    # Header, tags and level, three numbers of 64 bits at most, two slices.
    bound = 40 + F.coalesce(F.octet_length("smallest") + F.octet_length("largest"), F.lit(0))
    ranges = Ranges(rows, "edit_no", "kind", "level", "number", count=int((rows.agg(F.sum(bound)).first()[0] or 0) // file_bytes) + 1)
    places = pa.schema([("place", pa.int32()), ("content", pa.binary())])

    def encode(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("edit_no", "kind", "level", "number")])
        made = (
            (kvlog.Edit(last_sequence=no, added=[(level, n, size, bytes(low), bytes(high))]) if kind else kvlog.Edit(last_sequence=no, deleted=[(level, n)])).encode()
            for no, level, n, kind, size, low, high in zip(*(group[c].to_pylist() for c in names), strict=True)
        )
        return pa.table([group["_range"][:1].cast(pa.int32()), pa.array([kvlog.write_log(made)], pa.binary())], schema=places)

    # Held on the executors' disks: a local iterator alone would have one partition encoded at a time.
    encoded = rows.withColumn("_range", ranges.column()).groupBy("_range").applyInArrow(encode, "place int, content binary").persist(StorageLevel.DISK_ONLY)
    try:
        written = encoded.count()
        for r in encoded.toLocalIterator():  # a range's place gives the manifest's number
            files.write(f"MANIFEST-{first + r.place:06d}", bytes(r.content))
    finally:
        encoded.unpersist()
    return written


def write_store(files: Files, tables: DataFrame, tail: DataFrame, level: int = 1, comparator: str = "bytewise", **options) -> kvlog.Edit:
    """A whole store: tables of one level, logs of what came after them, manifest and CURRENT; returns its state."""
    made = write_tables(files, tables, 1, **options)
    logs = write_logs(files, tail, len(made) + 1)
    following = len(made) + len(logs) + 1
    last = max([s for *_, s in made], default=0)
    edit = kvlog.Edit(comparator, len(made) + 1, following + 1, last, 0, added=[(level, n, size, low, high) for n, size, low, high, _ in made])
    write_manifest(files, following, [edit])
    return edit


def snapshot(files: Files, state: kvlog.Edit, number: int) -> None:
    """The state as a manifest of one edit, and CURRENT on it; older manifests may go then."""
    write_manifest(files, number, [state])
