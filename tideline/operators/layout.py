"""Storage layout measures: restart points, prefix sharing, block sizes and cuts, key shortening, filters, checksums, log fragments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.kvlog import write_block
from .write import varint_length

# Fixed values of the storage layout.
RESTART_INTERVAL, BLOCK_BYTES = 16, 4096
LOG_BLOCK, LOG_HEADER = 32768, 7


def _in_order(partition: str) -> Window:
    return Window.partitionBy(partition).orderBy("key", "value")


def restart_points(entries: DataFrame, group: str, interval: int = RESTART_INTERVAL) -> DataFrame:
    """Restart and offset within it of each entry (group, key, value) of a sorted run."""
    place = F.row_number().over(_in_order(group)).cast("long") - 1
    return entries.withColumn("_p", place).withColumns({"restart": F.floor(F.col("_p") / interval), "offset": F.col("_p") % interval}).drop("_p")


def _at(key: Column, place: Column) -> Column:
    """The byte at a 1-based place, as binary."""
    return F.substring(key, place, F.lit(1))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes two binary keys share from the left; none with a null."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    first = F.array_position(F.transform(_places(n), lambda i: _at(a, i) != _at(b, i)), True)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.when(first == 0, n).otherwise(first - 1)).otherwise(0).cast("long")


def shared_prefixes(entries: DataFrame, group: str) -> DataFrame:
    """Each binary key with its predecessor and the bytes they share."""
    before = F.lag("key").over(_in_order(group))
    return entries.withColumn("prev", before).withColumn("shared", F.when(F.col("prev").isNull(), F.lit(0)).otherwise(common_prefix(F.col("prev"), F.col("key"))).cast("long"))


def encoded_size(shared: Column) -> Column:
    """Bytes of a block entry with so much of the key shared. A null value, that of a delete, is empty."""
    rest, value = F.octet_length("key") - shared, F.coalesce(F.octet_length("value"), F.lit(0))
    return (varint_length(shared) + varint_length(rest) + varint_length(value) + rest + value).cast("long")


def block_sizes(entries: DataFrame, group: str, per_block: int = 64, interval: int = RESTART_INTERVAL) -> DataFrame:
    """Bytes of blocks of so many entries: the entries, 4 bytes a restart, 4 for their number."""
    place = F.row_number().over(_in_order(group)).cast("long") - 1
    rows = shared_prefixes(entries, group).withColumn("_p", place).withColumn("block", F.floor(F.col("_p") / per_block))
    shared = F.when((F.col("_p") % per_block) % interval == 0, F.lit(0).cast("long")).otherwise(F.col("shared"))
    size = encoded_size(shared)
    return rows.withColumn("_b", size).groupBy(group, "block").agg(F.count("*").alias("entries"), (F.sum("_b") + 4 * F.ceil(F.count("*") / interval) + 4).cast("long").alias("bytes"))


def _cut(keys: list[bytes], values: list[bytes], block_bytes: int, interval: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted entries that make a block: it closes after the entry that brings its size, with restarts and
    their number, to block_bytes."""
    first, held, last = 0, 0, b""
    for i, (key, value) in enumerate(zip(keys, values, strict=True)):
        shared = 0 if (i - first) % interval == 0 else codec.shared(last, key)
        held += sum(map(codec.varint_size, (shared, len(key) - shared, len(value)))) + len(key) - shared + len(value)
        last = key
        if held + 4 * -(-(i - first + 1) // interval) + 4 >= block_bytes or i == len(keys) - 1:
            yield first, i + 1
            first, held = i + 1, 0


def _sorted(part: pa.Table) -> tuple[list[bytes], list[bytes]]:
    rows = sorted(zip(part["key"].to_pylist(), (v or b"" for v in part["value"].to_pylist()), strict=True))
    return [k for k, _ in rows], [v for _, v in rows]


def blocks(entries: DataFrame, group: str, block_bytes: int = BLOCK_BYTES, interval: int = RESTART_INTERVAL) -> DataFrame:
    """The encoded blocks of each sorted run (group, key, value; binary): group, block, entries, bytes, crc, first_key,
    last_key. The checksum is over the block and its type byte, as it stands in a file. A run is one table file, whose
    size is bounded by the store; it goes through one task."""

    def fold(part: pa.Table) -> pa.Table:
        keys, values = _sorted(part)
        out = []
        for a, b in _cut(keys, values, block_bytes, interval):
            data = write_block(list(zip(keys[a:b], values[a:b], strict=True)), interval)
            out.append((part[group][0].as_py(), len(out), b - a, len(data), codec.crc32(data + b"\0"), keys[a], keys[b - 1]))
        return pa.table([pa.array(c) for c in zip(*out, strict=True)], names=[group, "block", "entries", "bytes", "crc", "first_key", "last_key"])

    kind = dict(entries.dtypes)[group]
    rows = entries.select(group, F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return rows.groupBy(group).applyInArrow(fold, f"{group} {kind}, block long, entries long, bytes long, crc long, first_key binary, last_key binary")


def block_cuts(entries: DataFrame, group: str, block_bytes: int = BLOCK_BYTES, interval: int = RESTART_INTERVAL) -> DataFrame:
    """Blocks of each sorted run by the writer's rule."""
    return blocks(entries, group, block_bytes, interval).drop("crc")


def separators(entries: DataFrame, group: str) -> DataFrame:
    """Shortest separators of neighbouring binary keys."""
    pairs = entries.select(group, "key").distinct().withColumn("prev", F.lag("key").over(Window.partitionBy(group).orderBy("key"))).filter("prev is not null")
    return pairs.select(group, F.col("prev").alias("start"), F.col("key").alias("limit"), separator(F.col("prev"), F.col("key")).alias("separator"))


def _number(byte: Column) -> Column:
    return F.conv(F.hex(byte), 16, 10).cast("int")


def _raised(byte: Column) -> Column:
    return F.unhex(F.lpad(F.hex(_number(byte) + 1), 2, "0"))


def separator(start: Column, limit: Column) -> Column:
    """codec.separator on binary columns: cut at the first difference, one added to its byte, if that stays below limit's."""
    d = (common_prefix(start, limit) + 1).cast("int")
    a, b = _at(start, d), _at(limit, d)
    fits = (d <= F.octet_length(start)) & (d <= F.octet_length(limit)) & (_number(a) < 255) & (_number(a) + 1 < _number(b))
    return F.when(fits, F.concat(F.substring(start, F.lit(1), d - 1), _raised(a))).otherwise(start)


def successor(key: Column) -> Column:
    """codec.successor on a binary column: the first byte below 0xff raised, the rest cut."""
    first = F.array_position(F.transform(_places(F.octet_length(key)), lambda i: _at(key, i) != F.unhex(F.lit("FF"))), True).cast("int")
    return F.when(first > 0, F.concat(F.substring(key, F.lit(1), first - 1), _raised(_at(key, first)))).otherwise(key)


def bloom_probe(members: DataFrame, probes: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """Whether the filter of its group may hold each probe. members, probes: group, key (binary). A filter is that of one
    table file; its members and its probes meet in one task, and are hashed all at once."""

    def probe(held: pa.Table, asked: pa.Table) -> pa.Table:
        bloom = codec.bloom_build(sorted(set(held["key"].to_pylist())), bits_per_key) if len(held) else b""
        found = codec.bloom_match_many(bloom, asked["key"].to_pylist())
        return asked.append_column("may_hold", pa.array(found, pa.bool_()))

    kind = dict(members.dtypes)["group"]
    both = [x.select("group", F.col("key").cast("binary").alias("key")) for x in (members, probes)]
    return both[0].distinct().groupBy("group").cogroup(both[1].groupBy("group")).applyInArrow(probe, f"group {kind}, key binary, may_hold boolean")


def log_fragments(records: DataFrame, group: str) -> DataFrame:
    """Fragments of each log's records (group, ordinal, bytes): type, payload and offset in the file.

    A fragment never crosses a 32 KiB block; fewer than 7 bytes at its end are padding. A log goes through one task."""

    def fold(part: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(part["ordinal"]), kind="stable")
        ordinals, sizes = np.asarray(part["ordinal"])[order].tolist(), np.asarray(part["bytes"])[order].tolist()
        out, at = [], 0
        for ordinal, left in zip(ordinals, sizes, strict=True):
            number = 0
            while number == 0 or left:
                room = LOG_BLOCK - at % LOG_BLOCK
                if room < LOG_HEADER:
                    at, room = at + room, LOG_BLOCK
                take = min(left, room - LOG_HEADER)
                left -= take
                kind = ("FULL" if not left else "FIRST") if not number else ("LAST" if not left else "MIDDLE")
                out.append((part[group][0].as_py(), ordinal, number, kind, take, at))
                at, number = at + LOG_HEADER + take, number + 1
        return pa.table([pa.array(c) for c in zip(*out, strict=True)], names=[group, "ordinal", "fragment", "type", "payload", "file_offset"])

    kind = dict(records.dtypes)[group]
    return records.groupBy(group).applyInArrow(fold, f"{group} {kind}, ordinal long, fragment long, type string, payload long, file_offset long")
