"""Snapshot reads over a change log (k, seq, op, v): op 1 puts, op 0 deletes; the greatest sequence of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import positions

FOUND, DELETED, NOT_FOUND = "FOUND", "DELETED", "NOT_FOUND"


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest entry of each key at or below the snapshot, deletes included."""
    rows = log if snapshot is None else log.filter(F.col("seq") <= snapshot)
    # The order of entries with one sequence is puts before deletes; sequence and op make one number (op is 0 or 1).
    rank = F.col("seq") * 2 + F.col("op")
    return rows.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("op", rank).alias("op"), F.max_by("v", rank).alias("v"))


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest live value of each key."""
    return newest(log, snapshot).filter("op = 1").select("k", "seq", "v")


def internal_order(log: DataFrame) -> DataFrame:
    """Position of every entry in the order key ascending, sequence descending, op descending."""
    return positions(log, "k", "-seq", "-op")


def get_status(log: DataFrame, targets: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Three-way result of a get for each key of targets (k)."""
    found = newest(log, snapshot)
    status = F.when(F.col("op").isNull(), NOT_FOUND).when(F.col("op") == 0, DELETED).otherwise(FOUND)
    return targets.join(found, "k", "left").select("k", status.alias("status"), F.when(F.col("op") == 1, F.col("v")).alias("v"))


def range_scan(log: DataFrame, low: object, high: object, snapshot: int | None = None) -> DataFrame:
    return latest(log.filter(F.col("k").between(low, high)), snapshot)


def reverse_scan(log: DataFrame) -> DataFrame:
    return positions(latest(log), "-k")


def first_last(log: DataFrame) -> DataFrame:
    """First and last entry in internal order; each is a top-1."""
    ends = {"first": [F.col("k").asc(), F.col("seq").desc(), F.col("op").desc()], "last": [F.col("k").desc(), F.col("seq").asc(), F.col("op").asc()]}
    parts = [log.orderBy(*o).limit(1).select(F.lit(n).alias("which"), "k", "seq", "op", "v") for n, o in ends.items()]
    return parts[0].unionByName(parts[1])


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Ordered union of sources (k, id) that keeps duplicates; equal keys come by source, then id."""
    rows = [s.select("k", F.lit(i).alias("src"), "id") for i, s in enumerate(sources)]
    merged = rows[0]
    for r in rows[1:]:
        merged = merged.unionByName(r)
    return positions(merged, "k", "src", "id")


def compaction(log: DataFrame, snapshot: int, drop_deletes: bool = False) -> DataFrame:
    """What a rewrite keeps for readers at the snapshot or later: all above it and the newest at or below it. With
    drop_deletes, for a rewrite with nothing older below it, that newest one goes if it is a delete."""
    below = newest(log, snapshot)
    if drop_deletes:
        below = below.filter("op = 1")
    return log.filter(F.col("seq") > snapshot).select("k", "seq", "op", "v").unionByName(below.select("k", "seq", "op", "v"))
