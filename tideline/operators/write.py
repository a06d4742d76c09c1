"""Write batches: operation counts, sequences, checks, appends and memtable accounting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions


def varint_length(n: Column) -> Column:
    """Bytes of a number as a varint: 7 bits a byte, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n.cast("long"))) / 7)).cast("long")


def entry_size(key_bytes: Column, value_bytes: Column) -> Column:
    """Encoded bytes of a memtable entry: both lengths as varints, the key with its 8-byte tag, the value."""
    return (varint_length(key_bytes + 8) + key_bytes + 8 + varint_length(value_bytes) + value_bytes).cast("long")


def batch_ops(ops: DataFrame) -> DataFrame:
    """Puts and deletes of each batch. ops: batch_id, op."""
    return ops.groupBy("batch_id").agg(F.count_if(F.col("op") == 1).alias("puts"), F.count_if(F.col("op") == 0).alias("deletes"))


def sequence_batches(ops: DataFrame, start: int, *order: str) -> DataFrame:
    """Ordinal of each operation in its batch and its sequence: batches in order of id, from start on."""
    ordinal = F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)).cast("long") - 1
    rows = positions(ops, "batch_id", *order, name="seq")
    return rows.withColumns({"ordinal": ordinal, "seq": (F.col("seq") + (start - 1)).cast("long")})


def count_mismatches(ops: DataFrame, declared: Column) -> DataFrame:
    """Batches whose declared count isn't what they hold."""
    got = ops.groupBy("batch_id").agg(F.max(declared).cast("long").alias("declared"), F.count("*").alias("found"))
    return got.filter("declared <> found")


def append_batches(target: DataFrame, more: DataFrame, order: str) -> DataFrame:
    """Operations of more after those of target, batch by batch; ordinals start from 0."""
    both = target.withColumn("_part", F.lit(0)).unionByName(more.withColumn("_part", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("_part", order)).cast("long") - 1
    return both.withColumn("ordinal", place).drop("_part")


def flush_cuts(entries: DataFrame, budget: int) -> DataFrame:
    """Flushes of each log: entries in order of seq are held until their bytes exceed the budget. entries: k, seq, bytes.

    The fold needs a log's entries in order; a log is one writer's, and goes through one task."""

    def fold(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group["seq"]), kind="stable")
        seq, size = np.asarray(group["seq"])[order], np.asarray(group["bytes"])[order]
        flush, held, number = np.empty(len(seq), np.int64), 0, 0
        for i, b in enumerate(size.tolist()):
            flush[i] = number
            held += b
            if held > budget:
                held, number = 0, number + 1
        head = np.flatnonzero(np.diff(flush, prepend=-1))
        return pa.table(
            {
                "k": pa.array([group["k"][0].as_py()] * len(head), group.schema.field("k").type),
                "flush": flush[head],
                "n": np.diff(np.append(head, len(seq))),
                "bytes": np.add.reduceat(size, head),
                "min_seq": seq[head],
                "max_seq": seq[np.append(head[1:], len(seq)) - 1],
            }
        )

    schema = f"k {dict(entries.dtypes)['k']}, flush long, n long, bytes long, min_seq long, max_seq long"
    return entries.select("k", "seq", "bytes").groupBy("k").applyInArrow(fold, schema)
