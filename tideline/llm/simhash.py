"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints at most 4 bits apart agree on one of five blocks of bits at least, so each distinct fingerprint goes to
five groups, one for each block's value, and all links lie within groups. A group too large for a task is split
again in the same way on its remaining bits, which loses no link either. In a group the fingerprints are sorted by
Gray rank, so that neighbours share long bit patterns; every node of the tree above them keeps the bits all of its
leaves share, and holds only those its parent does not have. A search goes down from the root, adds up the differing
bits, and drops whole groups once they exceed the radius. Leaves that are already in one component are not compared
again: a group returns a spanning forest, not pairs. Forests meet in distributed connected components.

Defined results. Null and blank texts have fingerprint zero, which links like any other. A null id never is a
component id unless all ids of a component are null. Repeated rows are equal fingerprints and share a component.
Empty tables give empty results. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, saved, table, tasks
from .components import components
from .words import _LOWER, batch_bytes, separators, text_parts, word_spans

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Rows of a group before it is split on its other bits; rows of a task; children of a node of the tree.
GROUP_ROWS, TASK_ROWS, FAN = 200_000, 1_000_000, 8
_PART_BYTES = 1 << 21
U64 = np.uint64


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, A-Z lower-cased, and where each begins."""
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(at[-1], 32, np.uint8)
    source = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, int)
    out[np.arange(len(source)) + np.repeat(np.arange(len(sizes)), sizes)] = _LOWER.astype(np.uint8)[data[source]]
    return out, at


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit integers."""
    data, offsets = batch_bytes(column)
    starts, ends, first = word_spans(data, offsets, separators("blank"))
    flat, at = joined_words(data, starts, ends)
    words = np.diff(first)
    counts = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    span = np.repeat(np.minimum(words, shingle), counts)
    view, digest = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[begin + span] - 1).tolist(), strict=True)], U64)
    out = np.zeros(len(counts), U64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.concatenate([[0], np.cumsum(counts[some])])
        set_bits = np.stack([bits[a:b].sum(0, dtype=np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)])
        out[some] = np.packbits(set_bits * 2 > counts[some][:, None], axis=1, bitorder="little").view(U64).ravel()
    return out.view(np.int64)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in text_parts(texts, _PART_BYTES):
                yield pa.record_batch([ids[i:j], pa.array(fingerprints(texts[i:j]))], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(lean(each), f"id {source.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> U64(shift))
    return code


class GrayIndex:
    """Trees over many groups at once; groups are runs of equal keys. Level 0 holds the fingerprints themselves."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(codes), keys))
        self.order, keys, value = order, keys[order], codes[order]
        mask = np.full(len(value), ~U64(0))
        self.values, self.masks, self.child = [value], [mask], []
        while True:
            new = np.empty(len(keys), bool)
            new[:1] = True
            new[1:] = keys[1:] != keys[:-1]
            if new.all():
                break
            begins = np.flatnonzero(new)
            place = np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))
            heads = np.flatnonzero(place % fan == 0)
            lead = np.repeat(value[heads], np.diff(np.append(heads, len(keys))))
            mask = np.bitwise_and.reduceat(mask & ~(value ^ lead), heads)
            value, keys = value[heads], keys[heads]
            self.child.append(np.append(heads, len(place)))
            self.values.append(value)
            self.masks.append(mask)
        # Where the leaves of each node begin, level by level.
        self.leaf = [np.arange(len(self.values[0]) + 1)]
        for child in self.child:
            self.leaf.append(self.leaf[-1][child])

    def near(self, queries: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query leaf, later leaf) within the radius that are not of one component yet."""
        top = len(self.child)
        codes = self.values[0]
        node = np.searchsorted(self.leaf[top], queries, "right") - 1
        far = np.bitwise_count((codes[queries] ^ self.values[top][node]) & self.masks[top][node]).astype(np.int64)
        q = queries
        for level in range(top, -1, -1):
            edge = self.leaf[level]
            low = np.minimum.reduceat(label, edge[:-1])
            same = np.where(low == np.maximum.reduceat(label, edge[:-1]), low, -1)
            keep = (far <= radius) & (edge[node + 1] > q + 1) & (same[node] != label[q])
            q, node, far = q[keep], node[keep], far[keep]
            if not level:
                later = node > q
                return q[later], node[later]
            child = self.child[level - 1]
            sizes = child[node + 1] - child[node]
            up = np.repeat(node, sizes)
            node = np.repeat(child[node] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else node
            q, far = np.repeat(q, sizes), np.repeat(far, sizes)
            rest = self.masks[level - 1][node] & ~self.masks[level][up]
            far = far + np.bitwise_count((codes[q] ^ self.values[level - 1][node]) & rest)
        raise AssertionError

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, codes of their roots) of all leaves that hang on another one."""
        n = len(self.values[0])
        label, at, step = np.arange(n), 0, 64
        while at < n:
            a, b = self.near(np.arange(at, min(n, at + step)), radius, label)
            while len(a):
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
                while (label != label[label]).any():
                    label = label[label]
            at, step = at + step, min(step * 2, 4096)
        hung = label != np.arange(n)
        return self.values[0][hung], self.values[0][label[hung]]


def _block(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_keys(codes: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, fp): each fingerprint under radius+1 keys, one of which it shares with every fingerprint in the radius."""
    fp = F.col("fp")
    cuts = _blocks(64, radius + 1)
    first = codes.select(fp, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _block(fp, *cut).alias("v")) for i, cut in enumerate(cuts)])).alias("k"))
    first = first.select(F.xxhash64("k.i", "k.v").alias("key"), F.col("k.i").alias("i"), "fp")
    hot = saved(first.groupBy("key").count().filter(F.col("count") > group_rows).select("key"), "simhash-hot")
    if hot.isEmpty():
        return first.select("key", "fp")
    # Rotated so that the bits of the key go to the top; the others are cut into radius+1 blocks again.
    turned = F.coalesce(*[F.when(F.col("i") == i, F.shiftrightunsigned(fp, low + width).bitwiseOR(F.shiftleft(fp, 64 - low - width)) if low + width < 64 else fp) for i, (low, width) in enumerate(cuts)])
    left = F.coalesce(*[F.when(F.col("i") == i, F.lit(64 - width)) for i, (_, width) in enumerate(cuts)])
    least = min(64 - width for _, width in cuts)
    inner = _blocks(least, radius + 1)
    inner = [(a, (64 if k == radius else b)) for k, (a, b) in enumerate(inner)]
    deep = first.join(hot, "key", "left_semi").withColumns({"turned": turned, "left": left})
    parts = [F.struct(F.lit(k).alias("k"), (_block(F.col("turned"), a, b) if b < 64 else F.expr(f"shiftrightunsigned(turned, {a}) & (shiftleft(1L, left - {a}) - 1)")).alias("v")) for k, (a, b) in enumerate(inner)]
    deep = deep.select("key", "fp", F.explode(F.array(*parts)).alias("p")).select(F.xxhash64("key", "p.k", "p.v").alias("key"), "fp")
    return first.join(hot, "key", "left_anti").select("key", "fp").unionByName(deep)


def links(codes: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): a spanning forest of the links of each group of distinct fingerprints."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if rows:
            keys, fps = (np.concatenate(x) for x in zip(*rows, strict=True))
            if len(keys):
                a, b = GrayIndex(keys, fps.view(U64)).forest(radius)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    spark = codes.sparkSession
    keyed = block_keys(codes, radius, group_rows)
    parts = max(tasks(spark), (radius + 1) * codes.count() // TASK_ROWS + 1)
    return keyed.repartition(parts, "key").mapInArrow(lean(each), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the least id reachable over links."""
    rows = saved(fingerprint_rows(docs, id_col, text), "simhash-rows")
    classes = saved(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius, group_rows))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
