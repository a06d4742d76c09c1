"""Near copies by shingle similarity, beside the links of SimHash.

Two texts are linked if the sets of their 5-word shingles have a Jaccard similarity of SIMILARITY or more, or if their
SimHash fingerprints are linked as in operator 5. SimHash at 64 bits can't find the first: such pairs lie at 5 to 13
bits. Candidates come from MinHash: BANDS keys a text, each of ROWS minima, so that a pair at 0.8 shares no key with a
probability of 3 in a million (and less above). Every candidate is verified on the exact sets.

Candidates are not all pairs of a key. First each text of a key meets the key's pivot, another one by chance for each
key; what that links, with SimHash, becomes components. Then only pairs of a key whose components differ are looked at,
and of these only those are made that BITS-bit maps of their shingles allow: a bit that differs between two maps stands
for a shingle at least that just one of the texts has, so the bits bound the similarity from above and no link is lost. So a
cluster of many copies costs some comparisons a copy, and texts that share keys without being alike cost little more
than the bound.

A node is the 64-bit hash of a text. Sets are made again from the texts of candidates only and are never kept for all.
Texts of other nodes, and rows that stay, pass a broadcast filter of bounded size instead of a shuffle.

Defined results. Null and blank texts have no shingles and link by SimHash alone, so all of them are one component; texts of fewer than five words are one
shingle. Equal texts share a node. Null ids never are a component id unless all ids of a component are null. Empty
tables give empty results. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import free_name, lean, saved, tasks, text_or_empty
from .components import components
from .words import batch_bytes, gram_hashes, mix, separators, text_parts, word_hashes, word_spans

SHINGLE, SIMILARITY, BANDS, ROWS, BITS = 5, 0.8, 32, 5, 512
#: Rows of a task that groups keys; words of 64 bits that a filter has at most, keys that a word is meant for.
TASK_ROWS, FILTER_WORDS, WORD_KEYS = 2_000_000, 1 << 20, 2
_PART_BYTES = 1 << 20
U64 = np.uint64
_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, ascending; index of each text's first, with the end)."""
    data, offsets = batch_bytes(column)
    starts, ends, first = word_spans(data, offsets, separators("blank"))
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - SHINGLE + 1]) if b - a >= SHINGLE else gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return np.concatenate([grams[:0], *out]), np.cumsum([0, *map(len, out)])


def band_keys(grams: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(texts x BANDS) keys of the texts that have shingles."""
    head = edge[:-1][np.diff(edge) > 0]
    keys = np.empty((len(head), BANDS), U64)
    for band in range(BANDS):
        key = np.full(len(head), U64(band + 1))
        for turn in _TURNS[band * ROWS : (band + 1) * ROWS]:
            key = mix(key + np.minimum.reduceat(grams * turn, head)) if len(head) else key
        keys[:, band] = key
    return keys


def bit_maps(grams: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(texts x BITS/64) maps: whether the shingles at each of BITS places are odd in number."""
    place = np.repeat(np.arange(len(edge) - 1) * BITS, np.diff(edge)) + ((grams >> U64(7)) % U64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=(len(edge) - 1) * BITS) & 1).astype(bool)).view(np.int64).reshape(-1, BITS // 64)


def _sketches(source: DataFrame) -> DataFrame:
    """(id, row, node, fp, n, keys, bits) of every row of (id, row, node, text)."""

    names = ["id", "row", "node", "fp", "n", "keys", "bits"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_parts(batch.column(3), _PART_BYTES):
                texts = batch.column(3)[i:j]
                grams, edge = shingle_sets(texts)
                n = np.diff(edge)
                keys = pa.ListArray.from_arrays(np.cumsum([0, *(n > 0) * BANDS]).astype(np.int32), band_keys(grams, edge).view(np.int64).ravel())
                bits = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * (BITS // 64), bit_maps(grams, edge).ravel())
                yield pa.record_batch([*(batch.column(c)[i:j] for c in range(3)), pa.array(simhash.fingerprints(texts)), pa.array(n), keys, bits], names=names)

    return source.mapInArrow(lean(each), f"id {source.dtypes[0][1]}, row long, node long, fp long, n long, keys array<long>, bits array<long>")


def _members(sketches: DataFrame) -> DataFrame:
    """(key, node, n, pivot) of the nodes of all keys that two nodes or more share; each key has a pivot by chance."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not rows:
            return
        key, node, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((node, mix(node.view(U64) ^ mix(key.view(U64))), key))
        key, node, n = key[order], node[order], n[order]
        once = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(node) != 0)])
        key, node, n = key[once], node[once], n[once]
        head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        size = np.diff(np.append(head, len(key)))
        pivot, shared = np.repeat(node[head], size), np.repeat(size > 1, size)
        for a in range(0, len(key), 1 << 16):
            cut = [x[a : a + (1 << 16)][shared[a : a + (1 << 16)]] for x in (key, node, n, pivot)]
            yield pa.record_batch([pa.array(x) for x in cut], names=["key", "node", "n", "pivot"])

    parts = max(tasks(sketches.sparkSession), BANDS * sketches.count() // TASK_ROWS + 1)
    keyed = sketches.select(F.explode("keys").alias("key"), "node", "n").repartition(parts, "key")
    return keyed.mapInArrow(lean(each), "key long, node long, n long, pivot long")


def _word(key: Column, words: int) -> tuple[Column, Column]:
    """Which word of a filter a key has, and its three bits there."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int")) for at in (0, 6, 12)]
    return F.shiftrightunsigned(h, 32) % words, bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


class _Filter:
    """Bits of a set of keys, of bounded size and broadcast, so that rows of other keys need no shuffle. Some other keys
    pass as well, more of them once the set outgrows the bits: what passes is to be joined exactly."""

    def __init__(self, keys: DataFrame):
        self.words = min(FILTER_WORDS, keys.count() // WORD_KEYS + 1)
        word, bits = _word(F.col(keys.columns[0]), self.words)
        self.table = saved(keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), "near-filter")

    def join(self, rows: DataFrame, key: str, how: str) -> DataFrame:
        """Rows whose key may be in the set (left_semi) or is not (left_anti)."""
        word, bits = _word(rows[key], self.words)
        return rows.join(F.broadcast(self.table), (word == self.table.word) & (self.table.bits.bitwiseAND(bits) == bits), how)


def _alike(pairs: DataFrame, source: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are alike."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_parts(batch.column(1), _PART_BYTES):
                grams, edge = shingle_sets(batch.column(1)[i:j])
                yield pa.record_batch([batch.column(0)[i:j], pa.array([grams[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["node", "grams"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    nodes = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "near-nodes")
    texts = _Filter(nodes).join(source.select("node", "text"), "node", "left_semi").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    made = saved(texts.mapInArrow(lean(sets), "node long, grams binary"), "near-sets")
    a, b = (made.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(lean(verified), "a long, b long")


def _may_link(similarity: float) -> Column:
    """Whether sizes and maps of two sets (n_a, bits_a, n_b, bits_b) allow for the similarity."""
    apart = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col("bits_a")[0].bitwiseXOR(F.col("bits_b")[0])))
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (apart <= (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _allowed(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and maps allow for the similarity: sets need not be made for the others."""
    a, b = (maps.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits")]) for x in "ab")
    return pairs.join(a, "a").join(b, "b").filter(_may_link(similarity)).select("a", "b")


def _near_rows(source: DataFrame, similarity: float) -> DataFrame:
    """(id, row, node, root) of every row of (id, row, node, text); rows with one root are linked."""
    sketches = saved(_sketches(source), "near-sketches")
    # SimHash links between the least nodes of the fingerprints, and from each node to the least of its fingerprint.
    classes = saved(sketches.groupBy("fp").agg(F.min("node").alias("least")), "near-classes")
    a, b = (classes.select(F.col("fp").alias(x), F.col("least").alias(f"node_{x}")) for x in "ab")
    edges = simhash.links(classes.select("fp")).join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    edges = edges.unionByName(sketches.join(classes, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))

    members = saved(_members(sketches), "near-members")
    star = members.filter("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    maps = saved(sketches.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node"]), "near-maps")
    star = saved(_allowed(star.distinct(), maps, similarity), "near-pairs")
    roots = components(edges.unionByName(_alike(star, source, similarity)))
    maps = maps.drop("n")
    placed = saved(members.drop("pivot").join(roots, "node", "left").join(maps, "node").select("key", "node", "n", "bits", F.coalesce("root", "node").alias("root")), "near-placed")
    left, right = (placed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "bits", "root")]) for x in "ab")
    wanted = (left.key == right.key) & (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _may_link(similarity)
    apart = left.join(right, wanted).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    pairs = saved(apart.distinct().join(star, ["a", "b"], "left_anti"), "near-pairs")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(known.unionByName(_alike(pairs, source, similarity)))
    return sketches.join(roots, "node", "left").select("id", "row", "node", F.coalesce("root", "node").alias("root"))


def _source(docs: DataFrame, id_col: str, text: str, row: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), row.alias("row"), F.xxhash64(text_or_empty(text)).alias("node"), text_or_empty(text).cast("binary").alias("text"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) of every row; component_id is the least id reachable over links."""
    rows = _near_rows(_source(docs, id_col, text, F.lit(0).cast("long")), similarity)
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component, with all its columns: that of the least id, null ids last; of rows that share it, one.

    Rows are told apart by a number of their own, so rows that share an id, or have none, go or stay each by itself."""
    number = free_name("row", docs.columns)
    numbered = saved(docs.withColumn(number, F.monotonically_increasing_id()), "near-docs")
    rows = saved(_near_rows(_source(numbered, id_col, text, F.col(number)), similarity), "near-rows")
    rank = F.struct(F.col("id").isNull(), "id", "row")
    stays = rows.groupBy("root").agg(F.min(rank).alias("first")).select(F.col("first.row").alias("row"))
    gone = saved(rows.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(number)), "near-gone")
    passes = _Filter(gone)
    stay = passes.join(numbered, number, "left_anti").unionByName(passes.join(numbered, number, "left_semi").join(gone, number, "left_anti"))
    return stay.select(*docs.columns)
