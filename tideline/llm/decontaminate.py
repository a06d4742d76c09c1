"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF, the document frequencies being counted over the whole
corpus. A randomised SVD gives the latent space: tasks over the passages add up A'AO for a random O, the driver
orthonormalises the (words x rank) sum, which is one step of subspace iteration, and takes the singular vectors of A
in that basis from a small Gram matrix, added up the same way. Every window of every document is projected and
compared with all passages by cosine. Windows above COSINE are candidates; a candidate is checked against the whole
item by the longest common subsequence of words: at VERBATIM or more of the item it is a copy; at PARAPHRASE or more
it counts if the item's last words, its answer, are there as well. Failing both, VERBATIM of one passage of an item of
several passages is a copy of that passage, kind 'passage'; the share remains that of the item.

Documents are never compared with documents. Items are dealt to blocks of about BLOCK_ITEMS items, and a block's rank is
no less than its passages: the latent space then holds every passage whole, and a copy's cosine loses nothing to the
projection. A pass over the corpus takes PASS_BLOCKS blocks: one scan counts document frequencies for all of them, one
searches. What is broadcast (vocabulary, latent vectors, items of a pass) is bounded by these numbers and by the longest
item. Words in more than MAX_SHARE of the documents weigh nothing, unless an item would be left with fewer than
LEAST_TERMS weighted words.

Defined results. Null or wordless texts and items match nothing. A null id is an id like any other. Rows that repeat an
id give a row each, or each its own decision; items that repeat an id count as one item if equal, else each by itself.
Of windows that tie for an item, the one first in the text counts; equal items under several ids all match. Empty tables
give empty results. Other columns of the input are not read, whatever their names; clean() carries them along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, lean, saved, table
from .words import HashArray, batch_bytes, separators, text_parts, word_hashes, word_spans

#: Items a block and blocks a pass; words of a passage and of half a window; passages a block and least bound of its rank; columns of the sketch beyond it.
BLOCK_ITEMS, PASS_BLOCKS, PASSAGE, HALF, RANK, OVERSAMPLE = 256, 4, 48, 32, 256, 16
MAX_SHARE, LEAST_TERMS = 0.1, 6
COSINE, VERBATIM, PARAPHRASE, ANSWER_WORDS, ANSWER = 0.2, 0.8, 0.6, 6, 0.8
_PART_BYTES = 1 << 21


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all lower-cased alphanumeric words, index of each text's first word, with the end)."""
    data, offsets = batch_bytes(column)
    starts, ends, first = word_spans(data, offsets, separators("alnum"))
    return word_hashes(data, starts, ends), first


def common_length(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit a word of the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in region.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Index:
    """Items of a block: words, passages and, once fitted, their place in the latent space."""

    def __init__(self, ids: list, texts: list[str]):
        hashes, first = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        cuts = [(i, a) for i, w in enumerate(self.items) for a in range(0, len(w), PASSAGE)]
        # A short rest goes with the passage before it.
        cuts = [(i, a, len(self.items[i]) if len(self.items[i]) - a < 2 * PASSAGE else a + PASSAGE) for i, a in cuts if a == 0 or len(self.items[i]) - a >= PASSAGE]
        self.owner = np.array([i for i, _, _ in cuts], np.int64)
        self.parts = [(a, b) for _, a, b in cuts]
        self.vocabulary = np.unique(hashes)
        self.find = HashArray(self.vocabulary)
        index = [np.searchsorted(self.vocabulary, self.items[i][a:b]) for i, a, b in cuts]
        self.passage_words = np.concatenate(index) if index else np.zeros(0, np.int64)
        self.passage_edge = np.cumsum([0, *map(len, index)])

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        self.weight = np.log((documents + 1) / (frequency + 1.0)) + 1e-9
        rare = frequency <= MAX_SHARE * documents
        kept = rare.copy()
        for words in self.items:
            at = np.searchsorted(self.vocabulary, words)
            if rare[at].sum() < LEAST_TERMS:
                kept[at] = True
        self.weight = np.where(kept, np.maximum(self.weight, 1e-3), 0.0)

    def rows(self, words: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sparse unit TF-IDF rows."""
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at, count = np.unique(words[a:b], return_counts=True)
            value = count * self.weight[at]
            norm = np.sqrt((value**2).sum())
            out.append((at, value / norm if norm else value))
        return out

    def place(self, basis: np.ndarray) -> None:
        """Latent vectors of words and passages in an orthonormal basis of words."""
        self.latent = (basis * self.weight[:, None]).astype(np.float32)
        rows = self.rows(self.passage_words, self.passage_edge)
        self.passages = np.array([v @ basis[at] for at, v in rows], np.float32).reshape(len(rows), basis.shape[1])

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word of the window, passage, cosine) of all windows near a passage."""
        found = self.find.find(hashes)
        at = np.flatnonzero(found >= 0)
        at = at[self.weight[found[at]] > 0]
        word = found[at]
        text = np.searchsorted(first, at, "right") - 1
        half = (at - first[text]) // HALF
        # Half windows that hold a weighted word, by text.
        stride = int(half.max()) + 3 if len(half) else 1
        key = text * stride + half
        head = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.zeros(0, np.int64)
        if not len(head):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.float32)
        halves = key[head]
        vector = np.add.reduceat(self.latent[word], head, axis=0)
        square = np.add.reduceat(self.weight[word] ** 2, head)
        # Windows of two halves; the second may be without weighted words, and so may the first.
        begin = np.unique(np.concatenate([halves, halves[halves % stride > 0] - 1]))
        sums, norm = np.zeros((len(begin), vector.shape[1]), np.float32), np.zeros(len(begin))
        for step in (0, 1):
            k = np.searchsorted(halves, begin + step)
            k[k == len(halves)] = 0
            ok = halves[k] == begin + step
            sums[ok] += vector[k[ok]]
            norm[ok] += square[k[ok]]
        out = []
        for a in range(0, len(begin), 4096):
            cosine = sums[a : a + 4096] @ self.passages.T / np.sqrt(norm[a : a + 4096])[:, None]
            w, p = np.nonzero(cosine >= COSINE)
            out.append((begin[a + w] // stride, first[begin[a + w] // stride] + begin[a + w] % stride * HALF, p, cosine[w, p]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def matches(self, column: pa.Array) -> list[tuple[int, int, float, float, str]]:
        """(text, item, cosine, share of the item found in order, kind), the best of each text and item."""
        hashes, first = words_of(column)
        best: dict[tuple[int, int], tuple[float, float, str]] = {}
        for text, at, passage, cosine in zip(*(x.tolist() for x in self.candidates(hashes, first)), strict=True):
            i = int(self.owner[passage])
            item = self.items[i]
            if best.get((text, i), (0, 0))[1] == 1.0:
                continue
            reach = len(item)
            region = hashes[max(first[text], at - reach) : min(first[text + 1], at + 2 * HALF + reach)]
            share = common_length(item, region) / len(item)
            kind = "verbatim" if share >= VERBATIM else ""
            if not kind and share >= PARAPHRASE:
                answer = item[-ANSWER_WORDS:]
                kind = "paraphrase" if common_length(answer, region) >= ANSWER * len(answer) else ""
            a, b = self.parts[passage]
            if not kind and b - a < len(item):
                near = hashes[max(first[text], at - (b - a)) : min(first[text + 1], at + 2 * HALF + b - a)]
                kind = "passage" if common_length(item[a:b], near) >= VERBATIM * (b - a) else ""
            if kind and (share, cosine) > (best.get((text, i), (0, 0))[1], best.get((text, i), (0, 0))[0]):
                best[text, i] = (cosine, share, kind)
        return [(text, i, *found) for (text, i), found in sorted(best.items())]


def _frequencies(rows: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each word of the vocabulary, all documents)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = HashArray(shared.value)
        count, texts = np.zeros(find.size + 1, np.int64), 0
        for batch in batches:
            for i, j in text_parts(batch.column(1), _PART_BYTES):
                hashes, first = words_of(batch.column(1)[i:j])
                found = find.find(hashes)
                text = np.repeat(np.arange(j - i), np.diff(first))
                at = np.flatnonzero(found >= 0)
                count += np.bincount(np.unique(text[at] * find.size + found[at]) % find.size, minlength=find.size + 1)
                texts += j - i
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(count[some], texts))], names=["word", "n"])

    got = rows.mapInArrow(lean(each), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary))
    for r in got:
        if r.word >= 0:
            out[r.word] = r.n
    return out, next((r.n for r in got if r.word < 0), 0)


def _latent_basis(spark: SparkSession, index: Index, rank: int) -> np.ndarray:
    """Orthonormal (words x rank) basis of the leading right singular vectors of the passages, by a randomised SVD."""
    n, size = len(index.vocabulary), min(rank + OVERSAMPLE, len(index.passage_edge) - 1, len(index.vocabulary))
    kept = min(rank, size)
    random = np.random.default_rng(7)
    passages = spark.createDataFrame([(i,) for i in range(len(index.passage_edge) - 1)], "i int")
    context = spark.sparkContext

    def added(shape: tuple[int, int], part) -> np.ndarray:
        """Sum over tasks of part(rows); a task sends one (words x columns) array at most."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = [i for b in batches for i in b.column(0).to_pylist()]
            if mine:
                ix = shared.value[0]
                rows = ix.rows(ix.passage_words, ix.passage_edge)
                yield pa.record_batch([pa.array([part([rows[i] for i in mine], shared.value[1]).tobytes()], pa.binary())], names=["sum"])

        total = np.zeros(shape)
        for r in passages.repartition(max(1, len(index.passage_edge) // 256)).mapInArrow(each, "sum binary").toLocalIterator():
            total += np.frombuffer(r["sum"]).reshape(shape)
        return total

    def sketch(rows, omega):
        out = np.zeros((n, size))
        for at, v in rows:
            out[at] += np.outer(v, v @ omega[at])
        return out

    def gram(rows, basis):
        y = np.array([v @ basis[at] for at, v in rows])
        return y.T @ y

    shared = context.broadcast((index, random.standard_normal((n, size))))
    basis, _ = np.linalg.qr(added((n, size), sketch))
    shared.unpersist()
    shared = context.broadcast((index, basis))
    _, turn = np.linalg.eigh(added((basis.shape[1],) * 2, gram))
    shared.unpersist()
    return basis @ turn[:, ::-1][:, :kept]


def _in_blocks(benchmark: DataFrame, item_id: str, item_text: str, rank: int, block_items: int) -> tuple[DataFrame, int]:
    """(distinct items with their block, number of blocks). Blocks are dealt by hash, for block_items items and three
    quarters of rank passages each on average; one that gets more passages than rank has a higher rank."""
    items = benchmark.select(F.col(item_id).alias("item"), F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("text")).distinct()
    passages = F.greatest(F.lit(1), F.octet_length("text") / (4 * PASSAGE))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(passages), F.lit(0.0))).first()
    blocks = max(1, -(-n // block_items), int(-(-size // (0.75 * rank))))
    return saved(items.withColumn("block", F.pmod(F.xxhash64(F.col("item").cast("string"), "text"), F.lit(blocks))), "benchmark-items"), blocks


def _passes(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, rank: int, block_items: int) -> Iterator[tuple[Broadcast, pa.DataType]]:
    """(fitted indexes, type of the item ids) by pass over the corpus: PASS_BLOCKS blocks, whose items are all that the
    driver holds."""
    spark = rows.sparkSession
    items, blocks = _in_blocks(benchmark, item_id, item_text, rank, block_items)
    for low in range(0, blocks, PASS_BLOCKS):
        made = []
        mine = items.filter(F.col("block").between(low, low + PASS_BLOCKS - 1)).orderBy("block", "item", "text").collect()
        for block in sorted({r.block for r in mine}):
            held = [r for r in mine if r.block == block and words_of(pa.array([r.text]))[1][-1]]
            if held:
                made.append(Index([r["item"] for r in held], [r.text for r in held]))
        if not made:
            continue
        vocabulary = np.unique(np.concatenate([i.vocabulary for i in made]))
        count, documents = _frequencies(rows, vocabulary)
        for index in made:
            index.weigh(count[np.searchsorted(vocabulary, index.vocabulary)], documents)
            index.place(_latent_basis(spark, index, max(rank, len(index.owner))))
        yield spark.sparkContext.broadcast(made), to_arrow_type(items.schema["item"].dataType)


def _lowered(docs: DataFrame, text: str) -> Column:
    return F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item, cosine, share, kind) of every document row and item that match."""
    rows = docs.select(F.col(id_col).alias("id"), _lowered(docs, text).alias("text"))
    schema = f"id {rows.dtypes[0][1]}, item {benchmark.select(item_id).dtypes[0][1]}, cosine double, share double, kind string"
    found = [rows.mapInArrow(lean(_matcher(*made)), schema) for made in _passes(rows, benchmark, item_id, item_text, rank, block_items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that match no item, with all their columns. Each row is judged by itself: rows that share an id
    with one that matches stay."""
    name = free_name("lowered", docs.columns)
    rows, n = docs.withColumn(name, _lowered(docs, text)), len(docs.columns)

    def without(shared: Broadcast) -> Callable:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for i, j in text_parts(batch.column(n), _PART_BYTES):
                    for index in shared.value:
                        keep[[i + found[0] for found in index.matches(batch.column(n)[i:j])]] = False
                yield batch.filter(pa.array(keep))

        return lean(each)

    left = rows
    for shared, _ in _passes(rows.select(F.lit(0), name), benchmark, item_id, item_text, rank, block_items):
        left = left.mapInArrow(without(shared), rows.schema)
    return left.select(*docs.columns)


def _matcher(shared: Broadcast, kind_of: pa.DataType) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_parts(batch.column(1), _PART_BYTES):
                for index in shared.value:
                    found = index.matches(batch.column(1)[i:j])
                    if found:
                        text, item, cosine, share, kind = zip(*found, strict=True)
                        columns = [batch.column(0)[i:j].take(pa.array(text)), pa.array([index.ids[k] for k in item], kind_of), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(kind)]
                        yield pa.record_batch(columns, names=["id", "item", "cosine", "share", "kind"])

    return each


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("cosine", 4).alias("cosine"), "share", "kind")
