"""Substring dedup over prefix-partitioned suffix trees.

A suffix is a word position with DEPTH words from there on; its path are these words. Suffixes that share a whole path
are the repeats, so the trees are cut at DEPTH.

1. Texts are dealt to pieces. A piece takes the suffixes whose window hash it holds twice, builds their tree, and keeps
   the least leaf of each node of full depth; the others are repeats already. A census of window hashes over all
   pieces (see census) then tells which of the remaining suffixes can have an equal in another piece; all others are
   single leaves of the whole tree and go no further.
2. The suffixes that are left are split by prefixes of variable length: of two words, and where a sample of prefix
   counts says that so short a prefix would hold more than GROUP suffixes, of four, eight or all words. Groups share
   tasks by hash. Each task builds the tree of its groups, level by level: a node's leaves are sorted by their next
   edge, nodes of one leaf are done, and the nodes that reach DEPTH with two leaves or more are the repeats. Within a
   node the least place stays. Neighbouring repeats of a text join up to maximal ones.

Within a piece edges are words, compared by their bytes. Between pieces words would be sent DEPTH times over, so edges
are the hashes of words 1-2, 3-4, 5-8 and 9-20 (32, 32, 32 and 64 bits) and a 64-bit hash of the whole path from another
hash function of the words: paths are equal if all 224 bits are. A passage that fills a third of the corpus is one
suffix a piece, in one leaf.

A place is (id, start, hash of the text); null ids come after all others. Words that repeats cover are marked by
places, gathered by piece, and cut out where the texts are read again.

Defined results. Ids are integers; other types raise TypeError. Null or blank texts have no words. Rows equal in id and
text share their places: neither is earlier, and both lose the same words. Rows of one id with unequal texts are compared
by start, then by text hash. Empty tables give empty results. Other columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .census import SENT, Asked, answers, census, plan, ranges, sent_table
from .common import lean_group, saved, table, tasks
from .packing import pack, pack_sorted, unpack, unpack_sorted
from .words import _BASE, batch_bytes, mix, separators, text_parts, word_hashes, word_spans

#: Words of a window; lengths of the prefixes that split suffixes.
DEPTH, PREFIXES = 20, (2, 4, 8, 20)
#: Bytes of text of a piece; suffixes of a group; sampled suffixes that a full group would show.
PIECE_BYTES, GROUP, SAMPLED = 8 << 20, 400_000, 64
_PART_BYTES = 1 << 21
LAST = np.int64((1 << 63) - 1)
U64 = np.uint64


def prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which hashes of any run of words follow, and the inverse powers that go with them."""
    n = len(words)
    power, total = np.full(n + 1, U64(_BASE)), np.zeros(n + 1, U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    power[:n] *= words
    np.cumsum(power[:n], out=total[1:])
    power[:] = pow(_BASE, -1, 1 << 64)
    power[0] = 1
    return total, np.multiply.accumulate(power, out=power)


def run_hashes(sums: tuple[np.ndarray, np.ndarray], begin: np.ndarray, length: int) -> np.ndarray:
    """Hash of the first words of the suffix at each begin."""
    total, down = sums
    return mix((total[begin + length] - total[begin]) * down[begin])


def joined(starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts within a group: (index of the first, first start, number)."""
    if not len(starts):
        return np.zeros(0, np.int64), starts, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(group) != 0)]))
    return head, starts[head], np.diff(np.append(head, len(starts)))


def first_of_equal(nodes: np.ndarray, ids: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the least place of its node, is a later place). Equal places are neither later; one of them is the least."""
    order = np.lexsort((texts, starts, ids, nodes))
    h, i, s, t = nodes[order], ids[order], starts[order], texts[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
    later = (i != i[lead]) | (s != s[lead]) | (t != t[lead])
    first, after = np.empty(len(h), bool), np.empty(len(h), bool)
    first[order], after[order] = head, later
    return first, after


def deep_nodes(edge_at, suffixes: int, levels: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, node of each) of all nodes of full depth with two leaves or more, of the tree over the suffixes.

    edge_at(leaves, level) gives the next edge of each path, a number of 32 bits. The tree grows a level at a time: the
    leaves of a node are sorted by their edge, and a node left with one leaf is not followed any further."""
    leaves, node = np.arange(suffixes), np.zeros(suffixes, np.int64)
    for level in range(levels):
        if not len(leaves):
            break
        edge = node << np.int64(32) | edge_at(leaves, level).astype(np.int64)
        order = np.argsort(edge)
        e = edge[order]
        new = np.concatenate([[True], e[1:] != e[:-1]])
        of = np.cumsum(new) - 1
        shared = np.diff(np.append(np.flatnonzero(new), len(e)))[of] > 1
        leaves, node = leaves[order[shared]], of[shared]
    return leaves, node


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values)
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


class Piece:
    """The suffixes of some texts. Words are numbered by their bytes."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, texts: pa.Array):
        parts, sizes = [], []
        for i, j in text_parts(texts, _PART_BYTES):
            data, offsets = batch_bytes(texts[i:j])
            starts, ends, first = word_spans(data, offsets, separators("blank"))
            parts.append(_dictionary(data, starts, ends))
            sizes.append(np.diff(first))
        whole = pa.chunked_array(parts).unify_dictionaries() if parts else pa.chunked_array([], pa.dictionary(pa.int32(), pa.binary()))
        self.dictionary = whole.chunk(0).dictionary if parts else pa.array([], pa.binary())
        self.words = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks)])
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.ids, self.hashes = ids, hashes
        data, offsets = batch_bytes(self.dictionary)
        self.sums = prefix_sums(word_hashes(data, offsets[:-1], offsets[1:], lower=False)[self.words])
        counts = np.maximum(sizes - DEPTH + 1, 0)
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        self.begin = np.repeat(np.cumsum(sizes) - sizes, counts).astype(np.int32) + self.start
        #: What is left of each node of full depth within the piece, and the windows that are repeats already.
        self.window = run_hashes(self.sums, self.begin, DEPTH)
        twice = np.flatnonzero(repeated(self.window))
        leaves, node = deep_nodes(lambda x, d: self.words[self.begin[twice[x]] + d], len(twice))
        leaves = twice[leaves]
        first, later = first_of_equal(node, ids[self.doc[leaves]], self.start[leaves], hashes[self.doc[leaves]])
        self.later = np.sort(leaves[later])
        gone = np.zeros(len(self.begin), bool)
        gone[leaves[~first]] = True
        self.left = np.flatnonzero(~gone)

    def marks(self, unit: int) -> dict | None:
        head, start, size = joined(self.start[self.later], self.doc[self.later])
        return _mark_row(unit, self.doc[self.later][head], self.ids, self.hashes, start, size) if len(head) else None

    def asked(self, sizes: tuple[int, int]) -> Asked:
        return Asked(self.window[self.left], np.ones(len(self.left)), sizes)

    def sample(self, every: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(prefixes, counts) of a sample of the suffixes, by length of the prefix."""
        chosen = self.begin[self.left][self.window[self.left] % U64(every) == 0]
        return [np.unique(run_hashes(self.sums, chosen, k), return_counts=True) for k in PREFIXES[:-1]]

    def edges(self, at: np.ndarray) -> list[np.ndarray]:
        """The edges of the paths from some suffixes, as columns of 32 bits."""
        begin, out = self.begin[at], []
        for low, high in zip((0, *PREFIXES[:-1]), PREFIXES, strict=True):
            out.append(run_hashes(self.sums, begin + low, high - low))
        data, offsets = batch_bytes(self.dictionary)
        whole, cut = data.tobytes(), offsets.tolist()
        other = np.array([xxhash.xxh64_intdigest(whole[a:b], 7) for a, b in zip(cut[:-1], cut[1:], strict=True)], U64)
        out.append(run_hashes(prefix_sums(other[self.words]), begin, DEPTH))
        columns = [(x >> U64(32)).astype(np.uint32) for x in out]
        return columns + [x.astype(np.uint32) for x in out[-2:]]

    def groups(self, unit: int, live: np.ndarray, heavy: list[np.ndarray], buckets: int) -> list[dict]:
        """Rows for the buckets: the edges of the suffixes that live, each in the group of its prefix."""
        at = self.left[live]
        if not len(at):
            return []
        key, split = run_hashes(self.sums, self.begin[at], PREFIXES[0]), np.ones(len(at), bool)
        for k, crowded in zip(PREFIXES[1:], heavy, strict=True):
            split[split] = np.isin(key[split], crowded)
            key[split] = run_hashes(self.sums, self.begin[at[split]], k)
        bucket = (key % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        edges = self.edges(at)
        head = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(at)], strict=True):
            mine = at[a:b]
            docs, which = np.unique(self.doc[mine], return_inverse=True)
            out.append(
                {
                    "bucket": int(bucket[a]),
                    "unit": unit,
                    "edges": [e[a:b].tobytes() for e in edges],
                    "starts": pack(self.start[mine].astype(np.uint32)),
                    "docs": pack(which.astype(np.uint32)),
                    "ids": pack(self.ids[docs]),
                    "hashes": pack(self.hashes[docs]),
                }
            )
        return out


def _dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The words of a batch, encoded by their bytes."""
    size = ends - starts
    edge = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - edge[:-1], size) + np.arange(edge[-1])] if len(starts) else np.zeros(0, np.uint8)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat)])
    return words.dictionary_encode()


def _mark_row(unit: int, doc: np.ndarray, ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict:
    """Repeats in texts of one unit: runs of suffixes, and the texts they are in."""
    docs, which = np.unique(doc, return_inverse=True)
    return {"unit": unit, "ids": pack(ids[docs]), "hashes": pack(hashes[docs]), "docs": pack(which.astype(np.uint32)), "starts": pack(start.astype(np.uint32)), "sizes": pack(size.astype(np.uint32))}


class Bucket:
    """The suffixes of a bucket's groups from all pieces, and the trees over them."""

    def __init__(self, rows: list[dict]):
        docs, starts, ids, hashes, base = [], [], [], [], 0
        for r in rows:
            ids.append(unpack(r["ids"], np.int64))
            hashes.append(unpack(r["hashes"], np.int64))
            docs.append(unpack(r["docs"], np.uint32).astype(np.int64) + base)
            starts.append(unpack(r["starts"], np.uint32).astype(np.int64))
            base += len(ids[-1])
        self.unit = np.repeat([r["unit"] for r in rows], list(map(len, ids)))
        self.edges = [np.concatenate([np.frombuffer(r["edges"][k], np.uint32) for r in rows]) for k in range(len(rows[0]["edges"]))]
        self.ids, self.hashes, self.doc, self.start = (np.concatenate(x) for x in (ids, hashes, docs, starts))

    def marks(self) -> list[dict]:
        """A row for each unit that has repeats here."""
        leaves, node = deep_nodes(lambda x, level: self.edges[level][x], len(self.doc), len(self.edges))
        doc = self.doc[leaves]
        _, later = first_of_equal(node, self.ids[doc], self.start[leaves], self.hashes[doc])
        leaves = leaves[later]
        leaves = leaves[np.lexsort((self.start[leaves], self.doc[leaves]))]  # texts of a unit are next to each other
        head, start, size = joined(self.start[leaves], self.doc[leaves])
        doc = self.doc[leaves][head]
        edge = np.append(np.flatnonzero(np.diff(self.unit[doc], prepend=-1)), len(doc))
        return [_mark_row(int(self.unit[doc[a]]), doc[a:b], self.ids, self.hashes, start[a:b], size[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


_MARKS = pa.schema([("unit", pa.int32()), *((c, pa.binary()) for c in ("ids", "hashes", "docs", "starts", "sizes"))])
_BUCKET = pa.schema([("bucket", pa.int32()), *_MARKS, ("edges", pa.list_(pa.binary()))])
_MARKS_SQL = "unit int, ids binary, hashes binary, docs binary, starts binary, sizes binary"


def _piece(group: pa.Table) -> Piece:
    return Piece(group["id"].to_numpy(), group["text_hash"].to_numpy(), group["text"].combine_chunks())


def _crowded(sampled: DataFrame, least: int) -> list[np.ndarray]:
    """By length, the prefixes of so many sampled suffixes: at most len(PREFIXES) * SAMPLED * suffixes / GROUP / least."""

    def add_up(group: pa.Table) -> pa.Table:
        value, index = np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in group["grams"]]), return_inverse=True)
        count = np.bincount(index, weights=np.concatenate([unpack(x.as_py(), np.int64) for x in group["many"]]))
        value = value[count >= least]
        return pa.table({"tag": pa.array([group["tag"][0].as_py()] * len(value), pa.int32()), "value": value.view(np.int64)})

    found = sampled.groupBy("range", "tag").applyInArrow(lean_group(add_up), "tag int, value long").toArrow()
    tags, values = found["tag"].to_numpy(), found["value"].to_numpy().view(U64)
    return [np.sort(values[tags == k]) for k in range(1, len(PREFIXES))]


def repeat_marks(rows: DataFrame, size: int, group: int = GROUP, sampled: int = SAMPLED) -> DataFrame:
    """Rows of _MARKS: by unit the suffixes that are equal to one at an earlier place. rows: unit, id, text_hash, text."""
    spark = rows.sparkSession
    suffixes = size // 5 + 1  # an estimate, for sizes only
    sizes, every = plan(suffixes), max(1, group // sampled)

    def ask(part: pa.Table) -> pa.Table:
        unit, piece = part["unit"][0].as_py(), _piece(part)
        out = piece.asked(sizes).rows(unit, 0)
        for tag, (value, count) in enumerate(piece.sample(every), 1):
            out += [(r, unit, tag, pack_sorted(value[a:b]), pack(count[a:b])) for r, a, b in ranges(value, 64, plan(suffixes // every)[1])]
        return sent_table(out)

    sent = saved(rows.groupBy("unit").applyInArrow(lean_group(ask), SENT), "substring-hashes")
    live = saved(census(sent.filter("tag = 0")), "substring-live")
    heavy = spark.sparkContext.broadcast(_crowded(sent.filter("tag > 0"), max(1, sampled // 2)))
    buckets = max(tasks(spark), suffixes // 4 // group + 1)

    def deal(part: pa.Table, found: pa.Table) -> pa.Table:
        if not len(part):
            return pa.Table.from_pylist([], _BUCKET)
        piece, unit = _piece(part), part["unit"][0].as_py()
        out = piece.groups(unit, piece.asked(sizes).live(answers(found, 0)), heavy.value, buckets)
        if marks := piece.marks(unit):
            out.append(marks | {"bucket": unit % buckets})  # needs no tree any more
        return pa.Table.from_pylist(out, _BUCKET)

    def meet(part: pa.Table) -> pa.Table:
        got = part.to_pylist()
        out = [{c: r[c] for c in _MARKS.names} for r in got if r["edges"] is None]
        if got := [r for r in got if r["edges"] is not None]:
            out += Bucket(got).marks()
        return pa.Table.from_pylist(out, _MARKS)

    dealt = rows.groupBy("unit").cogroup(live.groupBy("unit")).applyInArrow(lean_group(deal), f"bucket int, {_MARKS_SQL}, edges array<binary>")
    return dealt.groupBy("bucket").applyInArrow(lean_group(meet), _MARKS_SQL)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", piece_bytes: int = PIECE_BYTES, group: int = GROUP, sampled: int = SAMPLED) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) of every row."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"ids are integers here, not {kind}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("text"), F.col(id_col).isNull().alias("none"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces = max(tasks(docs.sparkSession), size // piece_bytes + 1)
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("id", "text_hash"), F.lit(pieces)).cast("int"))
    marks = saved(repeat_marks(rows.drop("none"), size, group, sampled), "substring-marks")

    def cut(part: pa.Table, found: pa.Table) -> pa.Table:
        out = [_cut_part(part.slice(i, j - i), *_runs(part.slice(i, j - i), found.to_pylist())) for i, j in text_parts(part["text"].combine_chunks(), _PART_BYTES)]
        return pa.concat_tables([_KEPT.empty_table(), *out])

    kept = rows.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(lean_group(cut), "id long, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return kept.withColumn("kept_text", F.col("kept_text").cast("string"))


_KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])


def _runs(part: pa.Table, marks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first suffix, suffixes) of all runs in the rows of a part; rows equal in id and text have the same."""
    rows: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(part["id"].to_pylist(), part["text_hash"].to_pylist(), strict=True)):
        rows.setdefault(key, []).append(i)
    out = [(np.zeros(0, np.int64),) * 3]
    for m in marks:
        keys = zip(unpack(m["ids"], np.int64).tolist(), unpack(m["hashes"], np.int64).tolist(), strict=True)
        which, starts, sizes = (unpack(m[c], np.uint32).astype(np.int64) for c in ("docs", "starts", "sizes"))
        here = [(d, r) for d, key in enumerate(keys) for r in rows.get(key, ())]
        if here:
            doc, row = np.array(sorted(here)).T
            low, high = np.searchsorted(which, doc), np.searchsorted(which, doc, "right")  # runs are in order of docs
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(row, n), starts[at], sizes[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut_part(part: pa.Table, row: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Table:
    data, offsets = batch_bytes(part["text"])
    starts, ends, first = word_spans(data, offsets, separators("blank"))
    change = np.zeros(len(starts) + 1, np.int32)
    begin = begin + first[row]
    np.add.at(change, begin, 1)
    np.add.at(change, begin + size + DEPTH - 1, -1)
    keep = np.cumsum(change[:-1]) == 0
    s, e = starts[keep], ends[keep]
    size = e - s
    out = np.full((size + 1).sum(), 32, np.uint8)
    source = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[source]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    kept = np.concatenate([[0], np.cumsum(keep)])[first]
    flat = out.tobytes()
    texts = [flat[at[a] : max(at[a], at[b] - 1)] for a, b in zip(kept[:-1], kept[1:], strict=True)]
    n = np.diff(first)
    ids = pa.array(part["id"].to_numpy(), mask=part["none"].to_numpy())
    return pa.table([ids, n.astype(np.int64), (n - np.diff(kept)).astype(np.int64), [hashlib.sha256(t).hexdigest() for t in texts], pa.array(texts, pa.binary())], schema=_KEPT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w WHERE len(words) >= 20),
g AS (SELECT doc_id, start, sha256(array_to_string(words[start:start + 19], ' ')) AS run FROM s),
r AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS pos FROM g) WHERE pos > 1),
c AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start, start + 20)) AS i FROM r) GROUP BY doc_id),
k AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
