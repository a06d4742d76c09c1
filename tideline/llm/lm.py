"""LM scoring with a weighted backoff automaton.

The model is an n-gram model of order ORDER with a cut-off: n-grams of two words or more count if training holds them
CUT times at least, so that a text seen once teaches nothing but its words. With c* the counts that are left and
S(h) their sum over all words after h, P(w|h) = (c*(hw) + K P(w|h')) / (S(h) + K), where h' is h without its first word
and the lowest order is the base distribution (half a count for every known word and one unknown). Probabilities of
all words and the unknown one add up to one after any history.

As an automaton: every history with S(h) > 0 is a state, as is the empty one. Each n-gram that is left is an arc from
the state of its history, with log P, to the state of the longest suffix of the n-gram that is a history. A word without
an arc takes the failure arc, which costs log K / (S(h) + K), to the state of h', and tries again; the empty state has an
arc for every word. One traversal from left to right carries the state from token to token and adds up weights. All
texts of a block are traversed side by side; a long text is cut into stretches, each of which starts ORDER - 1 tokens
early without adding anything, after which its state is that of the whole text.

The automaton grows with the corpus, so no task ever holds it. Texts are dealt to blocks. A census (see census) of
n-gram hashes finds those that training can hold twice; only of these a block sends the 64-bit hashes, by history and
with its own counts, to the owner of the history's range, who adds up the counts, applies the cut-off, takes S(h), and
returns to each block the part of the automaton that its own texts can reach. Rows never outnumber n-grams.

Defined results. Null text counts as empty: one token, the end. A null id counts as the empty text in the fold, which
is a training one. Repeated rows are counted as often as they occur. Without any training token N is 0 and base and
score follow from the formulas. Empty tables give empty results. Other columns of the input are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .census import SENT, Asked, answers, census, plan, ranges, sent_table
from .common import lean_group, saved, table, tasks
from .packing import pack, pack_sorted, unpack, unpack_sorted
from .words import _BASE, batch_bytes, mix, separators, word_hashes, word_spans

#: Order of the model; smoothing strength K by order of the n-gram; least count of n-grams of two words or more.
ORDER, STRENGTH, CUT = 3, {2: 8.0, 3: 2.0}, 2
#: Bytes of text of a block; tokens of a stretch of a text.
BLOCK_BYTES, STRETCH = 8 << 20, 512
#: Bits by which the n-grams after one history (of 64 bits) are told apart.
NAME_BITS = 40
FOLDS, HELD_OUT = 5, 1
U64 = np.uint64
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


class Block:
    """The tokens of some texts, each text as start, words, end, and their distinct n-grams.

    Words are numbered by their hashes; a pair is two words, a triple is a pair and the word after it."""

    def __init__(self, column: pa.Array, order: int = ORDER):
        data, offsets = batch_bytes(column)
        starts, ends, first = word_spans(data, offsets, separators("blank"))
        self.counts = np.diff(first) + 1
        self.begin = np.concatenate([[0], np.cumsum(self.counts + 1)])
        seq = np.empty(self.begin[-1], U64)
        seq[self.begin[:-1]] = START
        seq[self.begin[1:] - 1] = END
        starting = np.zeros(len(seq), bool)
        starting[self.begin[:-1]] = True
        inside = ~starting
        inside[self.begin[1:] - 1] = False
        seq[inside] = word_hashes(data, starts, ends)
        del data, starts, ends, inside
        self.words, self.seq = _numbered_often(seq)
        del seq
        #: By order: where n-grams end, and the number of the n-gram that ends there; their hashes.
        self.at, self.index, self.hash = {1: np.flatnonzero(~starting).astype(np.int32)}, {}, {1: mix(self.words)}
        self.index[1] = self.seq[self.at[1]]
        self.pairs = self.triples = np.zeros((0, 2), np.int32)
        if order > 1:
            self.at[2] = self.at[1]
            self.pairs, self.index[2] = _pairs(self.seq[self.at[2] - 1], self.index[1])
            self.hash[2] = mix(self.hash[1][self.pairs[:, 0]] * U64(_BASE) + self.words[self.pairs[:, 1]])
        if order > 2:
            inner = np.flatnonzero(~starting[self.at[2] - 1])
            self.at[3] = self.at[2][inner]
            self.triples, self.index[3] = _pairs(self.index[2][inner - 1], self.index[1][inner])
            self.hash[3] = mix(self.hash[2][self.triples[:, 0]] * U64(_BASE) + self.words[self.triples[:, 1]])

    def training(self, train: np.ndarray) -> dict[int, np.ndarray]:
        """By order, how often the training texts hold each n-gram."""
        chosen = np.repeat(train, self.counts + 1)
        return {k: np.bincount(index[chosen[self.at[k]]], minlength=len(self.hash[k])) for k, index in self.index.items()}


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, number of each value's)."""
    distinct, number = np.unique(values, return_inverse=True)
    return distinct, number.astype(np.int32)


def _numbered_often(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for values that repeat: they are hashed, and only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct[order], rank[coded.indices.to_numpy()]


def _by_place(place: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Order by place, then hash, in one sort where places leave room for the bits that tell n-grams apart (those that
    agree in these have the same counts, so their order is free)."""
    bits = max(int(place.max(initial=0)).bit_length(), 1)
    if 64 - bits < NAME_BITS:
        return np.lexsort((whole, place))
    return np.argsort(place.astype(U64) << U64(64 - bits) | whole >> U64(bits))


def _pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs of numbers, number of each pair's)."""
    code, number = _numbered(left.astype(np.int64) << 32 | right)
    return code.view(np.int32).reshape(-1, 2)[:, ::-1], number


class Automaton:
    """States and arcs that the texts of a block can reach."""

    def __init__(self, base: np.ndarray, histories: dict[int, tuple[np.ndarray, np.ndarray]], arcs: dict[int, tuple[np.ndarray, np.ndarray]]):
        """base: probability of each word of the block. histories and arcs, by order of the n-gram: rows of words with
        S(h), with c*. State 0 is the empty history, then come those of one word, then those of two."""
        self.base = np.log10(base)
        self.one = np.zeros(len(base), np.int64)
        singles, total = histories.get(2, (np.zeros((0, 1), np.int64), np.zeros(0)))
        self.one[singles[:, 0]] = np.arange(1, len(singles) + 1)
        doubles, more = histories.get(3, (np.zeros((0, 2), np.int64), np.zeros(0)))
        self.two = doubles[:, 0].astype(np.int64) << 32 | doubles[:, 1]
        order = np.argsort(self.two)
        doubles, more, self.two = doubles[order], more[order], self.two[order]
        self.after = 1 + len(singles)
        self.fail = np.concatenate([np.zeros(self.after, np.int64), self.one[doubles[:, 1]]])
        self.penalty = np.concatenate([[0.0], np.log10(STRENGTH[2] / (total + STRENGTH[2])), np.log10(STRENGTH[3] / (more + STRENGTH[3]))])
        total_of = np.concatenate([[0.0], total, more])
        rows, self.weight, self.target = [], np.zeros(0), np.zeros(0, np.int64)
        self.first = {}  # by order, the number of its first arc
        for k in sorted(arcs):  # the weight of a longer one needs that of the shorter
            grams, count = arcs[k]
            state, word = self.state(grams[:, :-1]), grams[:, -1]
            below = self.base[word]
            if k == 3:
                shorter = self._code(self.one[grams[:, 1]], word)
                found = self._search(self._code(self.one[arcs[2][0][:, 0]], arcs[2][0][:, 1]), shorter)
                below = np.where(found >= 0, self.weight[found] if len(self.weight) else 0.0, self.penalty[self.fail[state]] + below)
            self.first[k] = len(self.weight)
            rows.append(self._code(state, word))
            self.weight = np.concatenate([self.weight, np.log10((count + STRENGTH[k] * 10**below) / (total_of[state] + STRENGTH[k]))])
            self.target = np.concatenate([self.target, self.state(grams[:, -2:])])
        self.arc = np.concatenate([np.zeros(0, np.int64), *rows])

    @staticmethod
    def _code(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return state.astype(np.int64) << 32 | word

    @staticmethod
    def _search(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Number of each code, or -1."""
        if not len(codes):
            return np.full(len(wanted), -1)
        order = np.argsort(codes)
        at = np.minimum(np.searchsorted(codes[order], wanted), len(codes) - 1)
        return np.where(codes[order[at]] == wanted, order[at], -1)

    def state(self, history: np.ndarray) -> np.ndarray:
        """State of the longest suffix of each history that is one."""
        out = self.one[history[:, -1]]
        if history.shape[1] == 2 and len(self.two):
            code = history[:, 0].astype(np.int64) << 32 | history[:, 1]
            at = np.minimum(np.searchsorted(self.two, code), len(self.two) - 1)
            out = np.where(self.two[at] == code, self.after + at, out)
        return out

    def step(self, state: np.ndarray, word: np.ndarray, arcs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of a word in each state: its arc, or failure arcs until there is one.

        arcs: where it is known, the arcs of the word from the states of its last word and of its last two, or -1."""
        gained, state, word, todo = np.zeros(len(state)), state.copy(), word.astype(np.int64), np.arange(len(state))
        while len(todo):
            here = state[todo]
            arc = self._search(self.arc, self._code(here, word[todo])) if arcs is None else np.where(here >= self.after, arcs[1][todo], arcs[0][todo])
            root = here == 0
            hit = (arc >= 0) & ~root
            gained[todo[hit]] += self.weight[arc[hit]]
            state[todo[hit]] = self.target[arc[hit]]
            home = todo[root]
            gained[home] += self.base[word[home]]
            state[home] = self.one[word[home]]
            left = ~(hit | root)
            todo, here = todo[left], here[left]
            gained[todo] += self.penalty[here]
            state[todo] = self.fail[here]
        return gained, state

    def traverse(self, block: Block, numbers: dict[int, np.ndarray] | None = None, order: int = ORDER, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of each text. numbers: by order, the block's numbers of the arcs' n-grams; a token's arcs are
        then found by the numbers of the pair and the triple that it ends, else by state and word."""
        arcs_at = None
        if numbers is not None:
            arcs_at = [np.full(len(block.seq), -1, np.int32) for _ in range(2)]
            for k, mine in numbers.items():
                arc_of = np.full(len(block.hash[k]), -1, np.int32)
                arc_of[mine] = self.first[k] + np.arange(len(mine))
                arcs_at[k - 2][block.at[k]] = arc_of[block.index[k]]
        text = np.repeat(np.arange(len(block.counts)), -(-block.counts // stretch))
        part = np.arange(len(text)) - np.repeat(np.cumsum(np.bincount(text)) - np.bincount(text), np.bincount(text)) if len(text) else text
        low = 1 + part * stretch  # places in the text, from its first token on
        high = np.minimum(low + stretch, block.counts[text] + 1)
        early = np.maximum(low - (order - 1), 1)
        # Longest first, so that those still under way are always the first ones.
        by = np.argsort(early - high, kind="stable")
        text, low, high, early = text[by], low[by], high[by], early[by]
        state = np.zeros(len(text), np.int64)
        if len(text):
            state[:] = np.where(early == 1, self.one[block.seq[block.begin[:-1][text]]], 0)
        score, offset, length = np.zeros(len(text)), block.begin[:-1][text], high - early
        active = len(text)
        for t in range(int(length.max(initial=0))):
            while active and length[active - 1] <= t:
                active -= 1
            at = offset[:active] + early[:active] + t
            gained, state[:active] = self.step(state[:active], block.seq[at], arcs_at and (arcs_at[0][at], arcs_at[1][at]))
            score[:active] += np.where(early[:active] + t >= low[:active], gained, 0.0)
        return np.bincount(text, weights=score, minlength=len(block.counts))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row. order: 1 to 3."""
    if order not in (1, 2, 3):
        raise ValueError("the order is 1, 2 or 3")
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col).alias("id"), (fold == HELD_OUT).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(tasks(spark), size // block_bytes + 1)
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    sizes = plan(size // 4 + 1)

    def ask(group: pa.Table) -> pa.Table:
        block = Block(group["text"], order)
        own = block.training(~np.asarray(group["held_out"]))
        return sent_table([row for k in range(2, order + 1) for row in Asked(block.hash[k], own[k], sizes).rows(group["unit"][0].as_py(), k)])

    def reach(group: pa.Table, block: Block, found: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: the histories that can be states, their hashes, how many n-grams follow each, these n-grams, their
        own counts and hashes; histories by hash, n-grams by history, then hash. Of two words and more only what can
        have CUT counts is there; a word is the history of nothing but itself."""
        own = block.training(~np.asarray(group["held_out"]))
        words = np.unique(block.index[1])
        words = words[np.argsort(block.hash[1][words])]
        yield 1, words, block.hash[1][words], np.ones(len(words), np.int64), words, own[1][words], block.hash[1][words]
        if order == 1:
            return
        histories, of = np.unique(block.pairs[:, 0]), block.pairs[:, 0]
        live = None
        for k in range(2, order + 1):
            if k > 2:  # what follows a history twice makes the history itself stand twice
                histories, of = np.flatnonzero(live), block.triples[:, 0]
            before = live
            live = Asked(block.hash[k], own[k], sizes).live(answers(found, k))
            grams = np.flatnonzero(live if before is None else live & before[of])
            histories = histories[np.argsort(block.hash[k - 1][histories])]
            rank = np.zeros(len(block.hash[k - 1]), np.int64)
            rank[histories] = np.arange(len(histories))
            place = rank[of[grams]]
            by = _by_place(place, block.hash[k][grams])
            grams = grams[by]
            yield k, histories, block.hash[k - 1][histories], np.bincount(place, minlength=len(histories)), grams, own[k][grams], block.hash[k][grams]

    def send(group: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if len(group):
            unit, block = group["unit"][0].as_py(), Block(group["text"], order)
            for k, _, keys, follow, _, own, whole in reach(group, block, found):
                edge = np.concatenate([[0], np.cumsum(follow)])
                for r, a, b in ranges(keys, 64, sizes[1]):
                    mine = slice(edge[a], edge[b])
                    names = pack(whole[mine] >> U64(64 - NAME_BITS)) if k > 1 else b""
                    out.append((r, unit, k, pack_sorted(keys[a:b]), pack(follow[a:b].astype(np.uint32)) if k > 1 else b"", names, pack(own[mine].astype(np.uint32))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_GRAMS), _GRAMS, strict=True)], schema=_GRAMS)

    def add_up(group: pa.Table) -> pa.Table:
        """Counts, cut-off and sums of a range of histories; for each block the counts of its n-grams and S of its histories."""
        k = group["k"][0].as_py()
        histories = [unpack_sorted(x.as_py()) for x in group["histories"]]
        own = np.concatenate([unpack(x.as_py(), np.uint32) for x in group["own"]])
        known, of = np.unique(np.concatenate(histories), return_inverse=True)
        sizes_of = [len(x) for x in histories]
        h_edge = np.cumsum([0, *sizes_of])
        if k == 1:
            total = np.bincount(of, weights=own).astype(np.int64)
            counts, edge, sums = total[of], h_edge, np.zeros(len(of), np.int64)
        else:
            of_gram = np.repeat(of, np.concatenate([unpack(x.as_py(), np.uint32) for x in group["follow"]]))
            names = [unpack(x.as_py(), U64) for x in group["grams"]]
            edge, names = np.cumsum([0, *map(len, names)]), np.concatenate(names)
            order = np.lexsort((names, of_gram))
            new = np.ones(len(order), bool)
            new[1:] = (names[order[1:]] != names[order[:-1]]) | (of_gram[order[1:]] != of_gram[order[:-1]])
            head = np.flatnonzero(new)
            total = np.add.reduceat(own[order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
            total[total < CUT] = 0
            after = np.bincount(of_gram[order[head]], weights=total, minlength=len(known)).astype(np.int64)
            counts = np.empty(len(order), np.int64)
            counts[order] = total[np.cumsum(new) - 1]
            sums = after[of]
        n, once = len(group), int(k == 1)
        return pa.table(
            [group["range"], group["unit"], group["k"]]
            + [pa.array([pack(x[a:b]) for a, b in zip(e[:-1], e[1:], strict=True)], pa.binary()) for x, e in ((counts, edge), (sums, h_edge))]
            + [pa.array([once * int(x)] + [0] * (n - 1), pa.int64()) for x in (total.sum(), (total > 0).sum())],
            names=["range", "unit", "k", "counts", "sums", "tokens", "distinct"],
        )

    live = saved(census(rows.groupBy("unit").applyInArrow(lean_group(ask), SENT)), "lm-live")
    sent = rows.groupBy("unit").cogroup(live.groupBy("unit")).applyInArrow(lean_group(send), "range int, unit int, k int, histories binary, follow binary, grams binary, own binary")
    model = saved(sent.groupBy("range", "k").applyInArrow(lean_group(add_up), "range int, unit int, k int, counts binary, sums binary, tokens long, distinct long"), "lm-arcs")
    tokens, distinct = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    parts = live.select("range", "unit", F.col("tag").alias("k"), "live", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("sums"))
    parts = parts.unionByName(model.select("range", "unit", "k", F.lit(None).cast("binary").alias("live"), "counts", "sums"))

    def score(group: pa.Table, told: pa.Table) -> pa.Table:
        n = len(group)
        if not n:
            return pa.Table.from_pylist([], _result(group.schema.field("id").type))
        block = Block(group["text"], order)
        is_live = pa.compute.is_valid(told["live"])
        found = told.filter(is_live).rename_columns(["range", "unit", "tag", "live", "counts", "sums"])
        owned = told.filter(pa.compute.invert(is_live))
        histories, arcs, numbers, words = {}, {}, {}, np.zeros(len(block.words))
        for k, states, _, _, grams, _, _ in reach(group, block, found):
            mine = owned.filter(pa.compute.equal(owned["k"], k)).sort_by("range")
            counts, sums = (np.concatenate([np.zeros(0, np.int64), *(unpack(x.as_py(), np.int64) for x in mine[c])]) for c in ("counts", "sums"))
            if k == 1:
                words[grams] = counts
                continue
            states, grams = states[sums > 0], grams[counts > 0]
            numbers[k] = grams
            histories[k] = (states[:, None] if k == 2 else block.pairs[states]), sums[sums > 0]
            arcs[k] = (block.pairs[grams] if k == 2 else np.column_stack([block.pairs[block.triples[grams, 0]], block.triples[grams, 1]])), counts[counts > 0]
        probability = (words + 0.5) / (tokens + 0.5 * (distinct + 1))
        text, token = np.repeat(np.arange(n, dtype=np.int32), block.counts), block.index[1]
        base = np.bincount(text, weights=np.log10(probability)[token], minlength=n)
        known = np.bincount(text, weights=words[token] > 0, minlength=n).astype(np.int64)
        score = Automaton(probability, histories, arcs).traverse(block, numbers, order)
        columns = [group["id"], group["held_out"], block.counts.astype(np.int64), known, np.full(n, tokens), base, score]
        return pa.table(columns, schema=_result(group.schema.field("id").type))

    schema = f"id {docs.select(id_col).dtypes[0][1]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("unit").cogroup(parts.groupBy("unit")).applyInArrow(lean_group(score), schema)


_GRAMS = pa.schema([(c, pa.int32()) for c in ("range", "unit", "k")] + [(c, pa.binary()) for c in ("histories", "follow", "grams", "own")])


def _result(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("id", kind), ("held_out", pa.bool_())] + [(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")] + [("base_score", pa.float64()), ("score", pa.float64())])


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
