"""Language ID by interpolated Kneser-Ney character models.

Each language gets a model of order ORDER over lower-cased letters, with runs of anything else as one boundary. It is
fitted on a bounded sample of labelled rows (SAMPLE_ROWS a language, the least hashes of their ids); everything else
covers all rows and whole texts. The models are merged into one sorted array of n-gram hashes per order; beside each
hash stand the interpolated log-probabilities under all languages, and beside each context hash the backoff weights.
A text goes to the language of the lowest cross-entropy per symbol; the score is the posterior of that language, all
being as likely beforehand. Part of the sample is left out of the fit and calibrates the rejection: cross-entropies of
clean texts of n symbols spread about their language's mean with the variance d**2 + s**2 / n, where d is what the
left-out texts differ by and s what their symbols do. A text that lies more than REJECT_SIGMAS such deviations above the
mean is rejected. Were the spread normal, that would take one clean text in 10**15; tails are heavier, but no left-out
text of the given tables comes near (see README for what is rejected).

Defined results. Null text, or text without a letter, is 'und' with score 0 and rejected. Equal cross-entropies go to
the language that sorts first. A null id is held out. Rows without a label are never learned from. Repeated rows get equal
results. Without any row to learn from, every text is 'und'. Other columns of the input are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, lean, lean_group, table
from .words import HashArray, batch_bytes, mix, text_parts

#: Order of the models (16 bits a symbol in a 64-bit code), labelled rows of a language, every which of them calibrates.
ORDER, SAMPLE_ROWS, CALIBRATE_EVERY = 4, 500, 5
#: Deviations above the mean at which a text is rejected; least deviations between texts and between symbols; between
#: texts where fewer than FEW were left out; symbols from which on a left-out text tells how texts differ.
REJECT_SIGMAS, FLOOR_TEXTS, FLOOR_SYMBOLS, UNSURE_TEXTS, FEW, LONG = 8.0, 0.02, 1.0, 0.25, 20, 200
_PART_BYTES = 1 << 20
U64 = np.uint64
ASTRAL = 0xFFFD

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Symbol of each code point below 65536: its lower case if it is a letter, else 0."""
    if not _letters:
        out = np.zeros(1 << 16, np.uint16)
        for c in range(1 << 16):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low[0]) if len(low) == 1 and ord(low) < 1 << 16 else c
        _letters.append(out)
    return _letters[0]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, edges): all texts as symbols, each after ORDER-1 zeros; edges says where each text's own begin."""
    texts = bytes(data).decode("utf-8", "replace")
    points = np.frombuffer(texts.encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if at[-1] != len(points):  # bytes that are no UTF-8: each text is decoded by itself
        each = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in each])])
        points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
    known = letter_table()[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        known[points == c] = ASTRAL if chr(c).isalpha() else 0
    keep = np.empty(len(known), bool)
    keep[:1] = True
    keep[1:] = (known[1:] != 0) | (known[:-1] != 0)
    keep[at[:-1][at[:-1] < len(keep)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    counts = np.diff(kept)
    out = np.zeros(len(counts) * (ORDER - 1) + kept[-1], np.uint16)
    edges = kept[:-1] + (ORDER - 1) * np.arange(1, len(counts) + 1)
    out[np.arange(kept[-1]) + np.repeat((ORDER - 1) * np.arange(1, len(counts) + 1), counts)] = known[keep]
    return out, np.append(edges, len(out) + ORDER - 1)


def own_positions(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, counts): where the symbols of each text are, pads left out."""
    counts = np.diff(edges) - (ORDER - 1)
    begin = np.repeat(edges[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return begin + np.arange(counts.sum()), counts


def codes(syms: np.ndarray, at: np.ndarray, n: int, lag: int = 0) -> np.ndarray:
    """Packed runs of n symbols that end lag before each position."""
    out = np.zeros(len(at), U64)
    for k in range(n - 1, -1, -1):
        out = (out << U64(16)) | syms[at - k - lag].astype(U64)
    return out


def hashed(code: np.ndarray, n: int) -> np.ndarray:
    return mix(code + U64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


def kneser_ney(syms: np.ndarray, edges: np.ndarray) -> dict:
    """For each n: grams (codes), their interpolated probabilities, contexts (codes) and backoff weights; and the floor."""
    at, _ = own_positions(edges)
    full, counts = np.unique(codes(syms, at, ORDER), return_counts=True)
    levels = {ORDER: (full, counts)}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols to the left
        levels[n] = np.unique(levels[n + 1][0] & ((U64(1) << U64(16 * n)) - U64(1)), return_counts=True)
    floor = 1.0 / (len(levels[1][0]) + 1)
    out, low_grams, low_p = {"floor": floor}, None, None
    for n in range(1, ORDER + 1):
        grams, count = levels[n]
        ones, twos = int((count == 1).sum()), int((count == 2).sum())
        discount = ones / (ones + 2 * twos) if ones else 0.5
        context, place, followers = np.unique(grams >> U64(16), return_inverse=True, return_counts=True)
        total = np.bincount(place, weights=count)
        weight = discount * followers / total
        lower = np.full(len(grams), floor) if n == 1 else low_p[np.searchsorted(low_grams, grams & ((U64(1) << U64(16 * (n - 1))) - U64(1)))]
        p = np.maximum(count - discount, 0) / total[place] + weight[place] * lower
        out[n] = (grams, p, context, weight)
        low_grams, low_p = grams, p
    return out


class Model:
    """All languages' models merged; calibration beside them."""

    def __init__(self, langs: list[str], parts: list[dict]):
        self.langs, self.grams, self.logp, self.contexts, self.logw = langs, {}, {}, {}, {}
        self.floor = np.log([p["floor"] for p in parts]).astype(np.float32)
        self.mean, self.texts, self.symbols = np.full(len(langs), np.log(64.0)), np.ones(len(langs)), np.full(len(langs), 2.0)
        before = None
        for n in range(1, ORDER + 1):
            contexts = np.unique(np.concatenate([p[n][2] for p in parts]))
            weight = np.zeros((len(contexts), len(langs)))
            for k, p in enumerate(parts):
                weight[np.searchsorted(contexts, p[n][2]), k] = np.log(p[n][3])
            grams = np.unique(np.concatenate([p[n][0] for p in parts]))
            # Where a language lacks a gram that another has: its backoff weight and its own lower order.
            cut = (U64(1) << U64(16 * (n - 1))) - U64(1)
            lower = np.tile(self.floor.astype(float), (len(grams), 1)) if n == 1 else before[1][np.searchsorted(before[0], grams & cut)]
            logp = weight[np.searchsorted(contexts, grams >> U64(16))] + lower
            for k, p in enumerate(parts):
                logp[np.searchsorted(grams, p[n][0]), k] = np.log(p[n][1])
            before = grams, logp
            for code, values, keys, kept in ((grams, logp, self.grams, self.logp), (contexts, weight, self.contexts, self.logw)):
                order = np.argsort(hash_of := hashed(code, n))
                keys[n], kept[n] = HashArray(hash_of[order]), values[order].astype(np.float32)

    def log_probabilities(self, syms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row a position, a column a language: one search at the highest order, lower ones for what is missing."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            here = at[left]
            found = self.grams[n].find(hashed(codes(syms, here, n), n))
            hit = found >= 0
            out[left[hit]] += self.logp[n][found[hit]]
            left, here = left[~hit], here[~hit]
            if not len(left):
                return out
            context = self.contexts[n].find(hashed(codes(syms, here, n - 1, 1), n))
            seen = context >= 0
            out[left[seen]] += self.logw[n][context[seen]]
        out[left] += self.floor
        return out

    def entropies(self, column: pa.Array, variances: bool = False) -> tuple[np.ndarray, ...]:
        """(cross-entropy by text and language in nats a symbol, symbols, whether there is a letter), and with variances
        how the symbols of each text vary about it."""
        data, offsets = batch_bytes(column)
        syms, edges = symbols(data, offsets)
        at, counts = own_positions(edges)
        total, squares = np.zeros((len(counts), len(self.langs))), np.zeros((len(counts), len(self.langs)))
        letters = np.zeros(len(counts), bool)
        some = np.flatnonzero(counts)
        if len(some):
            begin = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
            logs = self.log_probabilities(syms, at)
            total[some] = np.add.reduceat(logs, begin, axis=0, dtype=np.float64)
            if variances:
                squares[some] = np.add.reduceat(logs.astype(np.float64) ** 2, begin, axis=0)
            letters[some] = np.maximum.reduceat(syms[at], begin) > 0
        n = np.maximum(counts, 1)[:, None]
        out = -total / n, counts, letters
        return (*out, squares / n - (total / n) ** 2) if variances else out

    def calibrate(self, entropies: np.ndarray, labels: np.ndarray, counts: np.ndarray, variances: np.ndarray) -> None:
        """From left-out texts: the mean of each language, by its longer texts, and how texts and symbols deviate."""
        for k in range(len(self.langs)):
            own = labels == k
            if not own.any():
                continue
            long = own & (counts >= LONG) if (own & (counts >= LONG)).sum() >= FEW else own
            self.mean[k] = np.average(entropies[long, k], weights=counts[long])
            apart = 1.4826 * np.median(np.abs(entropies[long, k] - self.mean[k]))
            self.texts[k] = max(FLOOR_TEXTS, apart) if long.sum() >= FEW else max(UNSURE_TEXTS, apart)
            self.symbols[k] = max(FLOOR_SYMBOLS, np.sqrt(np.average(variances[own, k], weights=counts[own])))

    def decide(self, entropies: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, score, rejected)."""
        best = entropies.argmin(1)
        low = entropies[np.arange(len(best)), best]
        score = 1.0 / np.exp((low[:, None] - entropies) * counts[:, None]).sum(1)
        deviation = np.sqrt(self.texts[best] ** 2 + self.symbols[best] ** 2 / np.maximum(counts, 1))
        rejected = ~letters | (low > self.mean[best] + REJECT_SIGMAS * deviation)
        return np.where(letters, best, -1), np.where(letters, score, 0.0), rejected


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most sample_rows rows of each language; one task a language, the driver merges the bounded models."""
    rows = docs.filter(F.col(lang).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # Thin by hash first, so that the ranking sees about twice the sample.
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 2.0 * sample_rows / n)))])[F.col("lang")]
    thin = rows.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    ranked = thin.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("place") <= sample_rows)
    chosen = ranked.groupBy("lang", "id").agg(F.min("place").alias("place"))
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    sample = texts.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "place", "text")
    fields = ["grams", "p", "contexts", "weight"]

    def one(group: pa.Table) -> pa.Table:
        places = np.asarray(group["place"])
        mine = group.filter(pa.array(places % CALIBRATE_EVERY != 1)) if len(places) > CALIBRATE_EVERY else group
        syms, edges = symbols(*batch_bytes(mine["text"]))
        if not len(own_positions(edges)[0]):
            syms, edges = np.zeros(ORDER, np.uint16), np.array([ORDER - 1, 2 * ORDER - 1])
        model = kneser_ney(syms, edges)
        out = {"lang": [group["lang"][0].as_py()] * ORDER, "n": list(range(1, ORDER + 1)), "floor": [model["floor"]] * ORDER}
        out |= {f: [model[n][i].tobytes() for n in range(1, ORDER + 1)] for i, f in enumerate(fields)}
        return pa.table(out)

    got = sample.groupBy("lang").applyInArrow(lean_group(one), "lang string, n long, floor double, " + ", ".join(f"{f} binary" for f in fields)).collect()
    parts: dict[str, dict] = {}
    for r in got:
        part = parts.setdefault(r.lang, {"floor": r.floor})
        part[r.n] = tuple(np.frombuffer(r[f], U64 if f in ("grams", "contexts") else np.float64) for f in fields)
    if not parts:
        return None
    langs = sorted(parts)
    model = Model(langs, [parts[k] for k in langs])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, counts, letters, variances = shared.value.entropies(batch.column(1), True)
            lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (entropy, variances)]
            yield pa.record_batch([batch.column(0), pa.array(letters), pa.array(counts), *lists], names=["lang", "letters", "n", "e", "v"])

    rest = sample.filter(F.col("place") % CALIBRATE_EVERY == 1).select("lang", "text").mapInArrow(lean(left_out), "lang string, letters boolean, n long, e array<double>, v array<double>").filter("letters").collect()
    if rest:
        model.calibrate(np.array([r.e for r in rest]), np.array([langs.index(r.lang) for r in rest]), np.array([r.n for r in rest]), np.array([r.v for r in rest]))
    shared.unpersist()
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, rejected) of every row; or, with keep, these columns of the rows that aren't rejected."""
    columns = keep if keep is not None else [id_col]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*columns, F.col(text).cast("string").cast("binary").alias(free_name("whole", columns)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j in text_parts(batch.column(len(columns)), _PART_BYTES):
                part = batch.slice(i, j - i)
                if model is None:
                    pred, score, rejected = np.full(j - i, -1), np.zeros(j - i), np.ones(j - i, bool)
                else:
                    pred, score, rejected = model.decide(*model.entropies(part.column(len(columns))))
                found = pa.array([model.langs[k] if k >= 0 else "und" for k in pred], pa.string())
                own = part.columns[: len(columns)]
                if keep is None:
                    yield pa.record_batch([*own, found, pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])
                else:
                    yield pa.record_batch(own, names=columns).filter(pa.array(~rejected))

    if keep is None:
        return source.mapInArrow(lean(each), f"id {source.dtypes[0][1]}, lang_pred string, score double, rejected boolean")
    return source.mapInArrow(lean(each), docs.select(*columns).schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs)).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
