"""Secret scanning through an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. Each rule has a version of its own. The ledger,
a folder of Parquet batches, says which pairs of a blob and a rule's version were scanned and what was found; a scan
runs just the rules that the ledger lacks for a blob, appends what they find, and joins the findings of all rules back to
all paths that ever held the blob. So copies are scanned once, in whatever batch they come, and a rule that is added or
changed costs one scan by itself.

Match positions come from SQL alone: each match is wrapped in two marker characters, the text is split at the markers,
and running lengths of the pieces give code point offsets; pieces are summed up in chunks, so that a text of many
matches costs no square. Markers that occur in a text are first replaced by another character outside every rule's
alphabet, one for one, so offsets hold.

The query takes the sources in two rounds, as repositories would come, the first with the base rules alone; the second
covers all rows with the base rules and those this module adds (private key headers, credentials in URLs). Base spans
are what they would be without the added ones.

Defined results. Null content counts as empty. A null path is a path like any other. Rows that repeat a path and a
content are separate versions and each gets the blob's findings. Empty tables give empty results. Other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path, table, text_or_empty, write_table

# The rules, in the order in which kinds are listed.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
URL = r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"
KINDS = ("assign", "access", "hex", "pem", "url")

OPEN, CLOSE, STAND_IN = "\x01", "\x02", "!"

SPAN = "struct<start:int,kind:int,stop:int>"
#: Pieces of a text that are summed up at once; even, as every other piece is a match.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """kind: place in KINDS; holds: which matches of the pattern count; hint: what a text that has one must match."""

    kind: int
    version: int
    pattern: str
    holds: Callable[[Column], Column]
    hint: str

    @property
    def name(self) -> str:
        return f"{KINDS[self.kind]}@{self.version}"


# A greedy run takes all its hex digits, so asking for 32 at once finds the same runs as dropping shorter ones later.
BASE_RULES = (
    Rule(0, 1, ASSIGN, lambda p: F.length(F.regexp_extract(p, ASSIGN, 2)) >= 8, ASSIGN),
    Rule(1, 1, ACCESS, lambda p: F.length(p) >= 16, r"AKIA[A-Z0-9]{12}"),
    Rule(2, 1, HEX, lambda p: F.length(p) >= 32, HEX),
)
RULES = (*BASE_RULES, Rule(3, 1, PEM, lambda p: F.lit(True), PEM), Rule(4, 1, URL, lambda p: F.lit(True), URL))


def _matches(text: Column, pattern: str) -> Column:
    """Pieces of the text; those at odd indexes are the matches of the pattern."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def _spans(pieces: Column, rule: Rule) -> Column:
    """Spans of the odd pieces that hold, in order."""
    none = F.array().cast(f"array<{SPAN}>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda c: F.slice(pieces, c * CHUNK + 1, F.lit(CHUNK)))
    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.length(p)))
    heads = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

    def of_chunk(chunk: Column, number: Column) -> Column:
        begin = F.struct(F.get(heads, number).alias("at"), F.lit(0).alias("i"), none.alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            stop = acc["at"] + F.length(piece)
            span = F.struct(acc["at"].alias("start"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
            hit = (acc["i"] % 2 == 1) & rule.holds(piece)
            return F.struct(stop.alias("at"), (acc["i"] + 1).alias("i"), F.when(hit, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, begin, step, lambda acc: acc["out"])

    return F.flatten(F.transform(chunks, of_chunk))


def find_spans(text: Column, rules: Iterable[Rule] = BASE_RULES, wanted: Callable[[Rule], Column] | None = None) -> Column:
    """Spans of a text as an array of (start, kind, stop), by start, then kind as listed; of the rules that wanted allows."""
    clean = F.translate(text, OPEN + CLOSE, STAND_IN * 2)
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for rule in rules:
        # rlike first: most texts hold no match long enough, and splitting them would only copy them.
        some = clean.rlike(rule.hint) if wanted is None else wanted(rule) & clean.rlike(rule.hint)
        found.append(F.when(some, _spans(_matches(clean, rule.pattern), rule)).otherwise(none))
    return F.array_sort(F.concat(*found))


def joined_spans(spans: Column) -> Column:
    named = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return F.concat_ws(",", named)


class BlobLedger:
    """Batches of (blob, scanned, spans) under one path: the rules that a batch ran on a blob, by name and version, and
    the spans that they found, with the version of their rule."""

    SCHEMA = "blob string, scanned array<string>, spans array<struct<start:int,kind:int,stop:int,version:int>>"

    def __init__(self, spark: SparkSession, path: str, rules: Iterable[Rule] = RULES):
        self.spark, self.path, self.rules = spark, path, tuple(rules)

    def batches(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def scanned(self) -> DataFrame:
        """(blob, done): the rules that some batch ran on the blob. A blob has a row in a batch only if one was new to it."""
        return self.batches().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))

    def read(self) -> DataFrame:
        """(blob, spans) of the blobs that all of these rules have seen, with the spans of their versions."""
        names = F.array(*[F.lit(r.name) for r in self.rules])
        whole = self.batches().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"), F.flatten(F.collect_list("spans")).alias("all"))
        current = F.filter("all", lambda s: F.coalesce(*[F.when(s["kind"] == r.kind, s["version"] == r.version) for r in self.rules], F.lit(False)))
        plain = F.transform(current, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
        return whole.filter(F.size(F.array_except(names, "done")) == 0).select("blob", F.array_sort(plain).alias("spans"))

    def scan(self, versions: DataFrame, content: str) -> None:
        """Run on each blob the rules that the ledger lacks for it, and append what they find."""
        names = F.array(*[F.lit(r.name) for r in self.rules])
        blobs = versions.select(F.sha2(text_or_empty(content).cast("binary"), 256).alias("blob"), text_or_empty(content).alias("text"))
        # One copy of each blob; partial aggregation drops the others before the shuffle.
        once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        lacking = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
        todo = once.join(self.scanned(), "blob", "left").select("blob", "text", lacking.alias("scanned")).filter(F.size("scanned") > 0)
        spans = find_spans(F.col("text"), self.rules, lambda r: F.array_contains("scanned", r.name))
        version = lambda kind: F.coalesce(*[F.when(kind == r.kind, F.lit(r.version)) for r in self.rules])
        found = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), version(s["kind"]).alias("version")))
        write_table(todo.select("blob", "scanned", found.alias("spans")), self.path, "append")


def scan_versions(versions: DataFrame, ledger: BlobLedger, path: str = "doc_id", content: str = "text") -> DataFrame:
    """(path, blob, spans) for every version, old blobs and new."""
    rows = saved(versions.select(F.col(path).alias("path"), F.sha2(text_or_empty(content).cast("binary"), 256).alias("blob")), "secret-paths")
    ledger.scan(versions, content)
    return rows.join(ledger.read(), "blob")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = scratch_path(spark, "secret-ledger")
    first = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(2)) == 0
    BlobLedger(spark, path, BASE_RULES).scan(docs.filter(first), "text")
    rows = scan_versions(docs, BlobLedger(spark, path))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    return rows.select(
        F.col("path").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def _duck_spans(kind: int, pattern: str, keep: str) -> str:
    pieces = f"string_split_regex(regexp_replace(body, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]')"
    ends = "list_transform(p, lambda x, i: list_sum(list_transform(p[1:i], lambda y: length(y))))"
    return f"""
  SELECT id, {kind} AS kind, unnest(p) AS piece, unnest({ends}) AS stop, unnest(range(len(p))) AS i, '{keep}' AS rule
  FROM (SELECT id, {pieces} AS p FROM d)"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '!!') AS body FROM documents),
pieces AS ({_duck_spans(0, _quoted(ASSIGN), "a")} UNION ALL {_duck_spans(1, ACCESS, "b")} UNION ALL {_duck_spans(2, HEX, "c")}
  UNION ALL {_duck_spans(3, PEM, "d")} UNION ALL {_duck_spans(4, URL, "e")}),
hits AS (
  SELECT id, kind, CAST(stop AS BIGINT) - length(piece) AS start, CAST(stop AS BIGINT) AS stop FROM pieces
  WHERE i % 2 = 1 AND CASE kind WHEN 0 THEN length(regexp_extract(piece, '{_quoted(ASSIGN)}', 2)) >= 8 WHEN 1 THEN length(piece) >= 16 WHEN 2 THEN length(piece) >= 32 ELSE true END),
named AS (SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' WHEN 3 THEN 'pem' ELSE 'url' END || ':' || start || ':' || stop AS span FROM hits),
s AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (id)
"""
