"""Exact dedup over an extendible-hash index kept as files in the shared folder.

Keys are the texts without blanks, addressed by the leading bits of their XXH64. The directory starts at the bits that
evenly spread keys need and doubles, by aggregates over the hashes alone, as long as a bucket holds more distinct keys than its capacity; then
buckets that needn't be so deep are merged back, so several directory slots share one bucket. Every key goes through
its slot to its bucket. The tasks that own a bucket's keys group them on hash and bytes: texts of one hash form a chain
whose members are told apart by their bytes, and the entry of a member holds how many rows have it and the row that
stays, with all that is asked of that row. Copies of one text are a single key: they never overfill a bucket and are
pre-aggregated before every shuffle. Index files are sorted by bucket; they cover ranges of buckets, but where entries
carry whole rows. Lookups go by slot, bucket, hash and, for the
place in the chain, SHA-256.

All is DataFrame code; the driver sees depths and numbers only. The directory has as many rows as slots; it is broadcast
up to BROADCAST_SLOTS of them, and joined by slot beyond that.

Defined results. Null text counts as empty; all empty texts are equal. Ids may be of any type that has an order. A null
id loses to any other id of the same length. Rows that repeat an id and a text are copies like any other: exactly one
row of a group is kept. Empty tables give empty results. Other columns of the input are not read by exact_groups,
whatever their names, and carried along untouched by drop_copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, saved, table, tasks, text_or_empty

#: Distinct keys a bucket holds before it splits; bits the directory has at least; slots up to which it is broadcast.
BUCKET_KEYS, FIRST_DEPTH, BROADCAST_SLOTS = 1 << 16, 4, 1 << 18


def squeeze(column: Column) -> Column:
    return F.translate(column, BLANKS, "")


def slot_of(h: Column, depth: int) -> Column:
    """Directory slot of a hash: its leading bits."""
    return F.shiftrightunsigned(h, 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """((slot, bucket, local_depth) of every slot, depth) for distinct hashes h.

    The depth doubles the directory until no slot holds more than capacity. A bucket is the widest run of slots, a power
    of two of them, that doesn't; it is named by its first slot. Only a hash shared by more texts than capacity overfills
    a bucket, as its 64 bits can't be split any further."""
    keys = saved(keys, "exact-keys")
    depth = max(FIRST_DEPTH, (keys.count() // capacity).bit_length())
    while True:
        counts = saved(keys.groupBy(slot_of(F.col("h"), depth).alias("slot")).agg(F.count("*").alias("n")), "exact-slots")
        if depth >= 60 or not counts.filter(F.col("n") > capacity).limit(1).count():
            break
        depth += 2
    # Nodes of all depths with their keys; the widest ones that fit are the buckets.
    up = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("at")
    shift = lambda name, column, bits: F.call_function(name, F.col(column) if isinstance(column, str) else column, bits)
    above = shift("shiftright", "slot", F.lit(depth) - F.col("at")).alias("node")
    nodes = counts.select("slot", "n", up).groupBy("at", above).agg(F.sum("n").alias("n"))
    fits = nodes.filter(F.col("n") <= capacity).select("at", "node")
    covered = counts.select("slot", up).select("slot", "at", above)
    local = covered.join(fits, ["at", "node"]).groupBy("slot").agg(F.min("at").alias("local_depth"))
    slots = counts.select("slot").join(local, "slot", "left").withColumn("local_depth", F.coalesce("local_depth", F.lit(depth)))
    back = F.lit(depth) - F.col("local_depth")
    directory = slots.select("slot", shift("shiftleft", shift("shiftright", "slot", back), back).alias("bucket"), "local_depth")
    return saved(directory, "exact-directory"), depth


class ExtendibleIndex:
    """One row per distinct text: (bucket, local_depth, h, chain, sha, n, kept); built by build()."""

    def __init__(self, entries: DataFrame, directory: DataFrame, depth: int):
        self.entries, self.directory, self.depth = entries, directory, depth
        self.small = directory.limit(BROADCAST_SLOTS + 1).count() <= BROADCAST_SLOTS

    def addressed(self, rows: DataFrame) -> DataFrame:
        """Rows with a hash h, with the bucket that the directory gives for it."""
        directory = F.broadcast(self.directory) if self.small else self.directory
        return rows.withColumn("slot", slot_of(F.col("h"), self.depth)).join(directory, "slot").drop("slot")

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS, carry: list[str] | None = None) -> ExtendibleIndex:
        """carry: columns of docs that the entry holds of the row that stays."""
        spark = docs.sparkSession
        whole = text_or_empty(text)
        rank = F.struct((-F.length(whole)).alias("less"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
        kept = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])], F.lit(0).alias("pad"))
        rows = docs.select(squeeze(whole).alias("body"), rank.alias("rank"), kept.alias("kept")).withColumn("h", F.xxhash64("body"))
        index = cls(None, *grow_directory(rows.select("h").distinct(), capacity))
        # The owner of a key groups on its bytes; partial aggregates bring one row a distinct text and task.
        best = [F.min("rank").alias("rank"), F.min_by("kept", "rank").alias("kept")] if carry else [F.min("rank").alias("rank")]
        members = index.addressed(rows).groupBy("bucket", "local_depth", "h", "body").agg(F.count("*").alias("n"), *best)
        chained = members.select("bucket", "local_depth", "h", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "n", "rank", *(["kept"] if carry else []))
        # Entries that carry whole rows stay where their owners made them; moving them again would cost as much as the texts.
        placed = chained if carry else chained.repartitionByRange(tasks(spark), "bucket", "h")
        index.entries = saved(placed.sortWithinPartitions("bucket", "h", "sha"), "exact-index")
        return index


def probe_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, h, sha, length) of every row, as a written table, so that row numbers hold."""
    body = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("t")).select("id", F.length("t").alias("length"), squeeze(F.col("t")).alias("body"))
    return saved(
        body.select("id", F.monotonically_increasing_id().alias("row"), "length", F.xxhash64("body").alias("h"), F.sha2(F.col("body").cast("binary"), 256).alias("sha")),
        "exact-probe",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: id, h, length, keep_id, group_size, kept, text_sha256."""
    index = ExtendibleIndex.build(docs, id_col, text, capacity)
    probe = index.addressed(probe_rows(docs, id_col, text))
    found = saved(probe.join(index.entries.drop("local_depth"), ["bucket", "h", "sha"]).drop("local_depth"), "exact-found")
    stays = (F.col("length") == -F.col("rank.less")) & F.col("id").eqNullSafe(F.col("rank.id"))
    # Rows that repeat the id and the text of the one that stays: the first of them does.
    first = found.filter(stays).groupBy("bucket", "h", "sha").agg(F.min("row").alias("first"))
    return found.join(first, ["bucket", "h", "sha"]).select(
        "id", "h", "length", F.col("rank.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = BUCKET_KEYS) -> DataFrame:
    """The kept rows with all their columns, out of the index's entries."""
    entries = ExtendibleIndex.build(docs, id_col, text, capacity, carry=docs.columns).entries
    return entries.select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY body) AS group_size
  FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, pos = 1 AS kept, sha256(body) AS text_sha256 FROM r
"""
