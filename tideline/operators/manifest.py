"""The file set: edits replayed into the current layout, level scores, overlaps, recovery checks.

Files are rows (level, number, file_size, smallest, largest). File metadata is small beside the data it describes, yet
everything but single-row answers stays distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Ranges, literal, seek

# Fixed values of the storage layout.
LEVELS, L0_FILES, L1_BYTES, LEVEL_GROWTH = 7, 4, 10 * 1024 * 1024, 10
MAX_FILE_BYTES, MAX_OUTPUT_LEVEL, SEEK_BYTES, LEAST_SEEKS = 2 * 1024 * 1024, 2, 16384, 100
GRANDPARENT_BYTES = 10 * MAX_FILE_BYTES
MAX_NUMBER = "18446744073709551615"


def level_limit(level: Column) -> Column:
    """Bytes a level may hold: level 0 and 1 alike, then ten times as much each."""
    return F.lit(float(L1_BYTES)) * F.pow(F.lit(float(LEVEL_GROWTH)), F.greatest(level - 1, F.lit(0)).cast("double"))


def level_scores(files: DataFrame) -> DataFrame:
    """Files, bytes and score of levels 0 to 5, empty ones too. Level 0 scores by files, the others by bytes."""
    spark = files.sparkSession
    levels = spark.range(LEVELS - 1).select(F.col("id").cast("int").alias("level"))
    sums = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    all_levels = levels.join(sums, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    score = F.when(F.col("level") == 0, F.col("files") / float(L0_FILES)).otherwise(F.col("bytes") / level_limit(F.col("level")))
    return all_levels.withColumn("score", score)


def pick_compaction(files: DataFrame) -> DataFrame:
    """The level of the greatest score; ties go to the lowest level."""
    return level_scores(files).orderBy(F.col("score").desc(), "level").limit(1).select("level", "score")


def find_file(files: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target t and level, the first file whose largest key is at or after t: level, t, largest, number."""
    levels = [r.level for r in files.select("level").distinct().orderBy("level").collect()]  # seven at most
    if not levels:
        return targets.select(F.lit(0).alias("level"), "t", "t", F.lit(0).alias("number")).toDF("level", "t", "largest", "number").limit(0)
    asked = targets.select("t").distinct().withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    found = seek(files, "largest", asked, "t", name="largest", by="level").filter("largest is not null")
    first = files.groupBy("level", "largest").agg(F.min("number").alias("number"))
    return found.join(first, ["level", "largest"]).select("level", "t", "largest", "number")


def overlaps(files: DataFrame, ranges: DataFrame, bins: int | None = None) -> DataFrame:
    """Pairs of ranges (range_id, lo, hi) and files whose closed intervals meet; null bounds are open. Keys of any type.

    Both sides go to the bins of the key space that they touch, and a pair counts in the first bin the two share. Bins
    hold about as many file bounds each, as many bins as there are shuffle partitions."""
    bounds = files.select(F.col("smallest").alias("k")).unionByName(files.select(F.col("largest").alias("k")))
    cut = Ranges(bounds, "k", count=bins)
    last = F.lit(len(cut.bounds))
    low = F.when(F.col("lo").isNull(), 0).otherwise(cut.of(F.col("lo")))
    high = F.when(F.col("hi").isNull(), last).otherwise(cut.of(F.col("hi")))
    r = ranges.filter("lo is null or hi is null or lo <= hi").withColumn("_from", low).withColumn("_bin", F.explode(F.sequence("_from", high)))
    f = files.withColumn("_first", cut.of(F.col("smallest"))).withColumn("_bin", F.explode(F.sequence("_first", cut.of(F.col("largest")))))
    meet = (F.col("lo").isNull() | (F.col("lo") <= F.col("largest"))) & (F.col("hi").isNull() | (F.col("smallest") <= F.col("hi")))
    pairs = r.join(f, "_bin").filter(meet & (F.col("_bin") == F.greatest("_from", "_first")))
    return pairs.drop("_bin", "_from", "_first")


def overlap_sums(files: DataFrame, ranges: DataFrame, bins: int | None = None) -> DataFrame:
    """How many files overlap each range at each level, and their bytes: range_id, level, files, bytes, where there are any.
    What grouping the pairs of overlaps gives, without making them.

    A file whose keys are in order misses a range if it begins after the range's end or ends before its begin, never both.
    So the files a level has up to the end, by their smallest keys, less those before the begin, by their largest ones, are
    those that overlap. Both are running sums over bins of the key order; a pass over files gives the sums of earlier bins.
    Files without both keys in order (there should be none) are paired."""
    kind = files.schema["level"].dataType
    ordered = F.coalesce(F.col("smallest") <= F.col("largest"), F.lit(False))
    size = F.coalesce("file_size", F.lit(0))
    ends = F.when(ordered, F.array(F.struct(F.col("smallest").alias("x"), F.lit(True).alias("begins")), F.struct(F.col("largest").alias("x"), F.lit(False).alias("begins"))))
    points = files.select("level", F.explode_outer(ends).alias("end"), size.alias("size")).select("level", "end.x", "end.begins", "size")
    # One row a level, key and side, however many files share it; files without keys in order have no side.
    held = points.groupBy("level", "x", "begins").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    proper = ranges.filter("lo is null or hi is null or lo <= hi").select("range_id", "lo", "hi")
    keys = files.select(F.explode(F.array("smallest", "largest")).alias("k"))
    cut = Ranges(keys.unionByName(proper.select(F.col("lo").alias("k"))).filter("k is not null"), "k", count=bins)
    last = len(cut.bounds) + 1  # a bin beyond all, for open ends

    facts = held.withColumn("_bin", cut.of(F.col("x"))).groupBy("_bin", "level", "begins").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()
    paired = overlaps(files.filter(~ordered), ranges, bins).groupBy("range_id", "level").agg(F.count("*").alias("files"), F.sum(size).alias("bytes")) if any(r.begins is None for r in facts) else None
    facts, held = [r for r in facts if r.begins is not None], held.filter("begins is not null")
    levels = sorted({r.level for r in facts}, key=lambda x: (x is None, x))
    if not levels:
        none = ranges.select("range_id", F.lit(None).cast(kind).alias("level"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes")).limit(0)
        return none if paired is None else paired
    before = {(level, begins): [(0, 0)] * (last + 1) for level in levels for begins in (True, False)}
    of = {(r._bin, r.level, r.begins): (r.n, r.b) for r in facts}
    for (level, begins), sums in before.items():
        for i in range(1, last + 1):
            n, b = of.get((i - 1, level, begins), (0, 0))
            sums[i] = (sums[i - 1][0] + n, sums[i - 1][1] + b)
    number = F.coalesce(*[F.when(F.col("level").eqNullSafe(F.lit(x)), i) for i, x in enumerate(levels)])
    total = held.schema["b"].dataType.simpleString()
    rows = [(i, bin, begins, *sums) for i, level in enumerate(levels) for begins in (True, False) for bin, sums in enumerate(before[level, begins])]
    earlier = files.sparkSession.createDataFrame(rows, f"_level int, _bin int, begins boolean, n0 long, b0 {total}")

    # Asked are the sums up to a range's end, itself included, and before its begin; an open begin has nothing before it.
    ask = lambda c, begins: proper.select("range_id", F.col(c).alias("x"), F.lit(begins).alias("begins"))
    asked = ask("hi", True).unionByName(ask("lo", False).filter("x is not null"))
    asked = asked.withColumn("_bin", F.when(F.col("x").isNull(), last).otherwise(cut.of(F.col("x")))).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    rows = held.select("x", "begins", "n", "b", cut.of(F.col("x")).alias("_bin"), number.alias("_level")).unionByName(asked, allowMissingColumns=True)
    queried = F.when(F.col("n").isNull(), F.when(F.col("begins"), 1).otherwise(-1)).otherwise(0)
    w = Window.partitionBy("_level", "begins", "_bin").orderBy("x", queried).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("range_id", "_level", "begins", "_bin", queried.alias("sign"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in "nb"]).filter("sign <> 0")
    found = sums.join(F.broadcast(earlier), ["_level", "_bin", "begins"]).groupBy("range_id", "_level").agg(
        F.sum(F.col("sign") * (F.col("n") + F.col("n0"))).alias("files"), F.sum(F.col("sign") * (F.col("b") + F.col("b0"))).alias("bytes")
    )
    named = F.element_at(F.array(*[F.lit(x).cast(kind) for x in levels]), F.col("_level") + 1)
    out = found.filter("files > 0").select("range_id", named.alias("level"), "files", "bytes")
    return out if paired is None else out.unionByName(paired).groupBy("range_id", "level").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def overlap_closure(files: DataFrame, lo: object, hi: object) -> DataFrame:
    """Files of level 0 in the connected component of intervals that holds the range; null bounds are open.

    In order of their first keys, intervals begin a new component where they lie beyond all ends before them: the ends
    before them in their range of keys, and the greatest end of all earlier ranges. The range belongs to the last
    component that begins at or before it, and takes in all that begin before the next one."""
    zero = files.filter("level = 0").select("number", "smallest", "largest")
    kind = zero.schema["smallest"].dataType
    ends = zero.agg(F.min("smallest"), F.max("largest")).first()
    lo, hi = (ends[0] if lo is None else lo), (ends[1] if hi is None else hi)
    if lo is None or hi is None:
        return zero
    asked = files.sparkSession.range(1).select(literal(lo, kind).alias("smallest"), literal(hi, kind).alias("largest"))
    cut = Ranges(zero, "smallest")
    rows = zero.select("smallest", "largest").unionByName(asked).withColumn("_range", cut.of(F.col("smallest")))
    most = {r._range: r.most for r in rows.groupBy("_range").agg(F.max("largest").alias("most")).collect()}
    before, held = [], None
    for i in range(len(cut.bounds) + 1):
        before.append(held)
        held = max((x for x in (held, most.get(i)) if x is not None), default=None)
    inside = F.max("largest").over(Window.partitionBy("_range").orderBy("smallest", "largest").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.greatest(inside, cut.lookup(before, kind))
    starts = rows.withColumn("_ahead", ahead).filter(F.col("_ahead").isNull() | (F.col("smallest") > F.col("_ahead")))
    at = literal(lo, kind)
    low, high = starts.agg(F.max(F.when(F.col("smallest") <= at, F.col("smallest"))), F.min(F.when(F.col("smallest") > at, F.col("smallest")))).first()
    found = zero.filter(F.col("smallest") >= literal(low, kind))
    return found if high is None else found.filter(F.col("smallest") < literal(high, kind))


def output_level(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Level to which a flush of each range (range_id, lo, hi) goes."""
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("level") == n, F.col(c))), F.lit(0))
    hits = overlap_sums(files, ranges).groupBy("range_id").agg(*[of(n, "files").alias(f"c{n}") for n in (0, 1, 2)], *[of(n, "bytes").alias(f"b{n}") for n in (2, 3)])
    rows = ranges.select("range_id").join(hits, "range_id", "left").fillna(0)
    far = lambda n: F.col(f"b{n}") > GRANDPARENT_BYTES
    level = F.when((F.col("c0") > 0) | (F.col("c1") > 0) | far(2), 0).when((F.col("c2") > 0) | far(3), 1).otherwise(MAX_OUTPUT_LEVEL)
    return rows.select("range_id", level.alias("level"))


def allowed_seeks(files: DataFrame) -> DataFrame:
    """Seeks a file stands before it is compacted."""
    return files.select("number", F.greatest(F.lit(LEAST_SEEKS).cast("long"), F.floor(F.col("file_size") / SEEK_BYTES).cast("long")).alias("allowed_seeks"))


def replay(events: DataFrame) -> DataFrame:
    """Live files after all edits. events: edit_no, level, number, kind (0 delete, 1 add); in one edit deletes come first."""
    rank = F.col("edit_no") * 2 + F.col("kind")
    last = events.groupBy("level", "number").agg(F.max("edit_no").alias("edit_no"), F.max_by("kind", rank).alias("kind"))
    return last.filter("kind = 1").select("level", "number", "edit_no")


def replay_scalars(edits: DataFrame, *names: str) -> DataFrame:
    """Last value that isn't null of each counter."""
    return edits.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("edit_no"))).alias(n) for n in names])


def disjoint_violations(files: DataFrame) -> DataFrame:
    """Files of levels above 0 that begin at or before the end of their predecessor."""
    w = Window.partitionBy("level").orderBy("smallest", "largest", "number")
    return files.filter("level > 0").withColumn("before", F.lag("largest").over(w)).filter("before >= smallest").select("level", "number", "smallest", "before")


def live_files(*versions: DataFrame) -> DataFrame:
    numbers = [v.select("number") for v in versions]
    out = numbers[0]
    for n in numbers[1:]:
        out = out.unionByName(n)
    return out.distinct()


def missing_files(live: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Live numbers that no file on disk has."""
    return live.select("number").distinct().join(on_disk.select("number"), "number", "left_anti")


def obsolete_files(on_disk: DataFrame, live: DataFrame, log_number: int, prev_log: int) -> DataFrame:
    """Parsed files (number, type) that nothing needs: dead tables and temporaries, logs that were replayed."""
    needed = (F.col("type") == "log") & ((F.col("number") >= log_number) | (F.col("number") == prev_log))
    kept = F.col("type").isin("current", "lock", "info_log", "manifest") | needed
    numbered = on_disk.filter(~F.coalesce(kept, F.lit(False)) & F.col("type").isNotNull())
    return numbered.join(live.select("number").distinct(), "number", "left_anti")


def select_logs(logs: DataFrame, log_number: int, prev_log: int) -> DataFrame:
    """Logs to be replayed."""
    return logs.filter((F.col("number") >= log_number) | (F.col("number") == prev_log)).select("number")


def next_file_number(next_number: int, *used: DataFrame) -> DataFrame:
    return live_files(*used).agg(F.greatest(F.lit(next_number).cast("long"), F.max("number") + 1).alias("next_file_number"))


def parse_name(name: Column) -> tuple[Column, Column]:
    """(number, type) of a file name; nulls if it is none of ours. Numbers are unsigned and of 64 bits, as decimal(20,0)."""
    digits = F.regexp_extract(name, r"([0-9]+)", 1)
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 20, digits.cast("decimal(38,0)"))
    fits = number <= F.lit(MAX_NUMBER).cast("decimal(38,0)")
    kinds = [(r"^MANIFEST-[0-9]+$", "manifest"), (r"^[0-9]+\.log$", "log"), (r"^[0-9]+\.(sst|ldb)$", "table"), (r"^[0-9]+\.dbtmp$", "temp")]
    plain = F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.isin("LOG", "LOG.old"), "info_log")
    numbered = F.coalesce(*[F.when(name.rlike(pattern) & fits, kind) for pattern, kind in kinds])
    kind = F.coalesce(plain, numbered)
    return F.when(plain.isNotNull(), F.lit(0)).when(numbered.isNotNull(), number).cast("decimal(20,0)"), kind


def format_name(number: Column, kind: str) -> Column:
    """File name of a number: six digits at least."""
    digits = F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    return F.concat(F.lit("MANIFEST-"), digits) if kind == "manifest" else F.concat(digits, F.lit({"log": ".log", "table": ".ldb", "temp": ".dbtmp"}[kind]))
