"""Ordered access without a single-task sort: positions, seeks and neighbours over ranges of the key order.

Rows are cut into ranges by bounds from a bounded, ordered sample, as a range partitioner does, on the whole sort order: a
key of many rows is cut by the columns that follow it. Keys may be of any type that has an order; binary keys sort by
unsigned bytes, nulls come first. One counting pass over the ranges (rows, least and greatest key of each) links them;
each range is then ordered by itself. What the driver sees is the sample and a row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each range; most ranges that one expression tells apart.
SAMPLE_ROWS, MOST_RANGES = 32, 2048


def parse(order: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(column, descending) of columns named as "c" or "-c"."""
    return [(c.lstrip("-"), c.startswith("-")) for c in order]


def sort_columns(order: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    return [F.col(c).desc() if down != reverse else F.col(c).asc() for c, down in order]


def literal(value: object, kind) -> Column:
    return F.lit(bytearray(value) if isinstance(value, (bytes, bytearray)) else value).cast(kind)


class Ranges:
    """Ranges of df's rows in an order; df is read once for the sample."""

    def __init__(self, df: DataFrame, *order: str, count: int | None = None):
        self.order = parse(order)
        self.kinds = [df.schema[c].dataType for c, _ in self.order]
        columns = [F.col(c) for c, _ in self.order]
        count = min(MOST_RANGES, count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.bounds: list[tuple] = []
        if count > 1:
            # The least hashes of the rows: a fair sample that comes out alike each time, whatever the partitions.
            named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
            names = named.columns
            sample = named.orderBy(F.xxhash64(*names), *names).limit(SAMPLE_ROWS * count)
            rows = [tuple(r) for r in sample.orderBy(*[F.col(n).desc() if down else F.col(n) for n, (_, down) in zip(names, self.order, strict=True)]).collect()]
            picked = [rows[len(rows) * i // count] for i in range(1, count)] if rows else []
            self.bounds = [b for i, b in enumerate(picked) if b[0] is not None and (not i or b != picked[i - 1])]

    def _before(self, values: list[Column], bound: tuple) -> Column:
        """Whether a row sorts before a bound; nulls first, or last in columns that descend."""
        out = F.lit(False)
        for v, b, (_, down), kind in reversed(list(zip(values, bound, self.order, self.kinds, strict=True))):
            if b is None:
                less, same = (v.isNotNull() if down else F.lit(False)), v.isNull()
            else:
                b = literal(b, kind)
                less, same = ((v > b) if down else v.isNull() | (v < b)), v.eqNullSafe(b)
            out = F.coalesce(less, F.lit(False)) | (same & out)
        return out

    def of(self, *values: Column) -> Column:
        """Number of the range of a row with these values, by halving. Fewer values than the order has: of the first
        range that such a row can be in."""
        order, kinds = self.order[: len(values)], self.kinds[: len(values)]
        bounds = sorted_unique([b[: len(values)] for b in self.bounds])
        first = {b: i for i, b in reversed(list(enumerate(x[: len(values)] for x in self.bounds)))}
        short = Ranges.__new__(Ranges)
        short.order, short.kinds, short.bounds = order, kinds, bounds

        def half(low: int, high: int) -> Column:
            if low == high:
                return F.lit(len(self.bounds) if low == len(bounds) else first[bounds[low]])
            middle = (low + high) // 2
            return F.when(short._before(list(values), bounds[middle]), half(low, middle)).otherwise(half(middle + 1, high))

        return half(0, len(bounds))

    def column(self) -> Column:
        return self.of(*[F.col(c) for c, _ in self.order])

    def lookup(self, values: list, kind) -> Column:
        """values[_range], as a column."""
        return F.element_at(F.array(*[literal(x, kind) for x in values]), F.col("_range") + 1)


def sorted_unique(bounds: list[tuple]) -> list[tuple]:
    """Bounds in their order without repeats; they come sorted."""
    return [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]


def _facts(rows: DataFrame, key: str, ranges: Ranges) -> list[tuple[int, object, object]]:
    """(rows, least key, greatest key) of every range, in one pass."""
    got = {r._range: (r.n, r.least, r.most) for r in rows.groupBy("_range").agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).collect()}
    return [got.get(i, (0, None, None)) for i in range(len(ranges.bounds) + 1)]


def positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Adds the 1-based position in the total order by columns ("c", or "-c" for descending); ties come in any order."""
    ranges = Ranges(df, *order)
    rows = df.withColumn("_range", ranges.column())
    before, offsets = 0, []
    for n, _, _ in _facts(rows, ranges.order[0][0], ranges):
        offsets.append(before)
        before += n
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*sort_columns(ranges.order)))
    return rows.withColumn(name, place + ranges.lookup(offsets, "long")).drop("_range")


def _edges(facts: list[tuple[int, object, object]], later: bool) -> list:
    """For each range the least key of all later ones, or the greatest of all earlier ones."""
    out, held = [], None
    for _, least, most in reversed(facts) if later else facts:
        out.append(held)
        held = held if (least if later else most) is None else (least if later else most)
    return out[::-1] if later else out


def seek(keys: DataFrame, key: str, targets: DataFrame, target: str, name: str = "found", before: bool = False, by: str | None = None) -> DataFrame:
    """For each target the least key at or after it, or with before the greatest key before it; null if there is none.

    by: a column of few values, on both sides, within whose groups keys are sought."""
    kind = keys.schema[key].dataType
    ranges = Ranges(keys, key)
    group = [by] if by else []
    k = keys.filter(F.col(key).isNotNull()).select(*group, F.col(key).alias("_key")).withColumns({"_x": F.col("_key"), "_is_key": F.lit(1), "_range": ranges.of(F.col("_key"))})
    t = targets.withColumns({"_x": F.col(target).cast(kind), "_is_key": F.lit(0), "_key": F.lit(None).cast(kind)}).withColumn("_range", ranges.of(F.col("_x")))
    rows = t.unionByName(k, allowMissingColumns=True)
    # Going down for a seek, keys stand before targets they equal; going up for before, after them.
    w = Window.partitionBy(*group, "_range").orderBy(F.col("_x").asc() if before else F.col("_x").desc(), F.col("_is_key").asc() if before else F.col("_is_key").desc())
    inside = F.last("_key", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = k.groupBy("_range", *group).agg(F.count("*").alias("n"), F.min("_key").alias("least"), F.max("_key").alias("most")).collect()
    edge = F.lit(None).cast(kind)
    for value in sorted({r[by] for r in found}, key=repr) if by else [None]:
        mine = {r._range: (r.n, r.least, r.most) for r in found if not by or r[by] == value}
        values = _edges([mine.get(i, (0, None, None)) for i in range(len(ranges.bounds) + 1)], not before)
        own = ranges.lookup(values, kind)
        edge = F.when(F.col(by).eqNullSafe(F.lit(value)), own).otherwise(edge) if by else own
    out = rows.withColumn(name, F.when(F.col("_x").isNotNull(), F.coalesce(inside, edge))).filter("_is_key = 0")
    return out.drop("_range", "_key", "_x", "_is_key")


def neighbours(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with the key before (prev) and after (next)."""
    rows = keys.select(key).distinct()
    ranges = Ranges(keys, key)
    rows = rows.withColumn("_range", ranges.column())
    facts, kind, w = _facts(rows, key, ranges), keys.schema[key].dataType, Window.partitionBy("_range").orderBy(key)
    return rows.select(
        key,
        F.coalesce(F.lag(key).over(w), ranges.lookup(_edges(facts, False), kind)).alias("prev"),
        F.coalesce(F.lead(key).over(w), ranges.lookup(_edges(facts, True), kind)).alias("next"),
    )
