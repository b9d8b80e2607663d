"""Joins in time: the latest row as of a time, points inside intervals, overlapping intervals.

None of them needs a window over all rows of a key or a comparison of all pairs:

* ``asof_join`` merges both sides by (key, time) within slices of time. What a slice starts
  with, the last row of the slices before it, is a running maximum over one row for each
  key and slice. So a hot key is as many groups as it has slices.
* ``interval_join`` gives each interval a level, the power of two next to its length, and its
  one or two cells of that width; a point lies in one cell of each level in use (64 at most).
  Points and intervals meet by (keys, level, cell) in an equi-join and are compared exactly.
* ``overlap_join``: of two intervals that overlap, one holds the start of the other.

Times are whole numbers, dates or timestamps; both sides must be of one kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one slice, about, if all rows were of one key.
SLICE_ROWS = 1_000_000


def time_number(c: Column, kind: T.DataType) -> Column:
    """A time as a whole number: microseconds of timestamps, days of dates."""
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), c)
    raise TypeError(f"no time: {kind.simpleString()}")


def _number(df: DataFrame, name: str) -> Column:
    return time_number(F.col(name), df.schema[name].dataType)


def slice_width(*sides: DataFrame, rows: int = SLICE_ROWS) -> int:
    """The width of time slices by which ``sides`` (a column t) have ``rows`` rows a slice,
    on average; one aggregation over them."""
    total = sides[0].select("t")
    for s in sides[1:]:
        total = total.unionAll(s.select("t"))
    n, low, high = total.agg(F.count("*"), F.min("t"), F.max("t")).first()
    return max(1, -(-(high - low + 1) * rows // n)) if n else 1


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], times: tuple[str, str],
              take: dict[str, str], *, strict: bool = False, forward: bool = False,
              tolerance: int | None = None, order: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """All rows of ``left`` with the columns ``take`` ({right column: new name}) of the last
    row of ``right`` of the same keys whose time isn't after theirs.

    ``strict``: whose time is before theirs. ``forward``: the first row whose time isn't
    before theirs (``strict``: is after). ``tolerance``: a row more than so much away (in
    microseconds, days or units) doesn't count. Of right rows of one key and time the one
    with the greatest ``order``, then ``take`` columns is used. Null keys and times match
    nothing. ``width`` is the slices' width; without it one aggregation finds it."""
    on = [f"k{i}" for i in range(len(keys))]
    sign = -1 if forward else 1
    lefts = left.select(*(F.col(a).alias(k) for k, (a, _) in zip(on, keys)), (_number(left, times[0]) * sign).alias("t"),
                        F.struct(*left.columns).alias("row"))
    rights = right.select(*(F.col(b).alias(k) for k, (_, b) in zip(on, keys)), (_number(right, times[1]) * sign).alias("t"),
                          F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)),
                                   *(F.col(c).alias(f"v{i}") for i, c in enumerate(take))).alias("found"))
    known = F.lit(True)
    for c in [*on, "t"]:
        known = known & F.col(c).isNotNull()
    matched, rights = lefts.filter(known), rights.filter(known)
    if width is None:
        width = slice_width(matched, rights)
    cut = F.floor(F.col("t") / width).alias("slice")
    found = F.struct("t", "found").alias("found")
    none = F.lit(None).cast(rights.select(found).schema["found"].dataType).alias("found")
    # Where strict, the left rows of a time stand before the right ones.
    merged = matched.select(*on, "t", cut, F.lit(0 if strict else 1).alias("side"), "row", none).unionByName(
        rights.select(*on, "t", cut, F.lit(1 if strict else 0).alias("side"),
                      F.lit(None).cast(lefts.schema["row"].dataType).alias("row"), found))
    slices = [*on, "slice"]
    so_far = Window.partitionBy(*slices).orderBy("t", "side", "found").rowsBetween(Window.unboundedPreceding, 0)
    inside = merged.withColumn("found", F.last("found", ignorenulls=True).over(so_far)).filter("row IS NOT NULL")
    # What each slice starts with: one row for each key and slice.
    ends = rights.select(*on, cut, found).groupBy(*slices).agg(F.max("found").alias("found"))
    starts = ends.unionByName(matched.select(*on, cut).distinct().select("*", none)).groupBy(*slices).agg(F.max("found").alias("found"))
    earlier = Window.partitionBy(*on).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.last("found", ignorenulls=True).over(earlier)).drop("found")
    hit = F.coalesce("found", "before")
    if tolerance is not None:
        hit = F.when(F.col("t") - hit["t"] <= tolerance, hit)
    out = inside.join(starts, slices, "left").select("row", hit["found"].alias("found"))
    out = out.unionByName(lefts.filter(~F.coalesce(known, F.lit(False))).select("row", F.lit(None).cast(out.schema["found"].dataType).alias("found")))
    return out.select("row.*", *(F.col(f"found.v{i}").alias(name) for i, name in enumerate(take.values())))


def interval_join(points: DataFrame, intervals: DataFrame, time: str, bounds: tuple[str, str], *,
                  keys: Sequence[tuple[str, str]] = (), closed: bool = False) -> DataFrame:
    """Pairs of rows of ``points`` and ``intervals`` of the same keys whose time is at or after
    the start and before the end (``closed``: or at it). Column names must be different.
    Null times and bounds, and intervals without a length, match nothing."""
    dots = points.toDF(*(f"p{i}" for i in range(len(points.columns))))
    spans = intervals.toDF(*(f"i{i}" for i in range(len(intervals.columns))))
    of_point, of_span = dict(zip(points.columns, dots.columns)), dict(zip(intervals.columns, spans.columns))
    end = _number(spans, of_span[bounds[1]]) + (1 if closed else 0)
    spans = spans.select("*", _number(spans, of_span[bounds[0]]).alias("start"), end.alias("end")).filter("start < end")
    spans = spans.withColumn("level", F.length(F.bin(F.col("end") - F.col("start") - 1)))
    levels = spans.select(F.collect_set("level").alias("levels"))  # one row of at most 64 numbers
    spans = spans.withColumn("cell", F.explode(F.expr("sequence(shiftright(start, level), shiftright(end - 1, level))")))
    dots = dots.select("*", _number(dots, of_point[time]).alias("t")).filter("t IS NOT NULL").crossJoin(F.broadcast(levels))
    dots = dots.withColumn("at", F.explode("levels")).withColumn("place", F.expr("shiftright(t, at)"))
    same = (F.col("at") == F.col("level")) & (F.col("place") == F.col("cell"))
    for a, b in keys:
        same = same & (F.col(of_point[a]) == F.col(of_span[b]))
    met = dots.join(spans, same).filter("t >= start AND t < end")
    return met.select(*of_point.values(), *of_span.values()).toDF(*points.columns, *intervals.columns)


def overlap_join(one: DataFrame, two: DataFrame, bounds: tuple[str, str], other: tuple[str, str], *,
                 keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of intervals [start, end) of the same keys that share a time. Column names must
    be different; intervals without a length overlap nothing."""
    ones, twos = one.filter(F.col(bounds[0]) < F.col(bounds[1])), two.filter(F.col(other[0]) < F.col(other[1]))
    held = interval_join(twos, ones, other[0], bounds, keys=[(b, a) for a, b in keys])
    holds = interval_join(ones, twos, bounds[0], other, keys=keys).filter(F.col(bounds[0]) > F.col(other[0]))
    return held.select(*one.columns, *two.columns).unionByName(holds.select(*one.columns, *two.columns))
