"""Exact NTILE(k) over a whole table without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task,
and numbering all rows sorts the table once for each score. But k tiles need
only the k - 1 rows that end a tile: NTILE gives the first n mod k tiles
n div k + 1 rows and the others n div k, so the ranks of these rows are known,
and a row's tile follows from comparing its key with theirs.

``cut_keys`` finds the keys at given ranks of several values at once, exactly, by
narrowing: pivots drawn by a hash from every range that holds a rank split it into
parts that one aggregation counts, and the part with the rank is the next range. Keys
are (value, id), so a hot value is split by its ids. When all ranges hold at most
``SMALL`` rows, these are collected and sorted. A step is two scans with a few
counters for all values and ranks together; no row is shuffled.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOTS = 16
SMALL = 20_000
HASHES = 1 << 52


def _order(key: tuple) -> tuple:
    """NULLs first, as in an ascending sort."""
    return tuple((x is not None, x) for x in key)


class _Range:
    """Where the key at ``rank`` of a value lies: after ``low``, not after ``high``;
    ``below`` rows come before the range, ``upto`` with it."""

    def __init__(self, value: str, rank: int, n: int):
        self.value, self.rank, self.low, self.high, self.below, self.upto = value, rank, None, None, 0, n
        self.found: tuple | None = None

    @property
    def size(self) -> int:
        return self.upto - self.below

    @property
    def place(self) -> tuple:
        return self.value, self.low, self.high

    def narrow(self, pivots: list[tuple], upto: list[int]) -> None:
        """``upto[i]``: rows up to ``pivots[i]``, which are sorted."""
        for pivot, most in zip(pivots, upto):
            if most == self.rank:
                self.found = pivot
            if most >= self.rank:
                self.high, self.upto = pivot, most
                return
            self.low, self.below = pivot, most


def cut_keys(df: DataFrame, id_col: str, ranks: dict[str, list[int]], n: int,
             small: int = SMALL, pivots: int = PIVOTS) -> dict[str, list[tuple]]:
    """For each value column the keys (value, id) at its 1-based ``ranks`` of the n rows,
    ordered by value (NULLs first) and id. Ids must be unique."""
    def key(value: str) -> Column:
        return F.struct(F.col(value), F.col(id_col))

    def literal(value: str, k: tuple) -> Column:
        return F.struct(*(F.lit(x).cast(df.schema[c].dataType).alias(c) for x, c in zip(k, (value, id_col))))

    def within(value: str, low: tuple | None, high: tuple | None) -> Column:
        here = F.lit(True) if low is None else key(value) > literal(value, low)
        return here if high is None else here & (key(value) <= literal(value, high))

    rows = df.select(id_col, *ranks)
    goals = [_Range(value, rank, n) for value, of in ranks.items() for rank in of]
    step = 0
    while wide := {g.place: g.size for g in goals if g.found is None and g.size > small}:
        step += 1
        lots = F.pmod(F.xxhash64(F.col(id_col), F.lit(step)), F.lit(HASHES))
        drawn = rows.agg(*(F.collect_list(F.when(within(*place) & (lots < max(1, HASHES * pivots // size)), key(place[0]))).alias(f"r{i}")
                           for i, (place, size) in enumerate(wide.items()))).first()  # about ``pivots`` keys each
        tries = {place: sorted((tuple(k) for k in drawn[i]), key=_order) for i, place in enumerate(wide)}
        tests = [(place, p) for place, ps in tries.items() for p in ps]
        if not tests:
            continue
        counts = rows.agg(*(F.count_if(within(*place) & (key(place[0]) <= literal(place[0], p))).alias(f"c{i}")
                            for i, (place, p) in enumerate(tests))).first()
        for g in goals:
            if g.found is None and g.place in tries:
                place = g.place
                g.narrow(tries[place], [g.below + c for c, (at, _) in zip(counts, tests) if at == place])
    left = {g.place for g in goals if g.found is None}
    if left:
        some = F.lit(False)
        for place in left:
            some = some | within(*place)
        held = rows.where(some).collect()  # ``small`` rows for each rank, at most
        keys = {}
        for value, low, high in left:
            every = sorted(((r[value], r[id_col]) for r in held), key=_order)
            keys[value, low, high] = [k for k in every if (low is None or _order(k) > _order(low)) and (high is None or _order(k) <= _order(high))]
        for g in goals:
            if g.found is None:
                g.found = keys[g.place][g.rank - g.below - 1]
    return {value: [g.found for g in goals if g.value == value] for value in ranks}


def ntile_by_cuts(df: DataFrame, k: int, id_col: str, scores: dict[str, str], **sizes) -> DataFrame:
    """``df`` plus, for each {value column: name}, NTILE(k) OVER (ORDER BY value, id).

    ``id_col`` must be unique; ``df`` should be a written frame, as it is scanned
    a few times."""
    n = df.count()
    ranks = [r for r in accumulate(n // k + (i < n % k) for i in range(k - 1)) if 0 < r < n]
    for value, cuts in cut_keys(df, id_col, {value: ranks for value in scores}, n, **sizes).items():
        key = F.struct(F.col(value), F.col(id_col))
        tile = F.lit(1)
        for cut in cuts:
            at = F.struct(F.lit(cut[0]).cast(df.schema[value].dataType).alias(value),
                          F.lit(cut[1]).cast(df.schema[id_col].dataType).alias(id_col))
            tile = tile + F.when(key > at, 1).otherwise(0)
        df = df.withColumn(scores[value], tile.cast("long"))
    return df
