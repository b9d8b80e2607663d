"""Running values and cuts of long arrays and texts, with Spark expressions only.

An array can't grow in place inside ``aggregate``: each append copies it, so n appends cost
n * n. Here arrays grow within blocks of 256 only, and the totals of blocks are an array of their
own, 256 times shorter. Texts are cut in two steps likewise, since finding the n-th code
point reads all before it.

Cases: an empty array gives an empty array; null arrays and null elements aren't expected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 8  # 256 elements in a block


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def in_blocks(a: Column, bits: int = BITS) -> Column:
    """The array cut into arrays of 2^bits elements (the last one shorter); one block if empty."""
    last = F.shiftright(F.greatest(F.size(a) - 1, F.lit(0)), bits)
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, F.shiftleft(b, bits) + 1, F.lit(1 << bits)))


def before(a: Column, join: Callable[[Column, Column], Column] = lambda x, y: x + y, levels: int = 2) -> Column:
    """For each element of an array<bigint> what those before it give under ``join`` (sums, or
    ``F.greatest``), 0 for the first. Elements are 0 or more."""
    zero = F.lit(0).cast("long")
    if levels == 1:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct(
            join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda x, y: join(x, y)))
        return F.flatten(F.zip_with(blocks, before(totals, join, levels - 1), lambda b, at: F.transform(
            before(b, join, 1), lambda x: join(x, at))))
    # What a lambda uses is worked out at each call, so arrays are bound to variables first.
    return let(a, lambda bound: let(in_blocks(bound), over))


def part(text: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of ``text``."""
    return text.substr((start + 1).cast("int"), (end - start).cast("int"))


def parts(text: Column, spans: Column, bits: tuple[int, ...] = (12, 6)) -> Column:
    """The texts of spans (structs of start and end, by start, none overlapping the next)."""
    if not bits:
        return F.transform(spans, lambda s: part(text, s["start"], s["end"]))

    def of_block(block: Column) -> Column:
        at, end = block[0]["start"], F.element_at(block, -1)["end"]
        return let(part(text, at, end), lambda inner: parts(inner, F.transform(block, lambda s: F.struct(
            (s["start"] - at).alias("start"), (s["end"] - at).alias("end"))), bits[1:]))
    return let(spans, lambda bound: F.when(F.size(bound) == 0, F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(in_blocks(bound, bits[0]), of_block))))
