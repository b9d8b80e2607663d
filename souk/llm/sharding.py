"""Sharding by proportional stratified interleaving, with DataFrame functions only.

1. Rows are shuffled by a seeded hash of their id and ranked within their stratum: one sort
   by (stratum, hash), dealt to tasks by ranges, so that a hot stratum is many ranges. A
   row's rank is its place in that order less the first place of its stratum.
2. Row r of n rows has the fractional rank (r + 1/2) / n. All rows are sorted by it, so any
   run of them holds each stratum in proportion, to within a row or two.
3. The sorted rows are cut into shards whose counts are at most one apart; a row's slot is
   its place within the shard.

Only ids, sizes and strata are moved; texts stay where they are until ``write_shards``.

Cases: null text = no text, of size 1; a null stratum is a stratum of its own; null ids sort
first among equal hashes, and all share one hash; repeated rows are rows like others, told
apart by a row number; with fewer rows than shards the last shards stay empty; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import in_order, numbered, save, sized

SHARDS, SEED = 16, 2024


def assign(docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED, id_col: str = "doc_id",
           text_col: str = "text", stratum_col: str | None = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, stratum, size, text_crc32, row, shard, slot) for every row of ``docs``. ``row_col``
    names a column of unique numbers, if there is one."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.col(text_col).cast("string")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit("")
    shuffled = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    base = save(docs.select(
        F.col(id_col).alias("doc_id"), stratum.alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shuffled.alias("shuffled"), row.alias("row")), "shard-rows")
    within = in_order(base, [F.asc_nulls_first("stratum"), *map(F.col, ("shuffled", "doc_id", "size", "text_crc32", "row"))],
                      "shard-strata").withColumnRenamed("place", "among")
    strata = save(within.groupBy("stratum").agg(F.min("among").alias("first"), F.count("*").alias("n"))
                  .withColumnRenamed("stratum", "of"), "shard-counts")
    ranked = within.join(sized(strata), F.col("stratum").eqNullSafe(F.col("of"))).select(
        "doc_id", "stratum", "size", "text_crc32", "row",
        ((F.col("among") - F.col("first") + 0.5) / F.col("n")).alias("fraction"))
    total = strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small, longer = divmod(total, shards)  # the first ``longer`` shards hold a row more
    edge, place = longer * (small + 1), F.col("place")
    early = place < edge
    placed = in_order(ranked, [F.col("fraction"), F.asc_nulls_first("stratum"), F.col("row")], "shard-places")
    shard = F.when(early, F.floor(place / (small + 1))).otherwise(longer + F.floor((place - edge) / max(small, 1)))
    slot = F.when(early, place % (small + 1)).otherwise((place - edge) % max(small, 1))
    return placed.select("doc_id", "stratum", "size", "text_crc32", "row",
                         shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The assignment in the columns of the contract; the law is that counts are at most one
    apart, so rows may move when a shard is added."""
    return assign(docs, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, *, id_col: str = "doc_id",
                 text_col: str = "text", stratum_col: str | None = "source", **options) -> None:
    """The rows of ``docs`` as Parquet, a folder ``shard=k`` for each shard, in the order of
    their slots (column ``slot``); a shard's files are written by several tasks if it is large."""
    rows, name = numbered(docs)
    rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "shard-texts")
    where = assign(rows, shards, id_col=name[id_col], text_col=name[text_col],
                   stratum_col=stratum_col and name[stratum_col], row_col="row", **options).select("row", "shard", "slot")
    dealt = rows.join(where, "row").drop("row")
    dealt = dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.toDF(*docs.columns, "shard", "slot").write.partitionBy("shard").parquet(path)
