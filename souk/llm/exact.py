"""Exact dedup over an extendible-hash index on shared files, with DataFrame functions only.

1. ``entries`` (row number, doc_id, 64-bit key, SHA-256) of every row go to a shared file.
2. Entries of one key are combined within a task and sent on under (key, salt), so a hot
   text is at most ``SALTS`` postings, whichever share of the rows it has.
3. The directory maps the leading bits of a key to a bucket. It starts with one slot and
   doubles while some bucket holds more than ``bucket_keys`` different keys; a bucket that
   is not overfull keeps its smaller local depth and is shared by several slots.
4. Owner tasks take contiguous ranges of (bucket, key): they get the postings of their range
   through the directory, sort them and make one link of each key. Postings of one key with
   different SHA-256 are different texts under one key: the texts of these keys are grouped,
   which compares their bytes, and become links of a chain. Where one key is there twice or
   more with one SHA-256, the texts are compared by their bytes likewise.
5. Every row finds its bucket by the directory and probes the index by (bucket, key); where
   a chain has two or more links, by text.

The directory uses three bits more than equal buckets need, ``MAX_DEPTH`` at most. A bucket
that these can't split (with a ``key`` that is far from uniform) stays overfull; its keys are
dealt to several owner tasks by ranges, as any bucket's, and no row is lost.

Cases: null text = empty text; a null doc_id loses against any other; rows with one
doc_id and one text are repeated rows, of which exactly one is kept; an empty table gives
an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import numbered, save, sized, text_of

# Keys in a bucket before it splits: some tens of MB of index rows.
BUCKET_KEYS = 250_000
MAX_DEPTH = 24
SALTS = 16  # postings of a key at most


def directory(cells: list[tuple[int, int]], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """Slots [(slot, bucket, local depth)] of the directory, over counts of keys by their
    first ``depth`` bits. The directory doubles until no bucket is overfull or all
    ``depth`` bits are used; a bucket is named by its first slot at full depth."""
    counts = dict(cells)
    whole: list[dict[int, int]] = [counts]  # whole[k]: counts by the first depth - k bits
    for _ in range(depth):
        up: dict[int, int] = {}
        for prefix, n in whole[-1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        whole.append(up)
    out, todo = [], [(0, 0)]  # (prefix, local depth)
    while todo:
        prefix, at = todo.pop()
        if at < depth and whole[depth - at].get(prefix, 0) > capacity:
            todo += [(2 * prefix, at + 1), (2 * prefix + 1, at + 1)]
        else:
            out.append((prefix, at))
    top = max(at for _, at in out)
    return [(slot, prefix << (top - at), at) for prefix, at in sorted(out, key=lambda b: b[0] << (top - b[1]))
            for slot in range(prefix << (top - at), (prefix + 1) << (top - at))]


def split_buckets(keys: DataFrame, capacity: int) -> list[tuple[int, int, int]]:
    """The directory over different ``keys``, from counts by leading bits, 16 for each bucket."""
    depth = min(MAX_DEPTH, max(0, (keys.count() // max(1, capacity)).bit_length() + 3))
    cells = keys.groupBy(bits(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n")).collect()
    return directory([(r["cell"], r["n"]) for r in cells], depth, capacity)


def bits(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key, as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 key=F.xxhash64, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket, chain) for every row;
    of equal texts the largest doc_id stays. ``key`` makes the 64-bit key of a text."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    keyed = source.withColumn("key", key(F.col("text")))
    entries = save(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key",
                                F.unhex(F.sha2("text", 256)).alias("sha")), "exact-entries")
    low = F.lit(-(2**63)).cast("long")
    rank = F.coalesce(F.col("doc_id").cast("long"), low)

    # Postings, combined before the shuffle.
    salt = F.pmod(F.shiftright("row", 33), F.lit(SALTS))
    postings = save(entries.groupBy("key", salt.alias("salt")).agg(
        F.max("doc_id").alias("keep_id"), F.max(rank).alias("rank"), F.max_by("row", rank).alias("keep_row"),
        F.count("*").alias("n"), F.min("sha").alias("low"), F.max("sha").alias("high")), "exact-postings")
    slots = split_buckets(postings.select("key").distinct(), bucket_keys)
    depth = max(at for _, _, at in slots)
    slot_table = spark.createDataFrame(slots, "slot long, bucket long, local_depth int")
    slot_table = F.broadcast(slot_table) if len(slots) <= 1 << 18 else slot_table
    to_bucket = lambda df: df.join(slot_table, bits(F.col("key"), depth) == F.col("slot")).drop("slot")

    # Owner tasks: each key's postings are in one range, so they are grouped where they are.
    owned = (to_bucket(postings).repartitionByRange("bucket", "key").groupBy("bucket", "key").agg(
        F.max("local_depth").alias("local_depth"), F.max("keep_id").alias("keep_id"),
        F.max_by("keep_row", "rank").alias("keep_row"), F.sum("n").alias("group_size"),
        F.min("low").alias("low"), F.max("high").alias("high")))
    index = save(owned.sortWithinPartitions("bucket", "key").withColumn("chain", F.lit(0).cast("long")), "exact-index")

    # Bytes of the texts whose key is there twice or more.
    twice = save(index.filter("group_size > 1").select("key"), "exact-twice")
    chains = save(keyed.join(sized(twice), "key", "left_semi")
                  .groupBy("key", "text").agg(F.count("*").alias("n"))
                  .groupBy("key").agg(F.count("*").alias("links")).filter("links > 1"), "exact-chains")
    collide = chains.count() > 0
    if collide:
        index = index.join(sized(chains.select("key")), "key", "left_anti")

    found = to_bucket(entries).join(index.drop("local_depth"), ["bucket", "key"], "left" if collide else "inner")
    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
           F.lower(F.hex("sha")).alias("text_sha256"), F.col("bucket"), F.col("chain")]
    if not collide:
        return found.select(out)
    # Chains: rows of colliding keys probe by key and text (bytes), a rare path.
    alone = found.filter(F.col("keep_row").isNotNull()).select(out)
    rows = save(keyed.join(sized(chains.select("key")), "key", "left_semi")
                .withColumn("row", F.monotonically_increasing_id()), "exact-colliding")
    links = rows.groupBy("key", "text").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("row", rank).alias("keep_row"),
        F.count("*").alias("group_size"), F.min("row").alias("first"))
    links = links.withColumn("chain", F.row_number().over(
        Window.partitionBy("key").orderBy("first")).cast("long")).drop("first")
    links = to_bucket(links)
    probed = (rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
              .join(links, ["key", "text"]).select(out))
    return alone.unionByName(probed)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are not kept; columns as they are."""
    groups = save(exact_groups(docs, id_col, text_col, **options), "exact-groups")
    gone = save(groups.filter("NOT kept").select(
        F.col("doc_id").alias("id"), "text_sha256", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("again"))
        .distinct(), "exact-gone")
    rows, name = numbered(docs)
    same = F.col(name[id_col]).eqNullSafe(F.col("id")) & (F.sha2(text_of(name[text_col]), 256) == F.col("text_sha256"))
    kept = rows.join(sized(gone.filter("NOT again")), same, "left_anti")
    again = gone.filter("again")
    if again.count() == 0:
        return kept.toDF(*docs.columns)
    # Repeated rows of a kept document: one of them stays.
    single = kept.join(sized(again), same, "left_anti")
    first = (kept.join(sized(again), same, "left_semi").withColumn("sha", F.sha2(text_of(name[text_col]), 256))
             .dropDuplicates([name[id_col], "sha"]).drop("sha"))
    return single.unionByName(first).toDF(*docs.columns)
