"""Importance resampling towards a target distribution.

1. A text's features (runs of its words) are hashed to ``BUCKETS`` buckets. Each document's
   buckets are stored as one array of numbers, and the counts of all buckets, of the corpus
   and of the target, are sums of these arrays (``BUCKETS`` numbers a task).
2. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus;
   a document's weight is the sum of ``gains[array]``. A Gumbel number drawn by a hash of the
   id makes scores of the weights: the highest ones are a sample without replacement in
   proportion to the exponentials of the weights.
3. The key of the last row that is drawn is found by weighted medians of medians: each task
   gives the median of its remaining keys and their number; the median of these medians,
   weighted by the numbers, has at least a quarter of the remaining rows on each side, so
   every round discards that much at least. What remains when few rows are left is sorted.
4. The rows up to that key are sorted by ranges and numbered.

Keys are (score falling, doc_id with nulls last, row number), so all are different.

Cases: null text = no text, without features, of weight 0; null ids are drawn last among
equal scores and share one Gumbel number, as repeated rows of an id do, which are rows of
their own; texts of any length count whole; an empty table gives an empty result; an empty
target or corpus leaves the smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Memo, in_order, map_texts, numbered, ready, save

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SMALL = 20_000  # keys that are sorted at once when so few are left

# Bytes that part words become spaces, A-Z become a-z; digits, letters and all bytes of
# other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def kind_of(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


class Features:
    """Buckets of the features of texts in UTF-8."""

    def __init__(self, buckets: int, longest: int):
        self.longest, self.kind = longest, kind_of(buckets)
        self.bucket = Memo(lambda f: zlib.crc32(f) % buckets, lambda f: len(f) <= 60)

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """(number of words, bucket of each feature)."""
        words = text.translate(_TABLE).split()
        found = list(map(self.bucket.__getitem__, words))
        for k in range(2, self.longest + 1):
            found += [self.bucket[b" ".join(words[i:i + k])] for i in range(len(words) - k + 1)]
        return len(words), np.array(found, self.kind)


@lru_cache(4)
def finder_of(buckets: int, longest: int) -> Features:
    """One for each worker process, with its memo."""
    return Features(buckets, longest)


def features(docs: DataFrame, keep: dict[str, str], text_col: str = "text", buckets: int = BUCKETS,
             longest: int = LONGEST) -> DataFrame:
    """The columns ``keep`` with n_words, n_features and found (the buckets, packed)."""
    def make(texts: list[bytes]) -> list[pa.Array]:
        finder = finder_of(buckets, longest)
        rows = [finder.of(t) for t in texts]
        return [pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()),
                pa.array([f.tobytes() for _, f in rows], pa.binary())]
    return map_texts(docs, text_col, keep, "n_words bigint, n_features bigint, found binary", make)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the column ``found``: one array a task, summed in Spark;
    the driver gets ``buckets`` numbers at most."""
    kind = kind_of(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("found").to_pylist()), kind), minlength=buckets)
        there = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])
    rows = found.select("found").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    size, c_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (c_all + size) / ((float(c) + 1) * (t_all + size))))
                     for c, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``found`` with ``weight``, the sum of the gains of its buckets, in place of the buckets."""
    kind, shared = kind_of(len(gain)), found.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket
    keep = [c for c in found.columns if c != "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [int(shared.value[np.frombuffer(x, kind)].sum()) for x in b.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(w, pa.int64())], [*keep, "weight"])
    schema = ", ".join([*(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep), "weight bigint"])
    return found.select(*keep, "found").mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel number drawn by the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


KEY = ("score", "doc_id", "row")


def before(key: tuple) -> Column:
    """Whether a row comes before ``key`` (score, doc_id, row): higher scores first, then
    smaller ids with nulls last, then smaller row numbers."""
    score, doc_id, row = key
    smaller = F.col("doc_id").isNotNull() if doc_id is None else F.coalesce(F.col("doc_id") < doc_id, F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & (
        smaller | (F.col("doc_id").eqNullSafe(F.lit(doc_id)) & (F.col("row") < row))))


def _rank(key: tuple) -> tuple:
    score, doc_id, row = key
    return -score, doc_id is None, 0 if doc_id is None else doc_id, row


_SORT = [("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")]


def medians(rows: DataFrame) -> list[tuple[int, tuple]]:
    """(number of rows, their median key) of each task that has rows."""
    ready(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # the keys of one split of a file
        if any(b.num_rows for b in held):
            t = pa.Table.from_batches(held)
            half = pc.sort_indices(t, sort_keys=_SORT, null_placement="at_end")[(t.num_rows - 1) // 2].as_py()
            mid = t.slice(half, 1)
            yield from mid.append_column("n", pa.array([t.num_rows], pa.int64())).to_batches()
    found = rows.select(*KEY).mapInArrow(run, f"score bigint, doc_id {kind}, row bigint, n bigint").collect()
    return [(r["n"], (r["score"], r["doc_id"], r["row"])) for r in found]


def cutoff(rows: DataFrame, rank: int, small: int = SMALL) -> tuple:
    """The key at the 1-based ``rank`` of ``rows`` (score, doc_id, row; a written table)."""
    left, n = rows.select(*KEY), rows.count()
    written = n
    while n > small:
        mids = sorted(medians(left), key=lambda m: _rank(m[1]))
        seen = 0
        for size, key in mids:
            seen += size
            if 2 * seen >= n:
                break
        above = left.filter(before(key)).count()
        if rank == above + 1:
            return key
        if rank <= above:
            left, n = left.filter(before(key)), above
        else:
            is_key = F.col("row") == key[2]
            left, n, rank = left.filter(~before(key) & ~is_key), n - above - 1, rank - above - 1
        if 8 * n <= written:  # discarded rows aren't read again and again
            left, written = save(left, "resample-left"), n
    return sorted((tuple(r) for r in left.collect()), key=_rank)[rank - 1]


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, small: int = SMALL) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, row) for every row of ``docs``; rank is null
    for rows that aren't drawn."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = save(features(source, {"doc_id": "doc_id"}, "text", buckets, longest), "resample-features")
    wanted = features(target.select(F.lit(0).alias("i"), F.col(target_text_col).alias("text")), {"i": "i"}, "text", buckets, longest)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = save(weighted(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
                  .withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    enough = F.col("n_words") >= least_words
    n = scored.filter(enough).count()
    drawn = percent * n // 100
    cols = ["doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"), "row"]
    if drawn == 0:
        return scored.select(cols)
    last = cutoff(scored.filter(enough), drawn, small)
    wins = enough & (before(last) | (F.col("row") == last[2]))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    winners = in_order(scored.filter(wins), order, "resample-winners")
    return winners.select("doc_id", "n_features", "weight", "score", (F.col("place") + 1).alias("rank"), "row").unionByName(
        scored.filter(~wins).select(cols))


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, and the best ``rank`` of that id."""
    ranks = (resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL")
             .groupBy(F.col("doc_id").alias("id")).agg(F.min("rank").alias("rank")))
    rows, name = numbered(docs)
    return rows.join(ranks, F.col(name[id_col]).eqNullSafe(F.col("id"))).drop("id").toDF(*docs.columns, "rank")


def report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    return resample(docs, target, **options).drop("row")
