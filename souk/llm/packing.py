"""Packing by power-of-two decomposition.

Every document becomes its ids and an end id. Its length is split into powers of two: as
many pieces of the longest length as fit, then the binary digits of the rest, largest
first. Each piece is a sequence of its own, so no sequence crosses documents, no sequence
needs padding, and ``bucket`` (the piece's length) says with which others it can form a
batch. Nothing is shuffled: a sequence id holds the bucket, the task and a number that the
task counts up within the bucket, so the ids of a bucket are a range of their own.

Cases: null text = empty text = the end id alone; null ids and repeated rows are packed like
others; very long texts give many pieces; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.bpe import loaded, loaded_whole, vocabulary, whole_fits
from souk.llm.common import bounded_batches

SEQUENCE = 1024
SCHEMA = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, bucket int")
# Bits of a sequence id: bucket, task, number in the bucket of the task.
TASK_BITS, NUMBER_BITS = 24, 34


def lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """Powers of two up to ``longest`` (one itself) that add up to ``n``, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE,
         end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, bucket, and with ``with_ids`` the ids themselves (binary, little-endian
    unsigned 32-bit integers)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = vocabulary(spark, vocab)
    load = loaded_whole if whole_fits(spec.value) else loaded
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", ")), *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = load(spec.value), TaskContext.get().partitionId()
        made = [0] * longest.bit_length()
        for b in batches:
            of, rows, ids = [], [], []
            for at, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                whole = bpe.encode(text or b"") + end
                n, start = len(whole) // 4, 0
                view = memoryview(whole)
                for k in lengths(n, longest):
                    piece, bit = view[4 * start:4 * (start + k)], k.bit_length() - 1
                    number = (bit << TASK_BITS | task) << NUMBER_BITS | made[bit]
                    made[bit] += 1
                    of.append(at)
                    rows.append((start, k, zlib.crc32(piece), n, number, 0, k))
                    if with_ids:
                        ids.append(bytes(piece))
                    start += k
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.int32()])] or [pa.array([], t) for t in [pa.int64()] * 6 + [pa.int32()]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int32())), *cols, *([pa.array(ids, pa.binary())] if with_ids else [])], names)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {SCHEMA}" + (", ids binary" if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
