"""Helpers shared by the corpus operators: scratch tables, size checks, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir

# A join side is broadcast only when its counted rows stay within this bound
# (rows are a few longs or one short digest wide: at most some tens of MB).
BROADCAST_ROWS = 500_000

# Entries of a worker's memo of results by word or fragment, about 200 bytes each.
MEMO = 900_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, removed when the application ends."""
    ready(spark)
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def save(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (``by``: a folder for each value of that
    column, of few values) and read it back: the lineage is cut, and a lost executor costs a
    re-read of files, never a re-run."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (a written table: counting reads its footers) with a broadcast
    hint if it is small; otherwise as it is, for a shuffle join."""
    return F.broadcast(table) if table.count() <= max_rows else table


def in_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` as a written table sorted by ``keys``, with ``place``: a row's number from 0 in
    that order, without gaps.

    Ranges of the keys are dealt to tasks, so the keys should tell rows apart (a row number
    last), lest a value that many rows share makes one range of them. A task's rows are
    counted from 0; what stands before them is a running sum over one row for each task."""
    sorted_rows = save(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("at", F.monotonically_increasing_id()), name)
    task = F.shiftright("at", 33)
    sizes = sorted_rows.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return (sorted_rows.join(F.broadcast(before), task == F.col("task"))
            .withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("task", "before", "at"))


def text_of(name: str = "text") -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ... and these names by the old ones, so that
    no name of the input meets one of an operator."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies in the same folder as on the
    driver but isn't installed (a local session); on a cluster it is installed or shipped."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of at most ``rows`` rows, so that one batch of very long
    texts still fits a Python worker."""
    ready(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_texts(docs: DataFrame, text_col: str, keep: dict[str, str], added: str, make) -> DataFrame:
    """The columns ``keep`` ({column: name in the result}) and those that ``make`` adds from
    the texts, row by row, without a shuffle. ``make(texts)`` takes a list of texts in UTF-8
    (null: empty) and returns Arrow arrays in the order of ``added`` ("name type, ...")."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
                         F.col(text_col).cast("string").alias("text"))
    kinds = [source.schema[i].dataType.simpleString() for i in range(len(keep))]
    names = [*(f"k{i}" for i in range(len(keep))), *(c.split()[0] for c in added.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *make(texts)], names)
    out = source.mapInArrow(run, ", ".join([*(f"k{i} {k}" for i, k in enumerate(kinds)), added]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep.values())})


class Memo(dict):
    """Results by key, as far as ``keep`` allows; of two generations the older is dropped
    when the younger is full, so that frequent keys stay."""

    def __init__(self, make, keep):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.keep(key):
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
