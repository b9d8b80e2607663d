"""The bundle of eight marketplace DataFrames, file loaders and the result sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.schema import SCHEMAS

TABLE_NAMES = tuple(SCHEMAS)


class Tables:
    """The eight marketplace tables by name (``t.orders``, ``t.order_items`` ...).

    Each value is a DataFrame or a zero-argument function returning one; a
    function is called on first access only, so an operator opens exactly the
    tables it reads (no file listing or footer reads for the others).

    Building blocks that several operators share (order totals, delivered
    order rows, per-person aggregates) go through ``shared``. With ``reuse``
    on (``with_reuse()``, used when many results are produced together) each
    is checkpointed once on first use, so the joins beneath it run once for
    all results instead of once per result.
    """

    def __init__(self, reuse: bool = False, **frames: DataFrame | Callable[[], DataFrame]):
        unknown = set(frames) - set(TABLE_NAMES)
        missing = set(TABLE_NAMES) - set(frames)
        if unknown or missing:
            raise ValueError(f"tables: unknown {sorted(unknown)}, missing {sorted(missing)}")
        self._frames = dict(frames)
        self._reuse = reuse
        self._memo: dict[str, DataFrame] = {}

    @property
    def reusing(self) -> bool:
        return self._reuse

    def with_reuse(self) -> Tables:
        """Same tables; shared building blocks are materialized once."""
        return Tables(reuse=True, **self._frames)

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._memo:
            df = build()
            if self._reuse:
                from souk.session import materialize
                df = materialize(df)
            self._memo[name] = df
        return self._memo[name]

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames")
        if frames is None or name not in frames:
            raise AttributeError(name)
        value = frames[name]
        if not isinstance(value, DataFrame):
            value = frames[name] = value()
        return value

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in TABLE_NAMES]


class IdKinds:
    """The type each id has in the tables opened so far: both sides of a key must agree."""

    def __init__(self) -> None:
        self._seen: dict[str, tuple[str, str]] = {}

    def check(self, table: str, name: str, kind: T.DataType) -> None:
        first, where = self._seen.setdefault(name, (kind.simpleString(), table))
        if first != kind.simpleString():
            raise ValueError(f"{name} is {kind.simpleString()} in {table} but {first} in {where}")


def typed(df: DataFrame, table: str, kinds: IdKinds | None = None) -> DataFrame:
    """The logical columns of ``table`` from a stored frame, picked by name.

    Ids keep their stored type (whole numbers become BIGINT); other columns are
    cast to the logical type, and a value that does not cast fails the job
    instead of turning into NULL. A missing column is an error.
    """
    missing = [f.name for f in SCHEMAS[table] if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}; there are {df.columns}")
    cols = []
    for field in SCHEMAS[table]:
        stored, c = df.schema[field.name].dataType, F.col(field.name)
        if field.name.endswith("_id"):
            kind = T.LongType() if isinstance(stored, T.IntegralType) else stored
            if kinds is not None:
                kinds.check(table, field.name, kind)
            cols.append(c.cast(kind).alias(field.name) if kind != stored else c)
        elif stored == field.dataType:
            cols.append(c)
        else:
            cols.append(_strict(c, field).alias(field.name))
    return df.select(*cols)


def _strict(c: Column, field: T.StructField) -> Column:
    value = c.try_cast("double") if isinstance(field.dataType, T.IntegerType) else c
    value = value.try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"{field.name}: not a {field.dataType.simpleString()}: "), c.cast("string")))
    return F.when(c.isNull() | value.isNotNull(), value).otherwise(wrong.cast(field.dataType))


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet",
                names: dict[str, str] | None = None, options_of: dict[str, dict] | None = None,
                **options) -> Tables:
    """Read the eight tables from ``root/<name>``; see ``typed`` for the columns.

    ``names`` maps a logical table to a different file, folder or path pattern,
    ``options_of`` gives one table reader options of its own. CSV files are read
    by their header, as strings. Casts aside, filters and the choice of columns
    reach the scan.
    """
    names, options_of, kinds = names or {}, options_of or {}, IdKinds()

    def loader(table: str) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            reader = spark.read
            if fmt == "csv":
                reader = reader.option("header", "true").option("mode", "FAILFAST")
            for k, v in {**options, **options_of.get(table, {})}.items():
                reader = reader.option(k, v)
            return typed(reader.format(fmt).load(f"{root.rstrip('/')}/{names.get(table, table)}"),
                         table, kinds)
        return load

    return Tables(**{table: loader(table) for table in TABLE_NAMES})


def write_results(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> list[str]:
    """Write each named result as its own dataset under ``out_dir``.

    Results are written straight from the executors; nothing is collected.
    """
    paths = []
    for key, df in results.items():
        path = f"{out_dir.rstrip('/')}/{key}"
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        writer.save(path)
        paths.append(path)
    return paths
