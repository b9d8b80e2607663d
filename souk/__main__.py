"""Command line: run analyses over stored tables and write every result.

    python -m souk --tables /data/marketplace --out /data/results
    python -m souk --tables /data/export --layout export --keys kpi_monthly_trend,cust_rfm \\
                   --as-of 2018-10-01 --format csv

Results are written by the executors, one dataset per key; nothing is
collected on the driver. The master and other settings come from the
usual spark-submit / spark-defaults configuration.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from souk.plans.registry import OPERATORS, run_all
from souk.session import BASE_CONF, ensure_checkpoint_dir
from souk.sources.export_csv import load_export_csv
from souk.sources.tables import load_tables, write_results


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m souk", description=__doc__.splitlines()[0])
    p.add_argument("--tables", required=True, help="folder with the eight tables")
    p.add_argument("--layout", choices=["parquet", "csv", "export"], default="parquet",
                   help="parquet/csv: <folder>/<table>; export: the public CSV file names")
    p.add_argument("--out", required=True, help="folder for the results")
    p.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    p.add_argument("--keys", default="", help="comma-separated keys (default: all)")
    p.add_argument("--as-of", default=None, help="RFM reference date (YYYY-MM-DD)")
    return p.parse_args(argv)


def main(argv=None, spark: SparkSession | None = None) -> list[str]:
    args = parse(argv)
    if spark is None:
        builder = SparkSession.builder.appName("souk")
        for k, v in BASE_CONF.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.layout == "export":
        tables = load_export_csv(spark, args.tables)
    else:
        tables = load_tables(spark, args.tables, fmt=args.layout)
    keys = [k for k in args.keys.split(",") if k] or list(OPERATORS)
    unknown = sorted(set(keys) - set(OPERATORS))
    if unknown:
        raise SystemExit(f"unknown keys: {', '.join(unknown)}")
    results = run_all(tables, as_of=args.as_of, keys=keys, reuse=len(keys) > 1)
    return write_results(results, args.out, fmt=args.format)


if __name__ == "__main__":
    for path in main():
        print(path)
