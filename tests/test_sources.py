"""Sources and sinks: public-export CSV layout, generic CSV, result writer."""

import glob
import shutil
import tempfile

from pyspark.sql import functions as F

import pytest

from souk.plans.oracle import AS_OF
from souk.plans.registry import OPERATORS, run
from souk.sources.export_csv import FILES, load_export_csv
from souk.sources.tables import load_tables, write_results

# Extra columns of the public export that the analyses do not read.
EXTRA = {
    "orders": ["order_approved_at", "order_delivered_carrier_date"],
    "order_items": ["order_item_id", "shipping_limit_date"],
    "order_payments": ["payment_sequential", "payment_type", "payment_installments"],
    "order_reviews": ["review_comment_title", "review_comment_message"],
    "customers": ["customer_zip_code_prefix"],
    "sellers": ["seller_zip_code_prefix", "seller_city", "seller_state"],
    "products": ["product_name_lenght", "product_photos_qty"],
    "category_translation": [],
}


def _as_export(tables, root):
    """Write the fixture the way the public CSV files look: string ids, extra
    columns in between, quoted multi-line comments."""
    for name, df in tables.items():
        cols = []
        for i, c in enumerate(df.columns):
            cols.append(F.col(c).cast("string").alias(c))
            if i == 0:
                for e in EXTRA[name]:
                    cols.append(F.lit("line one\nline \"two\"" if "message" in e else "x").alias(e))
        out = tempfile.mkdtemp(dir=root)
        (df.select(*cols).coalesce(1).write.mode("overwrite")
         .option("header", "true").option("escape", '"').csv(out))
        shutil.move(glob.glob(f"{out}/part-*.csv")[0], f"{root}/{FILES[name].replace('*', 'market')}")


def test_public_csv_layout_gives_same_results(spark, tables):
    root = tempfile.mkdtemp(prefix="souk-export-")
    _as_export(tables, root)
    csv_tables = load_export_csv(spark, root)
    assert csv_tables.orders.schema["order_purchase_timestamp"].dataType.typeName() == "timestamp_ntz"
    for key in ["kpi_category_performance", "delivery_by_state", "review_by_category",
                "cust_clv", "dq_price_sanity"]:
        a = sorted(map(tuple, run(key, tables).collect()), key=str)
        b = sorted(map(tuple, run(key, csv_tables).collect()), key=str)
        assert a == b, key


def test_generic_csv_and_sink_round_trip(spark, tables):
    root = tempfile.mkdtemp(prefix="souk-csv-")
    for name, df in tables.items():
        df.write.option("header", "true").csv(f"{root}/{name}")
    again = load_tables(spark, root, fmt="csv")
    out = tempfile.mkdtemp(prefix="souk-out-")
    paths = write_results({"kpi_state_performance": run("kpi_state_performance", again),
                           "dq_row_counts": run("dq_row_counts", again)}, out)
    back = spark.read.parquet(paths[0])
    want = run("kpi_state_performance", tables)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    counts = dict(spark.read.parquet(paths[1]).collect())
    assert counts["orders"] == tables.orders.count()


def test_command_line_writes_results(spark, fixture_dir):
    from souk.__main__ import main
    out = tempfile.mkdtemp(prefix="souk-cli-")
    paths = main(["--tables", fixture_dir, "--out", out,
                  "--keys", "dq_scorecard,cust_rfm", "--as-of", "2021-01-01"], spark=spark)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["dq_scorecard", "cust_rfm"]
    assert spark.read.parquet(paths[0]).count() == 3
    assert spark.read.parquet(paths[1]).count() > 0


ITEMS = "product_id,order_item_id,price,order_id,freight_value,seller_id\n"


def _file(text):
    root = tempfile.mkdtemp(prefix="souk-rows-")
    with open(f"{root}/order_items", "w") as f:
        f.write(text)
    return root


def test_csv_is_read_by_header(spark):
    root = _file(ITEMS + "p7,1,10.50,ab12,2.25,s3\n")
    rows = load_tables(spark, root, fmt="csv").order_items.collect()
    assert [tuple(map(str, r)) for r in rows] == [("ab12", "p7", "s3", "10.50", "2.25")]


def test_missing_column_and_bad_value_fail(spark):
    with pytest.raises(ValueError, match="missing columns .*seller_id"):
        load_tables(spark, _file("order_id,product_id,price,freight_value\n1,2,3,4\n"), fmt="csv").order_items  # noqa: B018
    with pytest.raises(Exception, match="price: not a decimal"):
        load_tables(spark, _file(ITEMS + "p7,1,ten,ab12,2.25,s3\n"), fmt="csv").order_items.collect()
    empty = load_tables(spark, _file(ITEMS + "p7,1,,ab12,2.25,s3\n"), fmt="csv").order_items.first()
    assert empty["price"] is None


def test_ids_of_two_types_fail(spark, tables):
    root = tempfile.mkdtemp(prefix="souk-ids-")
    for name, df in tables.items():
        if name == "orders":
            df = df.withColumn("order_id", F.col("order_id").cast("string"))
        df.write.parquet(f"{root}/{name}")
    with pytest.raises(ValueError, match="order_id is"):
        run("kpi_snapshot", load_tables(spark, root))


def test_large_csv_is_split(spark):
    root = _file(ITEMS + "p7,1,10.50,ab12,2.25,s3\n" * 5000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "4096")
        import os
        os.rename(f"{root}/order_items", f"{root}/market_order_items_dataset.csv")
        assert load_export_csv(spark, root).order_items.rdd.getNumPartitions() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def string_ids(spark, tables):
    """The fixture with hash-like string ids, stored as Parquet with columns out of order."""
    root = tempfile.mkdtemp(prefix="souk-string-ids-")
    for name, df in tables.items():
        cols = [F.concat(F.lit("k"), F.lpad(F.col(c).cast("string"), 12, "0")).alias(c) if c.endswith("_id") else F.col(c)
                for c in reversed(df.columns)]
        df.select(F.lit("extra").alias("note"), *cols).coalesce(1).write.parquet(f"{root}/{name}")
    return load_tables(spark, root)


@pytest.mark.parametrize("key", sorted(OPERATORS))
def test_string_ids_give_the_same_results(tables, string_ids, key):
    """The padded strings sort as the numbers do, so ties break alike."""
    def rows(t):
        out = []
        for r in run(key, t, as_of=AS_OF).collect():
            out.append(tuple(int(v[1:]) if isinstance(v, str) and v[:1] == "k" and v[1:].isdigit() else v for v in r))
        return sorted(out, key=str)
    assert rows(string_ids) == rows(tables)
