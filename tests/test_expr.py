"""Column helpers: NULL on zero denominators, exact averages, day arithmetic."""

from datetime import datetime

from pyspark.sql import functions as F

from souk.functions.expr import avg_of, days_between, pct, round_dp, share_of_total, trunc_days


def test_pct_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in df.select(pct("a", "b", 2)).collect()] == [None, 33.33]


def test_avg_of_empty_and_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "x decimal(18,2)")
    assert df.agg(avg_of("x")).first()[0] is None
    df2 = spark.createDataFrame([("1.00",), (None,), ("2.01",)], "x string").select(
        F.col("x").cast("decimal(18,2)").alias("x"))
    assert df2.agg(round_dp(avg_of("x"), 3)).first()[0] == 1.505


def test_share_of_total_sums_to_100(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    got = dict(share_of_total(df, "n", "p", 2).select("k", "p").collect())
    assert got == {"a": 33.33, "b": 33.33, "c": 33.33}


def test_days_and_truncation_toward_zero(spark):
    a = datetime(2020, 1, 10, 12, 0, 0)
    rows = [(a, datetime(2020, 1, 8, 0, 0, 0)),     # -2.5 days -> -2
            (a, datetime(2020, 1, 10, 18, 0, 0)),   # 0.25 days -> 0
            (a, datetime(2020, 1, 17, 12, 0, 0))]   # exactly 7 days -> 7
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(days_between("a", "b").alias("d"), trunc_days("a", "b").alias("t")).collect()
    assert [(r["d"], r["t"]) for r in out] == [(-2.5, -2), (0.25, 0), (7.0, 7)]
