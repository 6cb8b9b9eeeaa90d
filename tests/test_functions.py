"""Building blocks: exact quantiles, ordered running totals, ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reachlab.functions import quantiles
from reachlab.functions.ordered import rank_within, running_totals

from reachlab.functions.quantiles import exact_quantiles, key_value, order_key


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    n = 5000
    x = np.round(rng.lognormal(3, 1, n), 2)             # many distinct values
    ties = rng.integers(0, 4, n).astype(float)          # heavy ties
    x[::17] = np.nan                                     # missing values
    pdf = pd.DataFrame({"x": x, "ties": ties, "const": 3.0})
    df = spark.createDataFrame(pdf).select(
        F.when(F.isnan("x"), None).otherwise(F.col("x")).alias("x"), "ties", "const")
    return df, pdf


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_exact_quantiles_match_numpy(values):
    df, pdf = values
    got = exact_quantiles(df, ["x", "ties", "const"], PROBS, small_total=0)   # radix path
    small = exact_quantiles(df, ["x", "ties", "const"], PROBS)                # percentile path
    for col in ("x", "ties", "const"):
        assert np.allclose(got[col], small[col], atol=1e-9), col
        expect = np.quantile(pdf[col].dropna().to_numpy(), PROBS)   # linear, as pandas
        assert np.allclose(got[col], expect, rtol=0, atol=1e-9), col


def test_order_keys_order_every_kind_of_double(spark):
    """Keys sort like the values, are their bit patterns, and turn back into them."""
    rng = np.random.default_rng(1)
    bits = rng.integers(-2**63, 2**63, 3000, dtype=np.int64).view(np.float64)
    edges = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, -1.7976931348623157e308,
             np.inf, -np.inf, 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2), 0.1, -3.0]
    powers = [f(2.0**e) for e in range(-1074, 1024, 7) for f in (lambda v: v, lambda v: np.nextafter(v, 0), lambda v: -v)]
    x = np.array([v for v in [*bits, *edges, *powers] if not np.isnan(v)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = df.select("x", order_key(F.col("x")).alias("k")).collect()
    assert got[-1]["k"] is None
    for r in got[:-1]:
        assert key_value(r["k"]) == r["x"]
        assert r["k"] == (1 if r["x"] >= 0 else -1) * int(np.abs(np.float64(r["x"])).view(np.int64))
    nan = spark.range(1).select(order_key(F.lit(float("nan"))).alias("k")).first()["k"]
    assert nan > max(r["k"] for r in got[:-1])


@pytest.mark.parametrize("scale", [1.0, 1e-300, -1e250])
def test_radix_passes_on_any_scale(values, scale):
    df, pdf = values
    got = exact_quantiles(df, {"x": F.col("x") * F.lit(scale)}, PROBS, small_total=0)
    x = pdf["x"].dropna().to_numpy() * scale
    assert np.allclose(got["x"], np.quantile(x, PROBS), rtol=1e-12, atol=0)


def test_a_thin_band_between_heavy_ties_stays_in_spark(spark, monkeypatch):
    """A million distinct neighbours between two ties that hold most rows: one row per rank is read."""
    read = []
    monkeypatch.setattr(quantiles, "_read", lambda rows: read.append(rows.collect()) or read[-1])
    n = 1_000_000
    band = spark.range(n).select((F.lit(1.0) + F.col("id") * F.lit(2.0**-50)).alias("x"))
    ties = spark.range(2 * n).select(F.when(F.col("id") < n, 0.5).otherwise(2.0).alias("x"))
    probs = [0.1, 0.34, 0.5, 0.66, 0.9]
    got = exact_quantiles(band.unionByName(ties), ["x"], probs, small_total=0)
    x = np.sort(np.concatenate([1 + np.arange(n) * 2.0**-50, np.full(n, 0.5), np.full(n, 2.0)]))
    assert got["x"] == list(np.quantile(x, probs))
    assert 2 <= len(read) <= 4 and all(len(rows) <= 2 * len(probs) for rows in read)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def _counts(spark, n_groups=3, n=3000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, n_groups, n), "p": rng.integers(0, 400, n) / 400.0,
                        "pos": rng.integers(0, 3, n), "neg": rng.integers(0, 3, n)})
    pdf = pdf.groupby(["g", "p"], as_index=False).sum()
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_range_path_equals_window(spark, descending):
    df = _counts(spark)
    fast = running_totals(df, ["g"], "p", ["pos", "neg"], descending=descending)
    ranged = running_totals(df, ["g"], "p", ["pos", "neg"], descending=descending, rows_per_task=50)
    a = fast.orderBy("g", "p").toPandas()
    b = ranged.orderBy("g", "p").toPandas()
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b[a.columns].reset_index(drop=True),
                                  check_dtype=False)


def test_rank_within_equals_row_number(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 2000), "k": rng.integers(0, 50, 2000),
                        "id": np.arange(2000)})
    df = spark.createDataFrame(pdf)
    w = Window.partitionBy("g").orderBy("k", "id")
    expect = df.withColumn("rn", F.row_number().over(w)).orderBy("id").toPandas()["rn"]
    got = rank_within(df, ["g"], "k", "id", rows_per_task=100).orderBy("id").toPandas()["row_rank"]
    assert (expect.to_numpy() == got.to_numpy()).all()


def test_no_buffer_holds_every_income(spark, monkeypatch):
    from reachlab.functions import quantiles

    def whole(*_):
        raise AssertionError("every distinct value in one buffer")
    monkeypatch.setattr(quantiles.F, "percentile", whole)
    df = spark.range(500_001).select(F.col("id").cast("double").alias("x"))
    assert quantiles.exact_quantiles(df, ["x"], [0.5, 0.99]) == {"x": [250_000.0, 495_000.0]}


def test_exact_quantiles_of_many_columns_are_not_one_expression_each(spark, monkeypatch):
    """The plan that finds the digits does not grow by a key expression per column, which was too long to compile."""
    from reachlab.functions import quantiles
    plans, read = [], quantiles._read

    def seen(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return read(rows)

    monkeypatch.setattr(quantiles, "_read", seen)
    values = [None, -2.5, -0.0, 0.0, 1e-310, 7.0, float("inf"), float("nan"), float("-inf"), 3.25, 3.25]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        *[(F.col("x") * (1.0 + i)).alias(f"c{i}") for i in range(26)])
    got = exact_quantiles(df, df.columns, [0.0, 0.5, 2 / 3], small_total=0)
    assert got["c0"] == [float("-inf"), 1.625, 3.25] and got["c25"] == [float("-inf"), 42.25, 84.5]
    assert plans and not any("LOG2(" in p.upper() for p in plans)
