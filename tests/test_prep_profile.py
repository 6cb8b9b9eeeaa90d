"""Layer 3: edge fixtures for preparation and profiling (FIXTURES.md section 7)."""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlab.operators import prep, profile
from reachlab.sources.campaign import RAW_SCHEMA, read_campaign_file, write_campaign_file


def _raw_rows(spark, rows):
    """Build raw-schema rows from partial dicts (missing columns NULL)."""
    from decimal import Decimal
    full = []
    for r in rows:
        d = {f.name: None for f in RAW_SCHEMA.fields}
        d.update(r)
        for f in RAW_SCHEMA.fields:
            if f.dataType.typeName() == "decimal" and d[f.name] is not None:
                d[f.name] = Decimal(str(d[f.name]))
        full.append(tuple(d[f.name] for f in RAW_SCHEMA.fields))
    return spark.createDataFrame(full, RAW_SCHEMA)


def test_bad_date_is_null_not_error(spark):
    df = _raw_rows(spark, [{"ID": 1, "Dt_Customer": "31-31-2012"}, {"ID": 2, "Dt_Customer": "04-09-2012"}])
    out = {r["ID"]: r["Tenure_Days"] for r in prep.prep_tenure(df).collect()}
    assert out == {1: None, 2: 0}


def test_education_unknown_and_null_map_to_one(spark):
    df = _raw_rows(spark, [{"ID": 1, "Education": "Unknown"}, {"ID": 2, "Education": None},
                           {"ID": 3, "Education": "PhD"}, {"ID": 4, "Education": "Basic"}])
    out = {r["ID"]: r["Education"] for r in prep.prep_education(df).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 0}


def test_age_null_stays_null_and_cap(spark):
    df = _raw_rows(spark, [{"ID": 1, "Year_Birth": None}, {"ID": 2, "Year_Birth": 1893},
                           {"ID": 3, "Year_Birth": 1990}])
    out = {r["ID"]: r["Age"] for r in prep.prep_age(df).collect()}
    assert out == {1: None, 2: 100, 3: 35}


def test_marital_and_children_nulls(spark):
    df = _raw_rows(spark, [{"ID": 1, "Marital_Status": None, "Kidhome": None, "Teenhome": 1},
                           {"ID": 2, "Marital_Status": "Together", "Kidhome": 0, "Teenhome": 0}])
    out = prep.prep_children(prep.prep_marital(df)).collect()
    got = {r["ID"]: (r["Marital_Status"], r["HasChildren"]) for r in out}
    assert got == {1: (0, 0), 2: (1, 0)}


def test_income_median_then_p99_cap(spark):
    incomes = [float(i) for i in range(1, 101)] + [None, 10_000.0]
    df = _raw_rows(spark, [{"ID": i, "Income": v} for i, v in enumerate(incomes)])
    med, cap = prep.income_stats(df)
    filled = np.array([v if v is not None else med for v in incomes])
    assert med == pytest.approx(np.median([v for v in incomes if v is not None]))
    assert cap == pytest.approx(np.quantile(filled, 0.99))
    out = prep.prep_income(df).agg(F.max("Income")).first()[0]
    assert out == pytest.approx(cap)


def test_nan_income_becomes_null_on_load(spark):
    df = _raw_rows(spark, [{"ID": 1, "Income": float("nan"), "Education": "PhD"},
                           {"ID": 2, "Income": 5.0, "Education": "Master"}])
    path = os.path.join(tempfile.mkdtemp(prefix="reachlab-tsv-", dir="/tmp"), "raw")
    write_campaign_file(df, path, "tsv")
    back = read_campaign_file(spark, path, "tsv")
    got = {r["ID"]: r["Income"] for r in back.collect()}
    assert got[1] is None and got[2] == 5.0


def test_duplicates_with_nulls(spark):
    rows = [(1, None, "a"), (1, None, "a"), (1, None, "a"), (2, 3.0, None), (2, 3.0, None), (3, 1.0, "b")]
    df = spark.createDataFrame(rows, "a long, b double, c string")
    assert profile.duplicate_rows(df).first()["duplicates"] == 3


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0)], "x double, y double, k double")
    rows = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation_matrix(df, ["x", "y", "k"]).collect()}
    assert rows[("x", "k")] is None and rows[("k", "k")] is None
    assert rows[("x", "x")] == 1.0
    assert rows[("x", "y")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1], abs=1e-6)


def test_vif_collinear_is_inf_and_matches_regression(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=300), rng.normal(size=300), rng.normal(size=300)
    s = a + b                                              # exactly collinear
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(a, b, c, s)], "a double, b double, c double, s double")
    out = {r["feature"]: r["vif"] for r in profile.vif(df, ["a", "b", "c", "s"]).collect()}
    assert math.isinf(out["s"]) and math.isinf(out["a"])
    # brute force for c: regress c on a, b (s is redundant)
    X = np.column_stack([np.ones(300), a, b, s])
    beta, *_ = np.linalg.lstsq(X, c, rcond=None)
    r2 = 1 - ((c - X @ beta) ** 2).sum() / ((c - c.mean()) ** 2).sum()
    assert out["c"] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_vif_single_feature_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert math.isnan(profile.vif(df, ["a"]).first()["vif"])


def test_variable_kind_rules(spark):
    df = spark.createDataFrame([(0, 1.0, 2.5, 1), (1, 2.0, 3.5, 1), (1, 3.0, 4.5, 2), (0, 2.0, 5.5, 3)],
                               "flag int, small double, cont double, cnt int")
    kinds = {r["feature"]: r["kind"] for r in profile.variable_kind(df, ["flag", "small", "cont", "cnt"]).collect()}
    assert kinds == {"flag": "pie", "small": "bar", "cont": "continuous", "cnt": "bar"}


def test_malformed_line_fails_the_read(spark, tmp_path):
    from pyspark.errors import PySparkException

    from reachlab.sources.campaign import RAW_COLUMNS, read_campaign_file
    good = ["1"] * len(RAW_COLUMNS)
    bad = ["1", "not a year", *["1"] * (len(RAW_COLUMNS) - 2)]
    (tmp_path / "x.tsv").write_text("\n".join("\t".join(r) for r in (RAW_COLUMNS, good, bad)) + "\n")
    with pytest.raises(Exception) as e:
        read_campaign_file(spark, str(tmp_path / "x.tsv")).collect()
    assert isinstance(e.value, PySparkException) or "MALFORMED" in str(e.value).upper()
