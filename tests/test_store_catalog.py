"""A5/A6 store semantics and the G13 description fallback."""

from __future__ import annotations

import os
import tempfile

import pytest

from reachlab.operators.catalog import FEATURE_DESCRIPTIONS, describe_features
from reachlab.sources.store import dataset_key, load_attributions, read, store_attributions, vacuum, write


def _attr(spark, model, n=3):
    return spark.createDataFrame([(model, i, "f", float(i), 0.1 * i, 0.0, "log_odds") for i in range(n)],
                                 "model string, id long, feature string, value double, contribution double, "
                                 "base_value double, space string")


def test_store_miss_computes_and_partitions_are_kept(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="reachlab-store-", dir="/tmp"), "store")
    calls = []

    def compute():
        calls.append(1)
        return _attr(spark, "a").unionByName(_attr(spark, "b"))

    got = load_attributions(spark, path, "ds", "a", compute=compute)   # no store yet: a miss
    assert got.count() == 3 and calls == [1]
    again = load_attributions(spark, path, "ds", "a", compute=compute)  # now a hit
    assert again.count() == 3 and calls == [1]
    store_attributions(_attr(spark, "b", 5), path, "ds")               # only partition b replaced
    assert load_attributions(spark, path, "ds", "a").count() == 3
    assert load_attributions(spark, path, "ds", "b").count() == 5
    assert load_attributions(spark, path, "other", "a") is None


def _new_root(name):
    return os.path.join(tempfile.mkdtemp(prefix="reachlab-store-", dir="/tmp"), name)


def test_a_failed_read_is_raised_and_never_overwritten(spark):
    path = _new_root("broken")
    store_attributions(_attr(spark, "a"), path, "ds")
    folder = os.path.join(path, "ds", "a", "shap")
    version = sorted(os.listdir(os.path.join(folder, "commits")))[-1].split("-", 1)[1]
    for name in os.listdir(os.path.join(folder, version)):
        if name.startswith("part-"):
            with open(os.path.join(folder, version, name), "w") as fh:
                fh.write("not parquet")
    calls = []
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        load_attributions(spark, path, "ds", "a", compute=lambda: calls.append(1) or _attr(spark, "a")).count()
    assert calls == []


def test_half_a_write_is_not_seen(spark):
    path = _new_root("half")
    write(_attr(spark, "a", 3), path, "ds", "a")
    folder = os.path.join(path, "ds", "a", "shap")
    _attr(spark, "a", 9).write.parquet(os.path.join(folder, "data-unfinished"))   # no commit stands for it
    assert read(spark, path, "ds", "a").count() == 3
    write(_attr(spark, "a", 5), path, "ds", "a")
    assert read(spark, path, "ds", "a").count() == 5
    old = read(spark, path, "ds", "a")
    write(_attr(spark, "a", 7), path, "ds", "a")
    assert old.count() == 5                                                        # a reader keeps its version
    assert vacuum(spark, path, "ds", "a") == 2 and read(spark, path, "ds", "a").count() == 7


def test_datasets_of_one_name_are_kept_apart(spark):
    path = _new_root("names")
    one, other = dataset_key("/data/x/sf1/"), dataset_key("/data/y/sf1")
    write(_attr(spark, "a", 2), path, one, "a")
    write(_attr(spark, "a", 4), path, other, "a")
    assert read(spark, path, one, "a").count() == 2 and read(spark, path, other, "a").count() == 4
    assert read(spark, path, one, "a", "importance") is None


def test_description_fallback(spark):
    df = spark.createDataFrame([("m", "Income"), ("m", "Tenure_Days"), ("m", "unknown_col")],
                               "model string, feature string")
    d = {r["feature"]: r["description"] for r in describe_features(df).collect()}
    assert d["Income"] == FEATURE_DESCRIPTIONS["Income"]             # primary description
    assert d["Tenure_Days"] == FEATURE_DESCRIPTIONS["Tenure_Days"]   # primary wins over engineered
    assert d["unknown_col"] == ""
