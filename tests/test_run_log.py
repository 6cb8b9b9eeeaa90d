"""I1 sink: retried batches, half-written batches, compaction; I3 records; A7 keys; C5 filter."""

from __future__ import annotations

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from reachlab.operators import profile
from reachlab.operators import runs as R
from reachlab.plans import base
from reachlab.sources import run_log

_SCHEMA = "id long, text string"


def _rows(spark, ids):
    return spark.createDataFrame([(i, f"row {i}") for i in ids], _SCHEMA)


def _root():
    return os.path.join(tempfile.mkdtemp(prefix="reachlab-log-", dir="/tmp"), "log")


def _ids(spark, root):
    return sorted(r["id"] for r in run_log.read(spark, root, _rows(spark, [0]).schema).collect())


def test_batches_count_once_before_and_after_compaction(spark):
    root, schema = _root(), _rows(spark, [0]).schema
    assert _ids(spark, root) == [] and run_log.compact(spark, root, schema) == 0
    assert run_log.append(_rows(spark, [1, 2]), root, "a.1") and run_log.append(_rows(spark, [3]), root, "b/2 %")
    assert not run_log.append(_rows(spark, [1, 2]), root, "a.1")
    assert run_log.compact(spark, root, schema) == 2 and _ids(spark, root) == [1, 2, 3]
    assert not run_log.append(_rows(spark, [3]), root, "b/2 %")          # known from the compaction
    assert run_log.append(_rows(spark, [3, 3]), root, "c")               # rows that repeat are kept
    assert run_log.vacuum(spark, root) == 2 and _ids(spark, root) == [1, 2, 3, 3, 3]
    assert run_log.compact(spark, root, schema) == 2 and run_log.vacuum(spark, root) == 2
    assert _ids(spark, root) == [1, 2, 3, 3, 3] and not run_log.append(_rows(spark, [1]), root, "a.1")
    assert len(os.listdir(os.path.join(root, "data"))) == 1


def test_unfinished_and_doubled_batches(spark):
    root = _root()
    run_log.append(_rows(spark, [1]), root, "a")
    _rows(spark, [9]).write.parquet(f"{root}/data/unfinished")            # no commit stands for it
    _rows(spark, [1]).write.parquet(f"{root}/data/zz")                    # two writers of one batch at once
    open(f"{root}/log/batch.a.zz", "w").close()
    assert _ids(spark, root) == [1]
    assert run_log.compact(spark, root, _rows(spark, [0]).schema) == 0 and run_log.vacuum(spark, root) == 1
    assert _ids(spark, root) == [1]


def test_only_scalar_entries_of_fetched_runs(spark):
    df = spark.createDataFrame(
        [("r1", "n", None, "s", '{"a": 1, "b": 0.5, "c": "x", "d": true, "e": [1], "f": {"g": 1}, "h": null}', '{"model": "tree"}'),
         ("r2", "n", "job", "s", None, "no json"), ("r3", "n", "", "s", '{"t": "[1]"}', '{"model": ["tree"]}')],
        "id string, name string, job_type string, state string, summary string, config string") \
        .withColumn("created_at", F.lit("2026-01-01").cast("timestamp_ntz")).withColumn("url", F.concat(F.lit("u/"), "id"))
    got = {r["id"]: r for r in R.fetched_runs(df).collect()}
    assert got["r1"]["summary"] == {"a": "1", "b": "0.5", "c": "x", "d": "true"}
    assert (got["r1"]["model"], got["r1"]["job_type"], got["r1"]["url"]) == ("tree", "—", "u/r1")
    assert got["r2"]["summary"] == {} and got["r2"]["config"] == {} and got["r2"]["model"] == "—"
    assert got["r3"]["summary"] == {"t": "[1]"} and got["r3"]["config"] == {} and got["r3"]["job_type"] == "—"


def test_changed_files_give_new_tables(spark):
    folder = tempfile.mkdtemp(prefix="reachlab-memo-", dir="/tmp")
    path = f"{folder}/t.parquet"
    built = []

    def table():
        return base.memo(spark, folder, "t", lambda: built.append(1) or spark.read.parquet(path))

    _rows(spark, [1, 2]).write.parquet(path)
    assert table().count() == 2 and table().count() == 2 and len(built) == 1
    old = table()
    _rows(spark, [1, 2, 3]).write.mode("append").parquet(path)           # a folder below has another file
    assert table().count() == 5 and len(built) == 2 and old.count() == 2
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    table()
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(built) == 3 and table().count() == 5 and len(built) == 3
    shutil.copy(next(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet")), f"{folder}/extra.parquet")
    table()
    assert len(built) == 4


@pytest.mark.parametrize("bits", [15, 16, 28])
def test_duplicates_with_a_full_filter_and_odd_names(spark, monkeypatch, bits):
    monkeypatch.setattr(profile, "FILTER_BITS", bits)
    df = spark.range(40_000).select(
        (F.col("id") % 30_000).alias("a.b"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 30_000).alias("place"),
        F.lit(float("nan")).alias("c0"))
    want = df.count() - df.distinct().count()
    assert profile.duplicate_rows(df).first()["duplicates"] == want > 0
    assert profile.duplicate_rows(df.limit(0)).first()["duplicates"] == 0
    assert profile.duplicate_rows(df.dropDuplicates()).first()["duplicates"] == 0


def test_variable_card_of_counts(spark):
    df = spark.createDataFrame([(1e9 + i % 3, None if i % 4 else 2.0, None) for i in range(90)], "a double, b double, c double")
    got = {r["feature"]: r for r in profile.variable_stats(df, ["a", "b", "c"]).collect()}
    want = df.agg(F.stddev_samp("a").alias("s"), F.avg("a").alias("m")).first()
    assert got["a"]["std"] == pytest.approx(want["s"], abs=1e-6) and got["a"]["mean"] == pytest.approx(want["m"])
    assert got["b"]["missing"] == 67 and got["b"]["n_unique"] == 1 and got["b"]["std"] == 0
    assert got["c"]["missing_pct"] == 100 and got["c"]["mean"] is None and got["c"]["std"] is None
