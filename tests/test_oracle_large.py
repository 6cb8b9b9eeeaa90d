"""The oracle suite's size-dependent queries with every size constant forced small.

Ranking helpers, quantiles and screens then run the plans that large inputs get;
the answers must not change. A second part checks NULL scores, groups and labels.
"""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reachlab.functions import ordered, quantiles
from reachlab.functions.ordered import rank_within, running_totals
from reachlab.operators import evaluate as E
from reachlab.operators import profile
from reachlab.operators import split as S
from reachlab.plans import base
from reachlab.sources.tables import TABLES
from scripts.oracle_check import _rows

from .conftest import SF_SMALL

NAMES = ["roc_auc", "average_precision", "roc_curve", "pr_curve", "leaderboard", "decile_lift", "stratified_split",
         "cv_folds", "explain_sample", "driver_direction", "beeswarm_points", "permutation_importance",
         "profile_describe", "box_summary", "box_summary_by_target", "density_summary", "outliers_iqr", "prep_income",
         "median_fill", "variable_kind", "standardize"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_large_plans_match_oracle(spark, duck, monkeypatch, name):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 60)
    monkeypatch.setattr(quantiles, "SMALL_TOTAL", 0)
    monkeypatch.setattr(profile, "SCREEN_DISTINCT", 8)
    sdf = entry.queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    assert _rows(sdf.columns, got) == _rows([d[0] for d in cur.description], cur.fetchall())


@pytest.fixture(scope="module")
def holes(spark):
    """300 rows: a third in one group, NULL groups, NULL and tied scores."""
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 == 0 else f"g{i % 4}",
             None if i % 7 == 0 else 0.5 if i % 5 == 0 else (i * 37 % 101) / 101, i % 2) for i in range(300)]
    return spark.createDataFrame(rows, "id long, g string, p double, label int")


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("max_cuts", [10_000, 3])
def test_ranks_keep_rows_without_group_or_score(holes, monkeypatch, descending, max_cuts):
    monkeypatch.setattr(ordered, "MAX_CUTS", max_cuts)
    small = rank_within(holes, ["g"], "p", "id", descending=descending).collect()
    large = rank_within(holes, ["g"], "p", "id", descending=descending, rows_per_task=20).collect()
    assert sorted(map(str, small)) == sorted(map(str, large)) and len(large) == 300
    counts = holes.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    small = running_totals(counts, ["g"], "p", ["n"], descending=descending).collect()
    large = running_totals(counts, ["g"], "p", ["n"], descending=descending, rows_per_task=10).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_metrics_do_not_depend_on_size(holes, monkeypatch):
    small = E.ranking_metrics(holes, group=("g",)).collect()
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 15)
    large = E.ranking_metrics(holes, group=("g",)).collect()
    key = lambda rows: sorted((str(r["g"]), round(r["roc_auc"] or -1.0, 9), r["n_pos"], r["n_neg"]) for r in rows)
    assert key(small) == key(large) and sum(r["n_pos"] + r["n_neg"] for r in large) == 300


def test_splits_keep_rows_without_label(holes):
    df = holes.withColumn("label", F.when(F.col("id") % 4 > 0, F.col("label")))
    out = S.stratified_split(df)
    assert out.count() == 300
    sides = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sides[(None, "test")] == 15 and sides[(None, "train")] == 60
    assert S.cv_folds(df).count() == 300 and S.with_class_weight(df).count() == 300


def test_a_value_shared_by_many_rows_is_counted_not_ranked(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 60)
    data = [(m, 0.5 if i % 2 else ((i * 37) % 101) / 7.0 - m, (i * i + m) % 3 == 0) for m in range(3) for i in range(400)]
    data += [(0, None, True), (0, None, False), (1, float("nan"), True), (1, float("-inf"), False), (1, float("inf"), True)]
    rows = spark.createDataFrame([(m, p, int(y)) for m, p, y in data], "model int, p double, label int")
    got = {r["model"]: (r["roc_auc"], r["average_precision"]) for r in E.ranking_metrics(rows).collect()}
    place = lambda p: (-1, 0.0) if p is None else (1, 0.0) if p != p else (0, p)
    for m in range(3):
        scored = [(place(p), y) for g, p, y in data if g == m]
        pos, neg = [p for p, y in scored if y], [p for p, y in scored if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        ap = sum(sum(b >= a for b in pos) / sum(b >= a for b, _ in scored) for a in pos) / len(pos)
        assert got[m] == pytest.approx((auc, ap), abs=1e-12)
    ranked = E._ranked_by_range(rows.select("model", "p", F.col("label").cast("long").alias("pos"),
                                            (1 - F.col("label")).cast("long").alias("neg")), ["model"], len(data))
    assert ranked.where(F.col("pos") + F.col("neg") >= 200).count() == 3


def test_customers_of_one_partition_are_spread_before_their_trials(spark):
    from reachlab.sources import fixtures

    raw = base.raw(spark, SF_SMALL).coalesce(1)
    scored = fixtures.rule_scores(raw, fixtures.rule_trials(3))
    assert scored.count() == 3 * raw.count()
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
