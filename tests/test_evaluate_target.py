"""Layer 2: invariants of evaluation and targeting."""

from __future__ import annotations

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reachlab.operators import evaluate as E
from reachlab.operators import target as T
from reachlab.plans import base

from .conftest import SF_MID


def _scores(spark, rows):
    return spark.createDataFrame([("m", i, y, p) for i, (y, p) in enumerate(rows)],
                                 "model string, id long, label int, p double")


def test_auc_perfect_and_constant(spark):
    perfect = _scores(spark, [(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.1)])
    const = _scores(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])
    assert E.roc_auc(perfect).first()["roc_auc"] == 1.0
    assert E.roc_auc(const).first()["roc_auc"] == 0.5


def test_single_class_guarded(spark):
    s = _scores(spark, [(0, 0.2), (0, 0.7)])
    assert E.roc_auc(s).first()["roc_auc"] is None
    assert E.average_precision(s).first()["average_precision"] is None
    m = E.class_metrics(s).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)


def test_fixture_values_sf001(spark):
    """FIXTURES.md section 3 numbers for the scores table at sf0.01."""
    s = base.scores(spark, SF_MID)
    auc = {r["model"]: r["roc_auc"] for r in E.roc_auc(s).collect()}
    ap = {r["model"]: r["average_precision"] for r in E.average_precision(s).collect()}
    assert auc == {"hash_a": pytest.approx(0.763673, abs=1e-6), "hash_b": pytest.approx(0.577497, abs=1e-6)}
    assert ap == {"hash_a": pytest.approx(0.524009, abs=1e-6), "hash_b": pytest.approx(0.240953, abs=1e-6)}


def test_average_precision_is_not_mllib_area_under_pr(spark):
    """AP (step sum) differs from MLlib's interpolated area under PR."""
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5)]
    s = _scores(spark, rows)
    ap = E.average_precision(s).first()["average_precision"]
    assert ap == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3, abs=1e-6)     # 0.755556
    ev = spark.createDataFrame([(Vectors.dense([1 - p, p]), float(y)) for y, p in rows],
                               ["rawPrediction", "label"])
    mllib = BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(ev)
    assert abs(mllib - ap) > 1e-3
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(ev)
    assert E.roc_auc(s).first()["roc_auc"] == pytest.approx(auc, abs=1e-6)


def test_roc_curve_ends(spark):
    s = _scores(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.4)])
    pts = sorted((r["fpr"], r["tpr"]) for r in E.roc_curve(s).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)


def test_best_threshold_is_a_sweep_maximum(spark):
    s = base.scores(spark, SF_MID)
    sweep = T.threshold_sweep(s)
    best = {r["model"]: r for r in T.best_thresholds(sweep).collect()}
    for r in sweep.groupBy("model").agg(F.max("f1").alias("f1"), F.max("profit").alias("pr")).collect():
        assert best[r["model"]]["best_f1"] == r["f1"]
        assert best[r["model"]]["best_profit"] == r["pr"]


def test_sweep_bucketing_equals_brute_force(spark):
    vals = [0.05, 0.29, 0.2900000000000001, 0.57, 0.95, 0.96, 0.0, 1.0, 0.049999, 377 / 1300]
    s = spark.createDataFrame([("m", i, 1, v) for i, v in enumerate(vals)],
                              "model string, id long, label int, p double")
    got = {r["step"]: r["tp"] for r in T.threshold_sweep(s).collect()}
    for i in range(91):
        t = (5 + i) / 100.0
        assert got[i] == sum(1 for v in vals if v >= t), i


def test_threshold_above_every_p(spark):
    s = _scores(spark, [(1, 0.1), (0, 0.2)])
    out = T.campaign_outcome(s, threshold=0.9).first()
    assert out["contacted"] == 0 and out["precision"] == 0.0 and out["lift"] == 0.0


def test_deciles_cover_all_rows(spark):
    s = base.scores(spark, SF_MID)
    d = T.decile_lift(s).where(F.col("segment") != "top_1pct")
    tot = {r["model"]: r["n"] for r in d.groupBy("model").agg(F.sum("customers").alias("n")).collect()}
    assert tot == {"hash_a": 1500, "hash_b": 1500}
