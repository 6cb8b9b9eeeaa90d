"""The network's fit in NumPy: the same steps as MLlib's, in one task and by jobs."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from reachlab.operators import mlp as N
from reachlab.operators.lbfgs import minimise


def _rows(spark, n):
    u = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 500.0 - 1.0
    rows = spark.range(n).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("c")).withColumn(
        "label", (F.col("a") * F.col("b") + 0.3 * F.col("c") > 0.1).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).coalesce(1).persist()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    layers, x, y = [3, 4, 5, 2], rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    w = rng.normal(size=16 + 25 + 12)
    _, g = N.loss_and_gradient(w, layers, x, y)
    for i in range(0, len(w), 7):
        d = np.zeros_like(w)
        d[i] = 1e-6
        slope = (N.loss_and_gradient(w + d, layers, x, y)[0] - N.loss_and_gradient(w - d, layers, x, y)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)


def test_minimise_finds_the_least_point():
    def rosenbrock(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    x, steps = minimise(rosenbrock, np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(x, 1.0, atol=1e-5) and steps < 200


@pytest.mark.parametrize("local", [100_000, 100])
def test_a_fit_takes_mllibs_steps(spark, monkeypatch, local):
    """After 25 steps over whole blocks of 128 rows the weights are MLlib's, in one task and by jobs."""
    monkeypatch.setattr(N, "MLLIB_ROWS", 0)
    monkeypatch.setattr(N, "LOCAL_ROWS", local)
    rows = _rows(spark, 1280)
    want = MultilayerPerceptronClassifier(layers=[3, 6, 4, 2], maxIter=25, seed=3, blockSize=128).fit(rows)
    got = N.NetworkClassifier([3, 6, 4, 2], 25, 3).fit(rows)
    assert type(got) is type(want) and list(got.getLayers()) == [3, 6, 4, 2]
    assert np.allclose(got.weights.toArray(), want.weights.toArray(), rtol=1e-5, atol=1e-6)
    rows.unpersist()


def test_a_fit_does_not_run_a_job_per_step(spark):
    """6,000 rows, 300 steps: a job per step took 20 s and more."""
    rows = _rows(spark, 6000)
    rows.count()
    N.NetworkClassifier([3, 8, 2], 2, 3).fit(rows)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("steps", "steps")
    start = time.time()
    N.NetworkClassifier([3, 8, 2], 300, 3).fit(rows)
    jobs = len(tracker.getJobIdsForGroup("steps"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows.unpersist()
    assert jobs < 60 and time.time() - start < 30


def test_models_of_a_query_are_fitted_side_by_side(spark, monkeypatch):
    from reachlab.plans import base

    monkeypatch.setattr(base, "split", lambda *a: None)
    monkeypatch.setattr(base, "fitted", lambda s, d, n, profile: time.sleep(0.5) or (n, profile))
    start = time.time()
    assert base.fitted_all(spark, "x", ["a", "b", "c", "d"], "explain") == {n: (n, "explain") for n in "abcd"}
    assert time.time() - start < 1.5
