"""Layer 2: invariants of split, models, attribution, tuning and the run log."""

from __future__ import annotations

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reachlab.operators import explain as X
from reachlab.operators import models as M
from reachlab.operators import runs as R
from reachlab.operators import split as S
from reachlab.operators import tune as T
from reachlab.operators.catalog import feature_list_names
from reachlab.sources import fixtures, run_log
from reachlab.plans import base

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def split_df(spark):
    return base.split(spark, SF_SMALL)


def test_split_is_stratified_and_complete(spark, split_df):
    n = split_df.count()
    rep = {r["split"]: r for r in S.split_report(split_df).collect()}
    assert rep["train"]["rows"] + rep["test"]["rows"] == n
    per = split_df.groupBy("label").agg(F.avg((F.col("split") == "test").cast("double")).alias("f")).collect()
    for r in per:
        assert r["f"] == pytest.approx(0.2, abs=0.02)


def test_folds_disjoint_and_stratified(spark, split_df):
    train = split_df.where(F.col("split") == "train")
    folds = S.cv_folds(train)
    assert folds.select("id").distinct().count() == train.count()
    sizes = folds.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in sizes:
        by_label.setdefault(r["label"], []).append(r["count"])
    for counts in by_label.values():
        assert max(counts) - min(counts) <= 1


def test_population_scaler(spark, split_df):
    feats = feature_list_names(split_df, "label")
    out = S.standardize(split_df, feats).where(F.col("split") == "train")
    st = out.agg(F.avg("Income").alias("m"), F.stddev_pop("Income").alias("s")).first()
    assert st["m"] == pytest.approx(0.0, abs=1e-9) and st["s"] == pytest.approx(1.0, abs=1e-9)


def test_class_weights_balanced(spark, split_df):
    w = {r["label"]: r for r in S.class_weights(split_df).collect()}
    n = split_df.count()
    for r in w.values():
        assert r["weight"] == pytest.approx(n / (2 * r["n_class"]), abs=1e-6)


@pytest.mark.parametrize("name", ["logistic", "tree"])
def test_model_scores_are_probabilities(spark, split_df, name):
    feats = feature_list_names(split_df, "label")
    m = M.fit_model(name, split_df.where(F.col("split") == "train"), feats)
    s = M.score(m, split_df.where(F.col("split") == "test"), feats, name)
    st = s.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= st["lo"] <= st["hi"] <= 1.0
    assert st["n"] == split_df.where(F.col("split") == "test").count()


def test_logistic_attributions_are_additive(spark, split_df):
    """base + sum of contributions = the model's log-odds for every row."""
    feats = feature_list_names(split_df, "label")
    m = M.fit_model("logistic", split_df.where(F.col("split") == "train"), feats)
    test = split_df.where(F.col("split") == "test")
    attr = X.logistic_attributions(m, test, feats)
    total = attr.groupBy("id").agg((F.first("base_value") + F.sum("contribution")).alias("z"))
    p = M.score(m, test, feats, "logistic").select("id", "p")
    j = total.join(p, "id").collect()
    for r in j:
        assert 1 / (1 + math.exp(-r["z"])) == pytest.approx(r["p"], abs=1e-9)


def test_linear_attribution_additivity(spark):
    raw = base.raw(spark, SF_SMALL)
    a = base.attributions(spark, SF_SMALL).where(F.col("model") == "linear_a")
    w = {"Recency": -0.02, "Income": 0.00001, "MntWines": 0.001, "NumWebPurchases": 0.05, "AcceptedCmp5": 1.0}
    tot = a.groupBy("id").agg((F.first("base_value") + F.sum("contribution")).alias("z"))
    means = raw.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in w]).first()
    z = F.lit(-1.7)
    for f, v in w.items():
        z = z + F.lit(v) * F.coalesce(F.col(f).cast("double"), F.lit(means[f]))
    direct = raw.select(F.col("ID").alias("id"), z.alias("zz"))
    for r in tot.join(direct, "id").collect():
        assert r["z"] == pytest.approx(r["zz"], abs=1e-9)


def test_permutation_importance_zero_for_unused_feature(spark):
    raw = base.raw(spark, SF_SMALL).select(F.col("ID").alias("id"), F.col("Response").alias("label"),
                                           "Recency", "Kidhome")
    imp = X.permutation_importance(raw, X.linear_score({"Recency": -0.02}), ["Recency", "Kidhome"], repeats=3)
    got = {r["feature"]: r for r in imp.collect()}
    assert got["Kidhome"]["importance_mean"] == 0.0 and got["Kidhome"]["importance_std"] == 0.0


def test_search_space_reproducible_and_in_range(spark):
    a = T.search_space(spark, "mlp", 10).collect()
    b = T.search_space(spark, "mlp", 10).collect()
    assert a == b
    for t in range(10):
        p = T.sample_params("mlp", t)
        assert 1 <= p["n_hidden_layers"] <= 4
        assert sum(k.startswith("neurons_layer_") for k in p) == p["n_hidden_layers"]
        assert all(16 <= p[f"neurons_layer_{i}"] <= 256 for i in range(p["n_hidden_layers"]))
        assert p["max_iter"] % 100 == 0 and 200 <= p["max_iter"] <= 1000


def test_best_so_far_is_monotone(spark):
    trials = spark.createDataFrame([(0, 0.3, {}), (1, None, {}), (2, 0.2, {}), (3, 0.5, {})],
                                   "trial long, score double, params map<string,string>")
    got = [(r["trial"], r["best_so_far"]) for r in T.best_so_far(trials).orderBy("trial").collect()]
    assert got == [(0, 0.3), (1, None), (2, 0.3), (3, 0.5)]


def test_ascii_safe_cases(spark):
    df = spark.createDataFrame([("🧠 MLP (Neural Network)",), ("Réponse  ·  run",), ("·· --",), (None,)], "s string")
    got = [r[0] for r in df.select(R.ascii_safe(F.col("s"))).collect()]
    assert got == ["MLP (Neural Network)", "Reponse run", "run", None]


def test_recent_runs_limit_before_filter(spark):
    rows = [(f"r{i}", "n", "m", "hparam-search" if i % 2 else "classify-baseline",
             i, "finished") for i in range(150)]
    df = spark.createDataFrame(rows, "id string, name string, model string, job_type string, t int, state string")
    df = df.withColumn("created_at", F.timestamp_seconds("t"))
    limited_first = R.recent_runs(df, "hparam-search", 100).count()
    filtered_first = df.where(F.col("job_type").contains("hparam-search")).orderBy(
        F.col("created_at").desc()).limit(100).count()
    assert limited_first == 50 and filtered_first == 75


def test_run_sink_roundtrip(spark):
    trials = spark.createDataFrame([(0, 0.4, 0.6, 10, {"w": "1.0"}), (1, 0.5, 0.7, 10, {"w": "2.0"})],
                                   "trial long, ap double, auc double, n long, params map<string,string>")
    runs = fixtures.runs_from_search(trials)
    path = os.path.join(tempfile.mkdtemp(prefix="reachlab-runs-", dir="/tmp"), "runs")
    assert R.append_runs(runs, path, "a") and R.append_runs(runs, path, "b.c/d")
    assert not R.append_runs(runs, path, "a")                    # a retried batch adds nothing
    back = run_log.read(spark, path, runs.schema)
    assert back.count() == 4 and set(back.columns) >= {"id", "summary", "config", "job_type"}
    mpath = path + "_metrics"
    metrics = R.run_metrics(trials)
    R.append_run_metrics(metrics, mpath, "a")
    steps = {(r["step"], r["metric"]): r["value"] for r in run_log.read(spark, mpath, metrics.schema).collect()}
    assert steps[(1, "best_so_far")] == 0.5 and steps[(0, "trial_score")] == 0.4


def test_ascii_safe_maps_and_lists(spark):
    entries = ["Réponse", " café · ", "Reponse", "x", "é  è", "日本"]
    df = spark.createDataFrame([(1, ["Ünïx", None, "·"]), (2, None)], "i int, l array<string>").withColumn(
        "m", F.when(F.col("i") == 1, F.create_map(*[F.lit(e) for e in entries])))
    got = df.select("i", R.ascii_safe_map(F.col("m")).alias("m"), R.ascii_safe_list(F.col("l")).alias("l")) \
        .orderBy("i").collect()
    assert got[0]["m"] == {"Reponse": "x", "e e": "run"} and got[0]["l"] == ["Unix", None, "run"]
    assert got[1]["m"] is None and got[1]["l"] is None
