"""Hyperparameter search (H1-H6).

H1: search spaces are declarative specs; each trial's values are drawn from
hash_unit(seed, model, trial, param), so a study is reproducible (the
reference's sampler is unseeded) and the same draws can be written in SQL.

H2/H3: ``tune_model`` evaluates each trial's MLlib pipeline by k-fold CV on
average precision (or ROC AUC), keeps the best, refits it on the whole
training split and scores the test split. Trials run as concurrent Spark jobs.

H4-H6 work on a trials table ``(trial, score, params map<string,string>)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachlab.functions.columns import r6
from reachlab.operators.evaluate import ranking_metrics


@dataclass(frozen=True)
class Spec:
    """One parameter: kind is int, logint, stepint, float, logfloat or cat."""
    name: str
    kind: str
    low: float = 0.0
    high: float = 0.0
    step: int = 1
    choices: tuple = ()
    when: tuple | None = None      # (other param, predicate on its value)


# --- fixed values: the reference's search spaces -----------------------------------------
# Parameters with no MLlib counterpart (min_samples_split, MLP activation, alpha,
# batch size, early stopping) are not drawn; see README.
SEARCH_SPACES = {
    "logistic": [Spec("C", "logfloat", 0.001, 100.0),
                 Spec("penalty", "cat", choices=("l1", "l2")),
                 Spec("class_weight", "cat", choices=("balanced", "none"))],
    "tree": [Spec("max_depth", "int", 2, 25),
             Spec("min_samples_leaf", "int", 1, 10),
             Spec("criterion", "cat", choices=("gini", "entropy"))],
    "forest": [Spec("n_estimators", "int", 50, 500),
               Spec("max_depth", "int", 3, 30),
               Spec("min_samples_leaf", "int", 1, 10),
               Spec("max_features", "cat", choices=("sqrt", "log2"))],
    "gbt": [Spec("n_estimators", "int", 50, 500),
            Spec("max_depth", "int", 2, 10),
            Spec("learning_rate", "logfloat", 0.01, 0.3),
            Spec("subsample", "float", 0.6, 1.0)],
    "mlp": [Spec("n_hidden_layers", "int", 1, 4),
            *[Spec(f"neurons_layer_{i}", "logint", 16, 256, when=("n_hidden_layers", i))
              for i in range(4)],
            Spec("max_iter", "stepint", 200, 1000, step=100)],
}
DEFAULT_TRIALS = 15
DEFAULT_FOLDS = 5
SEED = 42
# -------------------------------------------------------------------------------------------


def draw(spec: Spec, u: float):
    """Map a uniform u in [0, 1) to the parameter's value."""
    if spec.kind == "int":
        return int(spec.low + math.floor(u * (spec.high - spec.low + 1)))
    if spec.kind == "logint":
        lo, hi = math.log(spec.low), math.log(spec.high + 1)
        return int(min(spec.high, math.floor(math.exp(lo + u * (hi - lo)))))
    if spec.kind == "stepint":
        n = int((spec.high - spec.low) // spec.step) + 1
        return int(spec.low + spec.step * math.floor(u * n))
    if spec.kind == "float":
        return spec.low + u * (spec.high - spec.low)
    if spec.kind == "logfloat":
        lo, hi = math.log(spec.low), math.log(spec.high)
        return math.exp(lo + u * (hi - lo))
    if spec.kind == "cat":
        return spec.choices[int(math.floor(u * len(spec.choices)))]
    raise ValueError(spec.kind)


def _unit(seed: int, *parts) -> float:
    import hashlib
    text = "|".join([str(seed), *[str(p) for p in parts]])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def sample_params(model: str, trial: int, seed: int = SEED) -> dict:
    """H1: one trial's parameters (conditional ones only when active)."""
    out: dict = {}
    for spec in SEARCH_SPACES[model]:
        if spec.when is not None:
            other, idx = spec.when
            if not (idx < out[other]):
                continue
        out[spec.name] = draw(spec, _unit(seed, model, trial, spec.name))
    return out


def search_space(spark: SparkSession, model: str, n_trials: int = DEFAULT_TRIALS,
                 seed: int = SEED) -> DataFrame:
    """H1 as a table: (model, trial, param, value) for n_trials draws."""
    rows = [(model, t, k, str(v)) for t in range(n_trials)
            for k, v in sample_params(model, t, seed).items()]
    return spark.createDataFrame(rows, "model string, trial long, param string, value string")


def mllib_params(model: str, params: dict, n_features: int) -> dict:
    """Translate a drawn parameter set to the classifier's MLlib parameters."""
    if model == "logistic":
        return {"C": params["C"], "elastic": 1.0 if params["penalty"] == "l1" else 0.0,
                "balanced": params["class_weight"] == "balanced"}
    if model == "tree":
        return {"maxDepth": min(params["max_depth"], 30), "minInstancesPerNode": params["min_samples_leaf"],
                "impurity": params["criterion"]}
    if model == "forest":
        return {"numTrees": params["n_estimators"], "maxDepth": min(params["max_depth"], 30),
                "minInstancesPerNode": params["min_samples_leaf"],
                "featureSubsetStrategy": params["max_features"]}
    if model == "gbt":
        return {"maxIter": params["n_estimators"], "maxDepth": params["max_depth"],
                "stepSize": params["learning_rate"], "subsamplingRate": params["subsample"]}
    if model == "mlp":
        hidden = [params[f"neurons_layer_{i}"] for i in range(params["n_hidden_layers"])]
        return {"layers": [n_features, *hidden, 2], "maxIter": params["max_iter"]}
    raise ValueError(model)


# Models that are fitted on scaled features.
SCALED = ("logistic", "mlp")


def _balanced(model: str, p: dict) -> bool:
    return model in ("tree", "forest") or (model == "logistic" and p["balanced"])


def _classifier(model: str, params: dict, n_features: int, n_train: int):
    from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                           MultilayerPerceptronClassifier, RandomForestClassifier)

    p = mllib_params(model, params, n_features)
    w = {"weightCol": "weight"} if _balanced(model, p) else {}
    if model == "logistic":
        return LogisticRegression(maxIter=2000, regParam=1.0 / (p["C"] * max(n_train, 1)),
                                  elasticNetParam=p["elastic"], standardization=False, **w)
    if model == "tree":
        return DecisionTreeClassifier(maxDepth=p["maxDepth"], minInstancesPerNode=p["minInstancesPerNode"],
                                      impurity=p["impurity"], seed=SEED, **w)
    if model == "forest":
        return RandomForestClassifier(numTrees=p["numTrees"], maxDepth=p["maxDepth"],
                                      minInstancesPerNode=p["minInstancesPerNode"], cacheNodeIds=True,
                                      featureSubsetStrategy=p["featureSubsetStrategy"], seed=SEED, **w)
    if model == "gbt":
        return GBTClassifier(maxIter=p["maxIter"], maxDepth=p["maxDepth"], stepSize=p["stepSize"],
                             subsamplingRate=p["subsamplingRate"], seed=SEED)
    return MultilayerPerceptronClassifier(layers=p["layers"], maxIter=p["maxIter"], seed=SEED)


def _pipeline(model: str, params: dict, features: Sequence[str], n_train: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from reachlab.operators.models import BalancedWeights, MedianImputer
    from reachlab.operators.split import PopulationStandardScaler

    feats = list(features)
    stages = [MedianImputer(inputCols=feats)]
    if model in SCALED:
        stages.append(PopulationStandardScaler(inputCols=feats))
    if _balanced(model, mllib_params(model, params, len(feats))):
        stages.append(BalancedWeights())
    stages += [VectorAssembler(inputCols=feats, outputCol="features"),
               _classifier(model, params, len(feats), n_train)]
    return Pipeline(stages=stages)


def tune_model(folds_df: DataFrame, test_df: DataFrame, features: Sequence[str], model: str,
               n_trials: int = DEFAULT_TRIALS, k: int = DEFAULT_FOLDS,
               scoring: str = "average_precision", seed: int = SEED,
               parallelism: int | None = None) -> tuple[DataFrame, dict, DataFrame]:
    """H2 + H3. Returns (trials, best params, test scores of the refit best).

    ``folds_df`` is the training split with a ``fold`` column (cv_folds). A fold
    is prepared once for all trials; each fit is scored at once, so that one
    number per (trial, fold) stays.
    """
    from pyspark.ml.functions import vector_to_array

    from reachlab.operators.models import LONE_FIT_ROWS_PER_TASK, _Fold, fold_slots, spread

    spark = folds_df.sparkSession
    feats = list(features)
    data = folds_df.select("id", "fold", *[F.col(c).cast("double").alias(c) for c in feats],
                           F.col("label").cast("double").alias("label")).persist()
    metric_col = "average_precision" if scoring == "average_precision" else "roc_auc"
    tasks = [(t, f) for t in range(n_trials) for f in range(k)]
    with ThreadPoolExecutor(max_workers=parallelism or fold_slots(folds_df)) as pool:
        folds = list(pool.map(lambda f: _Fold(data, f, feats, model in SCALED), range(k)))

        def run(task):
            t, f = task
            clf = _classifier(model, sample_params(model, t, seed), len(feats), folds[f].n_fit)
            out = clf.setLabelCol("label").fit(folds[f].fit_rows).transform(folds[f].held).select(
                F.lit(t).alias("trial"), F.col("label").cast("int").alias("label"),
                vector_to_array("probability")[1].alias("p"))
            got = ranking_metrics(out, group=("trial",)).first()
            return t, f, got[metric_col] if got else None

        rows = list(pool.map(run, tasks))
    for fold in folds:
        fold.release()
    data.unpersist()
    per_fold = spark.createDataFrame(rows, f"trial long, fold int, {metric_col} double")
    per_trial = per_fold.groupBy("trial").agg(F.avg(metric_col).alias("score"))
    pmap = spark.createDataFrame(
        [(t, {k_: str(v) for k_, v in sample_params(model, t, seed).items()}) for t in range(n_trials)],
        "trial long, params map<string,string>")
    trials = per_trial.join(pmap, "trial").select(
        F.col("trial").cast("long"), r6("score").alias("score"), "params")
    best = trials.orderBy(F.col("score").desc_nulls_last(), "trial").first()  # one row
    best_params = sample_params(model, int(best["trial"]), seed)
    n_train = data.count()
    dealt = spread(data, n_train, LONE_FIT_ROWS_PER_TASK).persist()
    refit = _pipeline(model, best_params, feats, n_train).fit(dealt)
    dealt.unpersist()
    test = test_df.select("id", *[F.col(c).cast("double").alias(c) for c in feats],
                          F.col("label").cast("double").alias("label"))
    scored = refit.transform(test).select(
        F.lit(model).alias("model"), "id", F.col("label").cast("int").alias("label"),
        vector_to_array("probability")[1].alias("p"),
        F.col("prediction").cast("int").alias("prediction"))
    return trials, best_params, scored


# --- H4 - H6 -----------------------------------------------------------------------------
def trial_log(trials: DataFrame, param_names: Sequence[str]) -> DataFrame:
    """H4: one row per trial with the score, its rank (best first) and each
    parameter as a column (NULL where a trial does not have it)."""
    w = Window.orderBy(F.col("score").desc_nulls_last(), "trial")  # #trials rows
    return trials.select("trial", "score", F.row_number().over(w).alias("rank"),
                         *[F.col("params")[p].alias(p) for p in param_names])


def best_so_far(trials: DataFrame) -> DataFrame:
    """H5: running maximum of the score in trial order; a NULL score stays NULL."""
    w = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)  # #trials rows
    return trials.select("trial", "score",
                         F.when(F.col("score").isNull(), None)
                         .otherwise(F.max("score").over(w)).alias("best_so_far"))


def parallel_coords(trials: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """H6: long (trial, dimension, value, label) for a parallel-coordinates
    plot. Categorical values (missing ones as the text 'nan') are coded in
    order of first appearance by trial; numeric ones are kept as they are.
    The score is a dimension too, with its min and max."""
    dims = [F.struct(F.lit("score").alias("dimension"), F.col("score").alias("num"),
                     F.lit(None).cast("string").alias("cat"))]
    dims += [F.struct(F.lit(p).alias("dimension"), F.col("params")[p].cast("double").alias("num"),
                      F.lit(None).cast("string").alias("cat")) for p in numeric]
    dims += [F.struct(F.lit(p).alias("dimension"), F.lit(None).cast("double").alias("num"),
                      F.coalesce(F.col("params")[p], F.lit("nan")).alias("cat")) for p in categorical]
    long = trials.select("trial", F.explode(F.array(*dims)).alias("d")).select(
        "trial", "d.dimension", "d.num", "d.cat")
    first = long.where(F.col("cat").isNotNull()).groupBy("dimension", "cat").agg(
        F.min("trial").alias("first_trial"))
    w = Window.partitionBy("dimension").orderBy("first_trial")   # #levels rows per dimension
    codes = first.select("dimension", "cat", (F.dense_rank().over(w) - 1).alias("code"))
    j = long.join(codes, ["dimension", "cat"], "left")
    value = F.when(F.col("cat").isNotNull(), F.col("code").cast("double")).otherwise(F.col("num"))
    ws = Window.partitionBy("dimension")                          # #trials rows per dimension
    return j.select("trial", "dimension", r6(value).alias("value"), F.col("cat").alias("label"),
                    r6(F.min(value).over(ws)).alias("dim_min"), r6(F.max(value).over(ws)).alias("dim_max"))

