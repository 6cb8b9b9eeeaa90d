"""Training and scoring (D7-D13) with MLlib pipelines.

Every pipeline is ``impute -> [scale] -> [balanced weights] -> assemble ->
classifier``. Imputation, scaling and weights are Estimators, so each CV fold
refits them on its own training part (no leakage across folds). The fitted
pipeline scores the test rows in one ``transform``; the positive-class
probability comes out of the vector with ``vector_to_array``.

MLlib differs from the reference's library in known ways (binned tree
splits, depth <= 30, sigmoid-only MLP): model scores are not expected to
match it to the digit; the tests check invariants instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlab.functions.quantiles import exact_quantiles
from reachlab.operators.evaluate import ranking_metrics
from reachlab.operators.forest import ForestClassifier
from reachlab.operators.gbt import BoostedClassifier
from reachlab.operators.mlp import LOCAL_ROWS, NetworkClassifier
from reachlab.operators.split import SEED, PopulationStandardScaler

# --- fixed values: model configurations of the reference ---------------------------
# "compare" is the prediction page, "explain" the attribution page.
PROFILES = {
    "compare": {
        "logistic": dict(C=1.0, max_iter=2000, balanced=True),
        "tree": dict(max_depth=10, balanced=True),
        "forest": dict(n_trees=200, balanced=True),
        "gbt": dict(n_trees=200, max_depth=3, step=0.1, balanced=False),
        "mlp": dict(hidden=(64, 32), max_iter=500, balanced=False),
    },
    "explain": {
        "logistic": dict(C=1.0, max_iter=2000, balanced=True),
        "tree": dict(max_depth=None, balanced=True),
        "forest": dict(n_trees=100, balanced=True),
        "gbt": dict(n_trees=100, max_depth=3, step=0.1, balanced=False),
        "mlp": dict(hidden=(100,), max_iter=1000, balanced=False),
    },
}
MODEL_NAMES = ["logistic", "tree", "forest", "gbt", "mlp"]
LONGEST_FITS = ["mlp", "forest", "gbt"]   # started first
# -------------------------------------------------------------------------------------

# MLlib's deepest tree is 30 levels; "unlimited" maps there, for single trees
# and forests alike (MLlib splits a level into node groups that fit
# maxMemoryInMB, so depth costs passes, not memory). Forests cache the rows'
# node ids: tasks then need not carry the trees grown so far.
MLLIB_MAX_DEPTH = 30
# Rows that one partition of a fold holds at least before a fit uses another task; a single
# fit, which has the cluster to itself, takes less. With all slots in use partitions grow to
# FIT_ROWS_AT_MOST: a fit is hundreds of short jobs, whose cost goes with their tasks.
FIT_ROWS_PER_TASK = 20_000
LONE_FIT_ROWS_PER_TASK = 5_000
FIT_ROWS_AT_MOST = 200_000


def fit_tasks(n: int, slots: int, rows_per_task: int) -> int:
    """Partitions for a fit on ``n`` rows."""
    return max(1, -(-n // FIT_ROWS_AT_MOST), min(slots, -(-n // rows_per_task)))


def spread(rows: DataFrame, n: int, rows_per_task: int = FIT_ROWS_PER_TASK) -> DataFrame:
    """``rows`` (``n`` of them) dealt into the partitions of a fit. A table of few bytes comes out
    of one or two files, however many rows it has, and every pass would run in as many tasks."""
    tasks = fit_tasks(n, rows.sparkSession.sparkContext.defaultParallelism, rows_per_task)
    return rows.repartition(tasks) if tasks > 1 else rows.coalesce(1)


class MedianImputer(Estimator, HasInputCols):
    """Fill NULLs with each column's exact median on the fit rows."""

    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        # every column gets a fill value: a NULL may first appear when scoring
        cols = self.getInputCols()
        meds = exact_quantiles(dataset, cols, [0.5])
        return MedianImputerModel(cols, [float(meds[c][0] if meds[c][0] is not None else 0.0)
                                         for c in cols])


class MedianImputerModel(Model, HasInputCols):
    fills = Param(Params._dummy(), "fills", "fill values", TypeConverters.toListFloat)

    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols), fills=list(fills))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fills = dict(zip(self.getInputCols(), self.getOrDefault(self.fills)))
        return dataset.select(*[
            F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
            for c in dataset.columns])


class BalancedWeights(Estimator, HasLabelCol):
    """Weight column n / (2 n_class), counted on the fit rows (class_weight='balanced')."""

    def __init__(self, labelCol: str = "label"):
        super().__init__()
        self._set(labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> "BalancedWeightsModel":
        y = self.getLabelCol()
        rows = dataset.groupBy(y).count().collect()            # one row per class
        n = sum(r["count"] for r in rows)
        k = len(rows)
        w = {float(r[y]): n / (k * r["count"]) for r in rows}
        return BalancedWeightsModel(y, [w.get(0.0, 1.0), w.get(1.0, 1.0)])


class BalancedWeightsModel(Model, HasLabelCol):
    weights = Param(Params._dummy(), "weights", "weight of class 0 and 1", TypeConverters.toListFloat)

    def __init__(self, labelCol="label", weights=None):
        super().__init__()
        self._set(labelCol=labelCol)
        if weights is not None:
            self._set(weights=list(weights))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w0, w1 = self.getOrDefault(self.weights)
        y = F.col(self.getLabelCol())
        return dataset.withColumn("weight", F.when(y == 1, F.lit(w1)).otherwise(F.lit(w0)))


def classifier(name: str, n_features: int, n_train: int, profile: str = "compare",
               seed: int = SEED):
    cfg = PROFILES[profile][name]
    weight = {"weightCol": "weight"} if cfg.get("balanced") else {}
    if name == "logistic":
        # reference objective: 0.5 |w|^2 + C sum_i w_i loss_i ; MLlib: (1/sum w) sum_i w_i loss_i
        # + reg/2 |w|^2. Balanced weights sum to n_train, so reg = 1 / (C n_train).
        return LogisticRegression(maxIter=cfg["max_iter"], regParam=1.0 / (cfg["C"] * max(n_train, 1)),
                                  elasticNetParam=0.0, standardization=False, **weight)
    if name == "tree":
        depth = cfg["max_depth"] or MLLIB_MAX_DEPTH
        return DecisionTreeClassifier(maxDepth=min(depth, MLLIB_MAX_DEPTH), seed=seed, **weight)
    if name == "forest":
        return ForestClassifier(cfg["n_trees"], MLLIB_MAX_DEPTH, weight_col=weight.get("weightCol"), seed=seed)
    if name == "gbt":
        return BoostedClassifier(cfg["n_trees"], cfg["max_depth"], cfg["step"], seed)
    if name == "mlp":
        return NetworkClassifier([n_features, *cfg["hidden"], 2], cfg["max_iter"], seed)
    raise ValueError(f"unknown model {name!r}")


def build_pipeline(name: str, features: Sequence[str], n_train: int, scale: bool = True,
                   profile: str = "compare", label: str = "label") -> Pipeline:
    feats = list(features)
    cfg = PROFILES[profile][name]
    stages = [MedianImputer(inputCols=feats)]
    if scale:
        stages.append(PopulationStandardScaler(inputCols=feats))
    if cfg.get("balanced"):
        stages.append(BalancedWeights(labelCol=label))
    stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="error"))
    clf = classifier(name, len(feats), n_train, profile).setLabelCol(label).setFeaturesCol("features")
    stages.append(clf)
    return Pipeline(stages=stages)


def _as_training(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return df.select("id", *[F.col(c).cast("double").alias(c) for c in features],
                     F.col(label).cast("double").alias("label"))


def fit_model(name: str, train: DataFrame, features: Sequence[str], scale: bool = True,
              profile: str = "compare", label: str = "label", smote: bool = False) -> PipelineModel:
    """Fit the named model's pipeline on ``train``.

    With ``smote``, imputation and scaling are fitted first, the minority
    class of the transformed training rows is oversampled (D6), and the rest
    of the pipeline is fitted on the balanced rows; the returned model chains
    all stages, so scoring never resamples.
    """
    data = _as_training(train, features, label)
    if not smote:
        n = data.count()
        dealt = spread(data, n, LONE_FIT_ROWS_PER_TASK).persist()
        try:
            return build_pipeline(name, features, n, scale, profile).fit(dealt)
        finally:
            dealt.unpersist()
    from reachlab.operators.resample import smote as oversample

    pre = [MedianImputer(inputCols=list(features)).fit(data)]
    cur = pre[0].transform(data)
    if scale:
        pre.append(PopulationStandardScaler(inputCols=list(features)).fit(cur))
        cur = pre[-1].transform(cur)
    balanced = oversample(cur, features, "label").drop("synthetic", "base_id", "nbr_id")
    balanced = balanced.persist()   # the search is not run again for the count
    n = balanced.count()
    tail = build_pipeline(name, features, n, scale=False, profile=profile).getStages()[1:]
    dealt = spread(balanced, n, LONE_FIT_ROWS_PER_TASK).persist()
    try:
        rest = Pipeline(stages=tail).fit(dealt)
    finally:
        dealt.unpersist()
        balanced.unpersist()
    return PipelineModel(stages=[*pre, *rest.stages])


def score(model: PipelineModel, rows: DataFrame, features: Sequence[str], name: str,
          label: str = "label") -> DataFrame:
    """(model, id, label, p, prediction) for the given rows."""
    out = model.transform(_as_training(rows, features, label))
    return out.select(F.lit(name).alias("model"), "id", F.col("label").cast("int").alias("label"),
                      vector_to_array("probability")[1].alias("p"),
                      F.col("prediction").cast("int").alias("prediction"))


def score_models(split_df: DataFrame, features: Sequence[str], names: Sequence[str] = MODEL_NAMES,
                 scale: bool = True, profile: str = "compare", label: str = "label",
                 fitted: dict | None = None) -> DataFrame:
    """Fit each model on split == 'train', score split == 'test', union."""
    train = split_df.where(F.col("split") == "train")
    test = split_df.where(F.col("split") == "test")
    parts = []
    for n in names:
        m = fitted[n] if fitted and n in fitted else fit_model(n, train, features, scale, profile, label)
        parts.append(score(m, test, features, n, label))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Fold:
    """One fold, prepared once for all models: assembled fit rows and held-out rows, persisted."""

    def __init__(self, data: DataFrame, fold: int, features: Sequence[str], scale: bool):
        fit = data.where(F.col("fold") != fold)
        stages = [MedianImputer(inputCols=list(features)).fit(fit)]
        cur = stages[0].transform(fit)
        if scale:
            stages.append(PopulationStandardScaler(inputCols=list(features)).fit(cur))
            cur = stages[-1].transform(cur)
        self._keep(data, cur, data.where(F.col("fold") == fold), features, stages)

    def _keep(self, data: DataFrame, fit: DataFrame, held: DataFrame, features: Sequence[str], stages: list) -> None:
        weights = BalancedWeights(labelCol="label").fit(fit)
        assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
        rows = assembler.transform(weights.transform(fit)).select("label", "weight", "features")
        n = data.count()
        self.fit_rows = spread(rows, n).persist()
        self.n_fit = self.fit_rows.count()
        held = PipelineModel(stages=[*stages, weights, assembler]).transform(held)
        self.held = spread(held.select("id", "label", "features"), n).persist()

    def release(self) -> None:
        self.fit_rows.unpersist()
        self.held.unpersist()


class _SmoteFold(_Fold):
    """A fold of rows that are filled and scaled already; its fit rows are oversampled among themselves."""

    def __init__(self, data: DataFrame, fold: int, features: Sequence[str], neighbours: DataFrame):
        from reachlab.operators.resample import smote

        fit = smote(data.where(F.col("fold") != fold), features, "label",
                    neighbours=neighbours.where(F.col("held") == fold))
        self._keep(data, fit.drop("synthetic", "base_id", "nbr_id"), data.where(F.col("fold") == fold), features, [])


def fold_slots(df: DataFrame) -> int:
    """Fits that run at the same time: half the cluster's task slots, one at least."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism // 2)


def cross_validate(folds_df: DataFrame, features: Sequence[str], names: Sequence[str] = MODEL_NAMES,
                   k: int = 5, scale: bool = True, profile: str = "compare", label: str = "label",
                   parallelism: int | None = None, smote: bool = False) -> DataFrame:
    """Per model, ROC AUC on each held-out fold (fit on the other folds, with
    imputation, scaling and weights refitted inside), then mean and population std.

    With ``smote`` the minority class is oversampled inside each fold's fit rows
    (D6). As in the reference, imputation and scaling are then fitted once on all
    the rows given, so that all folds share one space and one neighbour search
    (``fold_neighbours``); no synthetic row has a parent in the held-out fold.

    A fold is prepared once and shared by all models; each fit is scored at
    once, so that only one number per (model, fold) stays. Fits are independent
    Spark jobs, ``parallelism`` (default ``fold_slots``) of them at a time.
    """
    feats = list(features)
    data = folds_df.select("id", "fold", *[F.col(c).cast("double").alias(c) for c in feats],
                           F.col(label).cast("double").alias("label"))
    neighbours = None
    if smote:
        data = MedianImputer(inputCols=feats).fit(data).transform(data)
        data = PopulationStandardScaler(inputCols=feats).fit(data).transform(data) if scale else data
    data = data.persist()
    if smote:
        neighbours = minority_neighbours(data, feats, k)
    # fits of so few rows take a slot each
    slots = parallelism or fold_slots(folds_df) * (2 if data.count() <= LOCAL_ROWS else 1)
    with ThreadPoolExecutor(max_workers=slots) as pool:
        folds = list(pool.map(lambda f: _SmoteFold(data, f, feats, neighbours) if smote
                              else _Fold(data, f, feats, scale), range(k)))

        def run(task):
            name, f = task
            fold = folds[f]
            clf = classifier(name, len(feats), fold.n_fit, profile).setLabelCol("label").setFeaturesCol("features")
            out = clf.fit(fold.fit_rows).transform(fold.held).select(
                F.lit(name).alias("model"), F.col("label").cast("int").alias("label"),
                vector_to_array("probability")[1].alias("p"))
            got = ranking_metrics(out).first()
            return name, f, got["roc_auc"] if got else None

        longest = sorted(names, key=lambda n: LONGEST_FITS.index(n) if n in LONGEST_FITS else len(LONGEST_FITS))
        rows = list(pool.map(run, [(n, f) for n in longest for f in range(k)]))
    for fold in folds:
        fold.release()
    data.unpersist()
    per_fold = folds_df.sparkSession.createDataFrame(rows, "model string, fold int, roc_auc double")
    summary = per_fold.groupBy("model").agg(F.avg("roc_auc").alias("cv_mean"),
                                            F.stddev_pop("roc_auc").alias("cv_std"))
    return per_fold.join(summary, "model").select(
        "model", "fold", F.round("roc_auc", 6).alias("roc_auc"), F.round("cv_mean", 6).alias("cv_mean"),
        F.round("cv_std", 6).alias("cv_std"))


def minority_neighbours(data: DataFrame, features: Sequence[str], folds: int) -> DataFrame:
    """``fold_neighbours`` of the rows of the rarer label of ``data(id, fold, label, features...)``.

    The folds are stratified, so the rarer label is the same with any fold left out.
    """
    from reachlab.operators.resample import fold_neighbours

    counts = {r["label"]: r["count"] for r in data.where(F.col("label").isNotNull())
              .groupBy("label").count().collect()}  # one row per class
    rarer = min(counts, key=lambda c: (counts[c], c))
    x = F.array(*[F.col(c) for c in features])
    return fold_neighbours(data.where(F.col("label") == rarer).select("id", x.alias("x"), "fold"), folds)
