"""Explainability.

Attribution tables are long: ``attributions(model, id, feature, value,
contribution, base_value, space)``. Global views aggregate them per (model,
feature) with partial aggregation; per-customer views rank at most #features
rows per (model, id); ranks over all customers (Spearman) come from
``functions.ordered.running_totals`` instead of a whole-group window.

Permutation importance (G3) sends each row's value of a feature to another row by a
keyed permutation of the row numbers (``functions.permute``): narrow (feature, repeat,
place, value) rows meet the table in one shuffle join; nothing is ranked per repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlab.functions.columns import hash_order, r6, safe_div
from reachlab.functions.ordered import rank_within, running_totals
from reachlab.functions.permute import bottom_k, permuted_places, round_tables
from reachlab.operators.evaluate import ranking_metrics

# --- fixed values of the reference's explainability page ---------------------------
TOP_DRIVERS = 3
BEESWARM_FEATURES = 10
BEESWARM_POINTS = 400
CUSTOMER_TOP = 10
PERMUTATION_REPEATS = 10
DIRECTION_CUT = 0.25
ARROW_UP, ARROW_DOWN, ARROW_FLAT, ARROW_MIXED = "↑", "↓", "→", "↔"
SEED = 42
# -------------------------------------------------------------------------------------


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_attributions(df: DataFrame, model: str, weights: Mapping[str, float],
                        intercept: float | None = None, space: str = "log_odds") -> DataFrame:
    """Exact attributions of a linear score w . x + b: contribution_j =
    w_j (x_j - mean_j), base = b + w . mean (the score at the mean point).

    This is the Shapley value of a linear model under feature independence.
    Missing values are treated as the mean (contribution 0). The means are one
    aggregate row, broadcast to every row.
    """
    feats = list(weights)
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats])
    mrow = means.first()                                   # #features scalars
    base = (intercept or 0.0) + sum(weights[f] * (mrow[f] or 0.0) for f in feats)
    items = F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 F.coalesce(F.col(f).cast("double"), F.lit(mrow[f])).alias("value"),
                 (F.lit(weights[f]) * (F.coalesce(F.col(f).cast("double"), F.lit(mrow[f]))
                                       - F.lit(mrow[f]))).alias("contribution"))
        for f in feats])
    return df.select(F.lit(model).alias("model"), F.col("id").cast("long").alias("id"),
                     F.explode(items).alias("a")).select(
        "model", "id", "a.feature", "a.value", "a.contribution",
        F.lit(base).alias("base_value"), F.lit(space).alias("space"))


# G6 / G7 / G13 ------------------------------------------------------------------------
def mean_abs_shap(attr: DataFrame) -> DataFrame:
    """Global ranking: mean |contribution| per (model, feature), ranked."""
    g = attr.groupBy("model", "feature").agg(F.avg(F.abs("contribution")).alias("m"))
    w = Window.partitionBy("model").orderBy(F.col("m").desc(), F.col("feature"))
    # one row per (model, feature): the window holds #features rows per model
    return g.select("model", "feature", r6("m").alias("mean_abs_shap"),
                    F.row_number().over(w).alias("rank"))


def key_drivers(ranking: DataFrame, score_col: str = "mean_abs_shap", k: int = TOP_DRIVERS,
                describe=None) -> DataFrame:
    """Top k features per model from a ranking (SHAP, or importance as fallback),
    with their descriptions (G13)."""
    w = Window.partitionBy("model").orderBy(F.col(score_col).desc(), F.col("feature"))
    top = ranking.select("model", "feature", score_col, F.row_number().over(w).alias("rank")) \
        .where(F.col("rank") <= k)
    if describe is not None:
        top = describe(top)
    return top


# G8 -------------------------------------------------------------------------------------
def _average_ranks(pairs: DataFrame, col: str, out: str) -> DataFrame:
    """Average rank (ties share the mean position) of ``col`` within (model, feature)."""
    counts = pairs.groupBy("model", "feature", col).agg(F.sum("__c").alias("__c"))
    rt = running_totals(counts, ["model", "feature"], col, ["__c"], descending=False)
    return rt.select("model", "feature", col,
                     ((F.col("cum___c") - F.col("__c")) + (F.col("__c") + 1) / 2.0).alias(out))


def driver_direction(attr: DataFrame) -> DataFrame:
    """Spearman correlation of a feature's value with its contribution, mapped
    to an arrow: constant value -> '→', undefined -> '→', > 0.25 '↑',
    < -0.25 '↓', otherwise '↔'.

    Rows are counted per (value, contribution) first, so that a 0/1 feature is
    a handful of rows in the joins with the ranks, whatever its frequency.
    """
    pairs = attr.groupBy("model", "feature", "value", "contribution").agg(F.count(F.lit(1)).alias("__c"))
    rv = _average_ranks(pairs, "value", "rv")
    rc = _average_ranks(pairs, "contribution", "rc")
    j = pairs.join(rv, ["model", "feature", "value"]).join(rc, ["model", "feature", "contribution"])
    n, w = F.sum("__c"), F.col("__c")
    mean = lambda c: F.sum(w * c) / n
    # a difference within rounding is no variance
    var = lambda c: F.when(mean(c * c) - mean(c) * mean(c) > mean(c) * mean(c) * 1e-12,
                           mean(c * c) - mean(c) * mean(c)).otherwise(F.lit(0.0))
    v, c = F.col("rv"), F.col("rc")
    stats = j.groupBy("model", "feature").agg(
        F.countDistinct("value").alias("n_values"), (mean(v * c) - mean(v) * mean(c)).alias("cov"),
        var(v).alias("vv"), var(c).alias("vc"))
    rho = safe_div(F.col("cov"), F.sqrt(F.col("vv") * F.col("vc")))
    arrow = (F.when(F.col("n_values") < 2, ARROW_FLAT)
             .when(rho.isNull(), ARROW_FLAT)
             .when(rho > DIRECTION_CUT, ARROW_UP)
             .when(rho < -DIRECTION_CUT, ARROW_DOWN).otherwise(ARROW_MIXED))
    return stats.select("model", "feature", r6(rho).alias("spearman"), arrow.alias("direction"))


# G9 -------------------------------------------------------------------------------------
def beeswarm_points(attr: DataFrame, ranking: DataFrame, n_features: int = BEESWARM_FEATURES,
                    n_points: int = BEESWARM_POINTS, seed: int = SEED) -> DataFrame:
    """Points for a beeswarm plot: the top features by mean |SHAP| and a seeded
    sample of customers (first ``n_points`` ids in md5(seed|id) order; the cap
    is the feature)."""
    top = ranking.where(F.col("rank") <= n_features).select("model", "feature")
    ids = attr.select("model", "id").distinct()
    picked = ranked_sample(ids, n_points, seed)
    return attr.join(F.broadcast(top), ["model", "feature"]).join(picked, ["model", "id"]).select(
        "model", "id", "feature", r6("value").alias("value"), r6("contribution").alias("contribution"))


def ranked_sample(ids: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The first n ids per model ordered by the 60-bit prefix of md5(seed|id), ties by
    id: every partition keeps its own n, only those are ranked together."""
    keyed = ids.withColumn("__k", F.conv(F.substring(hash_order(seed, "id"), 1, 15), 16, 10)
                           .cast("long"))
    return bottom_k(keyed, ["model"], ["__k", "id"], n).select("model", "id")


# G11 ------------------------------------------------------------------------------------
def customer_explanation(attr: DataFrame, top: int = CUSTOMER_TOP) -> DataFrame:
    """Per (model, customer): output = base + sum of contributions; probability
    (sigmoid only for log-odds attributions), base probability, change in
    points, above/below, number of positive and negative drivers, and the top
    drivers by |contribution| (one row each)."""
    w_id = Window.partitionBy("model", "id")               # #features rows per customer
    w_rank = w_id.orderBy(F.abs("contribution").desc(), F.col("feature"))
    total = F.col("base_value") + F.sum("contribution").over(w_id)
    is_logit = F.col("space") == "log_odds"
    prob = F.when(is_logit, sigmoid(total)).otherwise(total)
    base_prob = F.when(is_logit, sigmoid(F.col("base_value"))).otherwise(F.col("base_value"))
    out = attr.select(
        "model", "id", "feature", "value", "contribution", "base_value", "space",
        total.alias("output"), prob.alias("probability"), base_prob.alias("base_probability"),
        F.sum(F.when(F.col("contribution") > 0, 1).otherwise(0)).over(w_id).alias("n_positive"),
        F.sum(F.when(F.col("contribution") < 0, 1).otherwise(0)).over(w_id).alias("n_negative"),
        F.row_number().over(w_rank).alias("rank"))
    delta = (F.col("probability") - F.col("base_probability")) * 100.0
    return out.where(F.col("rank") <= top).select(
        "model", "id", "rank", "feature", r6("value").alias("value"),
        r6("contribution").alias("contribution"), r6("output").alias("output"),
        r6("probability").alias("probability"), r6("base_probability").alias("base_probability"),
        r6(delta).alias("delta_points"),
        F.when(delta >= 0, "above").otherwise("below").alias("vs_base"),
        F.col("n_positive").cast("int").alias("n_positive"),
        F.col("n_negative").cast("int").alias("n_negative"))


# G12 ------------------------------------------------------------------------------------
def ranking_agreement(rankings: Mapping[str, DataFrame]) -> DataFrame:
    """Full outer join of several (model, feature, rank) rankings; spread =
    max rank - min rank over the methods that rank the feature."""
    names = list(rankings)
    out = None
    for n in names:
        r = rankings[n].select("model", "feature", F.col("rank").cast("int").alias(f"rank_{n}"))
        out = r if out is None else out.join(r, ["model", "feature"], "full_outer")
    ranks = [F.col(f"rank_{n}") for n in names]
    return out.select("model", "feature", *ranks,
                      (F.greatest(*ranks) - F.least(*ranks)).alias("rank_spread"))


# G3 -------------------------------------------------------------------------------------
def permutation_importance(rows: DataFrame, score_fn, features: Sequence[str],
                           repeats: int = PERMUTATION_REPEATS, seed: int = SEED,
                           model: str = "model") -> DataFrame:
    """Mean and population std over repeats of the ROC AUC drop when one
    feature's values are permuted across rows.

    ``rows`` has id, label and the features; ``score_fn(df)`` maps a frame with
    those columns to a double column ``p``. Rows are numbered in id order; the value of row i goes to row ``permuted(i)`` under (feature,
    repeat). Only these values are copied features x repeats times before the
    shuffle; the rows they belong to join them where they are scored. The
    numbered rows are persisted meanwhile; the result has one row per feature.
    """
    from pyspark import StorageLevel

    feats = list(features)
    base = ranking_metrics(score_fn(rows).select(F.lit(model).alias("model"), "id", "label", "p"))
    base_auc = base.first()["roc_auc"]                      # one scalar
    ordered = rank_within(rows.select("id", "label", *feats).withColumn("__g", F.lit(0)), ["__g"], "id", "id",
                          out="__i").drop("__g")
    # the numbers may come out of few partitions; spread the rows before they are copied
    ordered = ordered.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = ordered.count()
        moved = _moved_values(ordered, feats, repeats, n, seed)
        # the rows' side is small beside the moved values, which then need no sort
        swapped = moved.join(ordered.hint("shuffle_hash"), F.col("__to") == F.col("__i"))
        permuted_rows = swapped.select(
            "feature", "rep", "id", "label",
            *[F.when(F.col("feature") == f, F.col("__v")).otherwise(F.col(f)).alias(f) for f in feats])
        scored = score_fn(permuted_rows).select(
            F.lit(model).alias("model"), "feature", "rep", "id", "label", "p")
        per_rep = ranking_metrics(scored, group=("model", "feature", "rep"))   # eager
    finally:
        ordered.unpersist()
    drops = per_rep.withColumn("drop", F.lit(base_auc) - F.col("roc_auc"))
    return drops.groupBy("model", "feature").agg(
        r6(F.avg("drop")).alias("importance_mean"), r6(F.stddev_pop("drop")).alias("importance_std"))


def _moved_values(ordered: DataFrame, features: list[str], repeats: int, n: int, seed: int) -> DataFrame:
    """(feature, rep, __v, __to): every feature's value of every row, and the row (from 1) that it goes to."""
    tables = [round_tables(n, seed, f, r) for f in features for r in range(repeats)]  # 5 sqrt(n) numbers each

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column(0).to_numpy() - 1
            for key, table in enumerate(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(index), key, dtype=np.int32)), batch.column(1 + key // repeats),
                     pa.array(permuted_places(index, n, table) + 1)], names=["__key", "__v", "__to"])

    values = ordered.select("__i", *[F.col(f).cast("double").alias(f"v{j}") for j, f in enumerate(features)])
    names = F.array(*[F.lit(f) for f in features])
    return values.mapInArrow(move, "__key int, __v double, __to long").select(
        F.get(names, (F.col("__key") / repeats).cast("int")).alias("feature"), (F.col("__key") % repeats).alias("rep"),
        "__v", "__to")


def linear_score(weights: Mapping[str, float], intercept: float = 0.0):
    """score_fn for a fixed linear score w . x + b (log-odds; NULL counts as 0).

    ROC AUC depends only on the order of scores, so the log-odds is used as is.
    """
    def fn(df: DataFrame) -> DataFrame:
        z = F.lit(intercept)
        for f, w in weights.items():
            z = z + F.lit(w) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        return df.withColumn("p", z)
    return fn


def model_score(pipeline_model, features: Sequence[str]):
    """score_fn for a fitted pipeline (positive-class probability)."""
    from pyspark.ml.functions import vector_to_array

    def fn(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in features]
        data = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
        out = pipeline_model.transform(data)
        return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))
    return fn


# G1 / G2 / G10 -------------------------------------------------------------------------
def tree_importance(pipeline_model, features: Sequence[str], model: str) -> DataFrame | None:
    """Built-in impurity importance of a fitted tree model, ranked; None when
    the model has none (the caller falls back to permutation importance)."""
    from pyspark.sql import SparkSession
    clf = pipeline_model.stages[-1]
    if not hasattr(clf, "featureImportances"):
        return None
    imp = clf.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(model, f, float(v)) for f, v in zip(features, imp)],
                               "model string, feature string, importance double")
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")
    return df.select("model", "feature", r6("importance").alias("importance"),
                     F.row_number().over(w).alias("rank"))


def logistic_coefficients(pipeline_model, features: Sequence[str], model: str = "logistic",
                          k: int = 3) -> DataFrame:
    """Coefficients on standardised features, ranked by |coefficient|,
    with flags for the top k positive and top k negative."""
    from pyspark.sql import SparkSession
    clf = pipeline_model.stages[-1]
    coef = clf.coefficients.toArray().tolist()
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(model, f, float(c)) for f, c in zip(features, coef)],
                               "model string, feature string, coefficient double")
    w_abs = Window.partitionBy("model").orderBy(F.abs("coefficient").desc(), "feature")
    w_pos = Window.partitionBy("model").orderBy(F.col("coefficient").desc(), "feature")
    w_neg = Window.partitionBy("model").orderBy(F.col("coefficient").asc(), "feature")
    out = df.select("model", "feature", r6("coefficient").alias("coefficient"),
                    F.row_number().over(w_abs).alias("rank"),
                    F.row_number().over(w_pos).alias("__p"), F.row_number().over(w_neg).alias("__n"))
    return out.select("model", "feature", "coefficient", "rank",
                      ((F.col("__p") <= k) & (F.col("coefficient") > 0)).alias("top_positive"),
                      ((F.col("__n") <= k) & (F.col("coefficient") < 0)).alias("top_negative"))


def logistic_attributions(pipeline_model, rows: DataFrame, features: Sequence[str],
                          model: str = "logistic") -> DataFrame:
    """Exact SHAP values of a fitted logistic pipeline in log-odds space.

    The pipeline's imputer and scaler are applied first; the model is then
    linear in the transformed features, so attribution j is w_j (z_j - mean z_j).
    """
    prepared = rows.select("id", *[F.col(c).cast("double").alias(c) for c in features])
    for stage in pipeline_model.stages[:-2]:               # imputer, scaler, (weights)
        if stage.__class__.__name__ == "BalancedWeightsModel":
            continue
        prepared = stage.transform(prepared)
    clf = pipeline_model.stages[-1]
    weights = dict(zip(features, clf.coefficients.toArray().tolist()))
    return linear_attributions(prepared, model, weights, intercept=float(clf.intercept))

