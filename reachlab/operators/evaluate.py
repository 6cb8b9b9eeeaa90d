"""Evaluation (E1-E12) over a score table ``scores(model, id, label, p)``.

Every ranking metric starts by collapsing rows to one per (model, distinct
score) with positive / negative counts, so ties are a single step and the data
shrinks before anything ordered happens. The ordered part uses
``functions.ordered.running_totals``: exact, and range-partitioned once the
distinct scores are too many for one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachlab.functions import ordered
from reachlab.functions.columns import r6, safe_div
from reachlab.functions.ordered import MAX_CUTS, running_totals, same_values

# --- fixed values of the reference's evaluation page ---------------------------
DEFAULT_THRESHOLD = 0.5
PROBA_BINS = 30
RECALL_GUARD = 0.3
PR_BANDS = [(1.5, "near_random"), (2.5, "modest"), (4.0, "solid")]
PR_TOP_BAND = "excellent"
# expected PR band from ROC AUC: [max(0, a*roc - b), min(1, c*roc)]
PR_BAND_A, PR_BAND_B, PR_BAND_C = 0.7, 0.05, 0.85
# top-decile precision estimate: [min(cap, d*ap), min(cap, ap + e)]
TOP_DECILE_CAP, TOP_DECILE_D, TOP_DECILE_E = 0.95, 0.85, 0.1
# Rows of a sample that says where to cut the scores into ranges; every row is ranked.
CUT_SAMPLE = 2_000_000
# -------------------------------------------------------------------------------


def score_counts(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """(group..., p, pos, neg): one row per distinct score."""
    y = F.col("label")
    return scores.groupBy(*group, "p").agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"))


def ranked_counts(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """score_counts plus inclusive running pos / neg from the highest score down."""
    return running_totals(score_counts(scores, group), list(group), "p", ["pos", "neg"],
                          descending=True)


def _totals(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    return counts.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


# E1 / E2 -------------------------------------------------------------------------
def ranking_metrics(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """ROC AUC (ties half) and average precision per group, from one ranking pass.

    The scores (group, p, label's class) are persisted, ranked and released; the
    result -- one row per group -- is collected and returned as a DataFrame. Upstream
    work therefore runs once however deep the scores' lineage is.

    Up to ROWS_PER_TASK rows each group is one sorted window. More are cut into ranges
    of scores (``_cut_points``). Cut points are ranges of their own: values that many
    rows share are among them, and such rows are only counted. The other rows are
    shuffled once, by (group, range), and ranked there with what lies above their range.
    """
    from pyspark import StorageLevel

    group = list(group)
    positive = F.when(F.col("label") == 1, 1).otherwise(0).cast("long")
    rows = scores.select(*group, "p", positive.alias("pos")).withColumn("neg", 1 - F.col("pos")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if n <= ordered.ROWS_PER_TASK:
            counts = rows.groupBy(*group, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            parts = running_totals(counts, group, "p", ["pos", "neg"], descending=True, n_rows=n)
        else:
            parts = _ranked_by_range(rows, group, n)
        # sums over pairs of a positive and a negative row: with the positive at or above, with the negative at or above
        agg = parts.groupBy(*group).agg(
            F.sum(F.col("neg") * F.col("cum_pos").cast("double")).alias("pos_up"),
            F.sum(F.col("pos") * F.col("cum_neg").cast("double")).alias("neg_up"),
            F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("ap_sum"),
            F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        pairs = F.col("n_pos").cast("double") * F.col("n_neg")
        area = F.col("pos_up") - (F.col("pos_up") + F.col("neg_up") - pairs) / 2   # tied pairs are in both sums
        out = agg.select(*group, safe_div(area, pairs).alias("roc_auc"),
                         safe_div(F.col("ap_sum"), F.col("n_pos")).alias("average_precision"),
                         F.col("n_pos").cast("long").alias("n_pos"),
                         F.col("n_neg").cast("long").alias("n_neg"))
        found = out.collect()                               # one row per group
        schema = out.schema
    finally:
        rows.unpersist()
    return scores.sparkSession.createDataFrame(found, schema)


def _cut_points(rows: DataFrame, group: Sequence[str], n: int) -> list[float]:
    """Scores, ascending, that cut every group into ranges of ROWS_PER_TASK rows or fewer.

    They come from a sample, as a range partitioning's do: they decide which task ranks
    a row, not how. A value that more rows share turns up among them.
    """
    sample = rows.select(*group, F.col("p").cast("double").alias("p")).where(
        F.col("p").isNotNull() & ~F.isnan("p")).sample(min(1.0, CUT_SAMPLE / n), seed=0)
    sizes = sample.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c"),
                                                                      F.count(F.lit(1)).alias("g")).first()
    if not sizes["g"]:
        return []
    largest = sizes["c"] / min(1.0, CUT_SAMPLE / n)
    parts = min(max(1, MAX_CUTS // sizes["g"]), 2 * math.ceil(largest / ordered.ROWS_PER_TASK))
    probs = [i / parts for i in range(1, parts)] or [0.5]
    found = sample.groupBy(*group).agg(F.percentile_approx("p", probs, 100 * parts).alias("c")) \
        .select(F.explode("c").alias("c")).distinct().collect()        # at most MAX_CUTS numbers
    return sorted({float(r["c"]) for r in found if math.isfinite(r["c"])})


def _ranked_by_range(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """(group..., pos, neg, cum_pos, cum_neg): a row per scored row, or per value that is a cut
    point; the running sums count all rows of the group at or above the value."""
    from pyspark.ml.feature import Bucketizer

    cuts = _cut_points(rows, group, n)
    x = rows.withColumn("__x", F.col("p").cast("double"))
    # the Bucketizer's ranges [a, b): a binary search in the JVM; NaN lies above all, NULL below
    x = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__x", outputCol="__b",
                   handleInvalid="keep").transform(x)
    lower = F.element_at(F.array(*[F.lit(c) for c in [-math.inf, *cuts, math.inf]]), F.col("__b").cast("int") + 1)
    point = F.col("__x") == lower
    ranged = x.withColumn("__range", F.when(F.col("__x").isNull(), F.lit(-2)).otherwise(
        2 * F.col("__b").cast("int") + F.when(point, 0).otherwise(1))).drop("__x", "__b")
    totals = ranged.groupBy(*group, "__range").agg(F.sum("pos").alias("__tp"), F.sum("neg").alias("__tn"))
    above = Window.partitionBy(*group).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(                                             # #groups x #ranges rows
        *[F.col(g).alias(g + "__k") for g in group], F.col("__range").alias("__range__k"), "__tp", "__tn",
        F.coalesce(F.sum("__tp").over(above), F.lit(0)).alias("__ap"),
        F.coalesce(F.sum("__tn").over(above), F.lit(0)).alias("__an"))
    # even ranges (NULL's is one) hold one value: their rows need no order
    points = totals.where(F.col("__range__k") % 2 == 0).select(
        *[F.col(g + "__k").alias(g) for g in group], F.col("__tp").alias("pos"), F.col("__tn").alias("neg"),
        (F.col("__ap") + F.col("__tp")).alias("cum_pos"), (F.col("__an") + F.col("__tn")).alias("cum_neg"))
    w = Window.partitionBy(*group, "__range").orderBy(F.col("p").desc()) \
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)     # rows of one value share the sums
    inner = ranged.where(F.col("__range") % 2 != 0).select(
        *group, "__range", "pos", "neg", F.sum("pos").over(w).alias("__cp"), F.sum("neg").over(w).alias("__cn"))
    # the totals have #groups x #ranges rows; a join by key would shuffle the ranked rows again
    joined = inner.join(F.broadcast(totals), same_values(inner, totals, [*group, "__range"], "__k"))
    return joined.select(*[inner[g] for g in group], "pos", "neg", (F.col("__ap") + F.col("__cp")).alias("cum_pos"),
                         (F.col("__an") + F.col("__cn")).alias("cum_neg")).unionByName(points)


def roc_auc(scores: DataFrame, group: Sequence[str] = ("model",), rounded: bool = True) -> DataFrame:
    """Area under ROC, ties counted half; NULL when a class is missing.

    ``rounded=False`` keeps full precision for callers that aggregate further.
    """
    m = ranking_metrics(scores, group)
    return m.select(*group, (r6("roc_auc") if rounded else F.col("roc_auc")).alias("roc_auc"))


def average_precision(scores: DataFrame, group: Sequence[str] = ("model",),
                      rounded: bool = True) -> DataFrame:
    """Sum over thresholds of (recall step) x precision, no interpolation."""
    m = ranking_metrics(scores, group)
    ap = F.col("average_precision")
    return m.select(*group, (r6(ap) if rounded else ap).alias("average_precision"))


# E3 ------------------------------------------------------------------------------
def predicted(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Hard prediction as a classifier's predict(): positive when p > threshold."""
    return scores.withColumn("pred", (F.col("p") > threshold).cast("int"))


def class_metrics(scores: DataFrame, group: Sequence[str] = ("model",),
                  threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall, F1 at the threshold; 0 where undefined."""
    s = predicted(scores, threshold)
    y, yh = F.col("label") == 1, F.col("pred") == 1
    agg = s.groupBy(*group).agg(
        F.count(F.when(y & yh, 1)).alias("tp"), F.count(F.when(~y & yh, 1)).alias("fp"),
        F.count(F.when(y & ~yh, 1)).alias("fn"), F.count(F.when(~y & ~yh, 1)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(
        *group,
        r6(safe_div(tp + tn, tp + fp + fn + tn, 0.0)).alias("accuracy"),
        r6(safe_div(tp, tp + fp, 0.0)).alias("precision"),
        r6(safe_div(tp, tp + fn, 0.0)).alias("recall"),
        r6(safe_div(2 * tp, 2 * tp + fp + fn, 0.0)).alias("f1"))


# E4 / E5 -------------------------------------------------------------------------
def roc_curve(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """(threshold, fpr, tpr) from the highest score down, starting at (0, 0).

    Points whose step in and step out are identical (in both counts) are
    dropped, as the usual ``drop_intermediate`` rule does. Neighbours are
    found by joining on the running index, not with a whole-model window.
    """
    group = list(group)
    counts = score_counts(scores, group).withColumn("one", F.lit(1).cast("long"))
    rc = running_totals(counts, group, "p", ["pos", "neg", "one"], descending=True)
    pts = rc.select(*group, "p", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"),
                    F.col("cum_one").alias("idx"))
    prev = pts.select(*group, (F.col("idx") + 1).alias("idx"),
                      F.col("tps").alias("tps_prev"), F.col("fps").alias("fps_prev"))
    nxt = pts.select(*group, (F.col("idx") - 1).alias("idx"),
                     F.col("tps").alias("tps_next"), F.col("fps").alias("fps_next"))
    j = pts.join(prev, [*group, "idx"], "left").join(nxt, [*group, "idx"], "left")
    bend = ((F.col("fps_next") - 2 * F.col("fps") + F.col("fps_prev") != 0)
            | (F.col("tps_next") - 2 * F.col("tps") + F.col("tps_prev") != 0))
    keep = j.where(F.col("tps_prev").isNull() | F.col("tps_next").isNull() | bend)
    tot = _totals(counts, group)
    body = keep.join(F.broadcast(tot), group).select(   # one row per model
        *group, F.col("p").alias("threshold"),
        r6(safe_div(F.col("fps"), F.col("n_neg"))).alias("fpr"),
        r6(safe_div(F.col("tps"), F.col("n_pos"))).alias("tpr"))
    origin = tot.select(*group, F.lit(float("inf")).alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return body.unionByName(origin)


def pr_curve(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the end point
    (recall 0, precision 1) with no threshold."""
    group = list(group)
    rc = ranked_counts(scores, group)
    tot = _totals(rc, group)
    body = rc.join(F.broadcast(tot), group).select(
        *group, F.col("p").alias("threshold"),
        r6(safe_div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"), 0.0)).alias("precision"),
        r6(F.when(F.col("n_pos") == 0, 1.0).otherwise(F.col("cum_pos") / F.col("n_pos")))
        .alias("recall"))
    end = tot.select(*group, F.lit(None).cast("double").alias("threshold"),
                     F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)


# E6 / E7 -------------------------------------------------------------------------
def confusion_matrix(scores: DataFrame, group: Sequence[str] = ("model",),
                     threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Counts and % of total for labels [0, 1] x predictions [0, 1]; empty cells stay."""
    group = list(group)
    s = predicted(scores, threshold)
    counts = s.groupBy(*group, F.col("label").alias("actual"), F.col("pred").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"))
                      for a in (0, 1) for b in (0, 1)])
    keys = scores.select(*group).distinct()
    grid = keys.select(*group, F.explode(cells).alias("c")).select(
        *group, "c.actual", "c.predicted")                  # 4 cells per model
    j = grid.join(counts, [*group, "actual", "predicted"], "left")
    n = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    w = Window.partitionBy(*group)                          # 4 rows per model
    return j.select(*group, "actual", "predicted", n.alias("count"),
                    r6(safe_div(n * 100.0, F.sum(n).over(w), 0.0)).alias("pct"))


def probability_histogram(scores: DataFrame, group: Sequence[str] = ("model",),
                          bins: int = PROBA_BINS) -> DataFrame:
    """Equal-width bins of p per model, split by actual class."""
    group = list(group)
    rng = scores.groupBy(*group).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    j = scores.join(F.broadcast(rng), group)
    span = F.col("hi") - F.col("lo")
    b = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("p") - F.col("lo")) / span * bins), F.lit(bins - 1))).cast("int")
    c = j.groupBy(*group, "label", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / bins
    return c.select(*group, "label", "bin", r6(F.col("lo") + F.col("bin") * width).alias("lower"),
                    r6(F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), "count")


# E8 - E12 --------------------------------------------------------------------------
def leaderboard(scores: DataFrame, sort_by: str = "roc_auc",
                group: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model with every metric, ranked by ``sort_by`` (ties by name)."""
    group = list(group)
    rm = ranking_metrics(scores, group).select(*group, r6("roc_auc").alias("roc_auc"),
                                               r6("average_precision").alias("average_precision"))
    lb = class_metrics(scores, group).join(rm, group)
    w = Window.orderBy(F.col(sort_by).desc_nulls_last(), *[F.col(g) for g in group])
    # one row per model: this global window is over a handful of rows
    return lb.withColumn("rank", F.row_number().over(w))


METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]


def metric_comparison(board: DataFrame, metric: str | None = None) -> DataFrame:
    long = board.unpivot(["model"], METRICS, "metric", "value")
    return long.where(F.col("metric") == metric) if metric else long


def base_rates(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    return scores.groupBy(*group).agg(F.avg(F.col("label").cast("double")).alias("base_rate"))


def pr_verdict(scores: DataFrame, board: DataFrame | None = None) -> DataFrame:
    """Lift = AP / base rate for the top-ranked model, and its band."""
    board = board if board is not None else leaderboard(scores)
    best = board.where(F.col("rank") == 1)
    j = best.join(base_rates(scores), "model")
    lift = safe_div(F.col("average_precision"), F.col("base_rate"), 0.0)
    ap, base = F.col("average_precision"), F.col("base_rate")
    band = F.lit(PR_TOP_BAND)
    for mult, name in reversed(PR_BANDS):
        band = F.when(ap < base * mult, name).otherwise(band)
    return j.select("model", "average_precision", r6("base_rate").alias("base_rate"),
                    r6(lift).alias("lift"), band.alias("verdict"))


def pr_expectation(board: DataFrame) -> DataFrame:
    """Expected AP band from ROC AUC, whether AP is inside it, top-decile estimate."""
    roc, ap = F.col("roc_auc"), F.col("average_precision")
    lo = F.greatest(F.lit(0.0), roc * PR_BAND_A - PR_BAND_B)
    hi = F.least(F.lit(1.0), roc * PR_BAND_C)
    return board.select(
        "model", r6(lo).alias("band_low"), r6(hi).alias("band_high"),
        F.when((lo <= ap) & (ap <= hi), "inside").otherwise("near").alias("position"),
        r6(F.least(F.lit(TOP_DECILE_CAP), ap * TOP_DECILE_D)).alias("top_decile_low"),
        r6(F.least(F.lit(TOP_DECILE_CAP), ap + TOP_DECILE_E)).alias("top_decile_high"))


def recall_guard(board: DataFrame, floor: float = RECALL_GUARD) -> DataFrame:
    return board.select("model", "recall", (F.col("recall") < floor).alias("low_recall"))
