"""Campaign targeting (F1-F7) over ``scores(model, id, label, p)``.

The threshold sweep never forms rows x thresholds: each row is bucketed once
into "how many grid thresholds are <= p" (exact comparisons around
``floor(100 p)``), rows are counted per (model, bucket) -- at most 92 rows per
model leave the map side -- and the per-threshold counts are suffix sums over
that tiny table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlab.functions.columns import hash_unit, r6, safe_div
from reachlab.functions.ordered import rank_within

# --- fixed values of the reference's targeting widget ---------------------------
SWEEP_POINTS = 91            # thresholds (5 + i) / 100 for i in 0..90
VALUE_PER_RESPONDER = 50.0
COST_PER_CONTACT = 1.0
DEFAULT_THRESHOLD = 0.5
TIER_A = 0.7
TIER_B = 0.3
CONTROL_FRACTION = 0.1
CONTROL_SEED = 42
# ----------------------------------------------------------------------------------


def sweep_threshold(i: Column | int) -> Column:
    """Grid threshold i, written as (5 + i) / 100 so both engines agree on ties."""
    i = F.lit(i) if isinstance(i, int) else i
    return (F.lit(5) + i).cast("double") / F.lit(100.0)


def thresholds_at_or_below(p: Column) -> Column:
    """Number of grid thresholds t_i with t_i <= p (0..91), exactly.

    floor(100 p) is within one of the true index; the three candidate grid
    points around it are compared directly.
    """
    m = F.floor(p * 100).cast("int")
    sure = F.greatest(F.lit(0), F.least(F.lit(SWEEP_POINTS), m - 6))   # t <= (m-2)/100
    extra = None
    for d in (-1, 0, 1):
        j = m + d                                            # candidate numerator
        hit = ((j >= 5) & (j <= 95) & ((j.cast("double") / F.lit(100.0)) <= p)).cast("int")
        extra = hit if extra is None else extra + hit
    return F.least(F.lit(SWEEP_POINTS), sure + extra)


def threshold_sweep(scores: DataFrame, group: Sequence[str] = ("model",),
                    value: float = VALUE_PER_RESPONDER, cost: float = COST_PER_CONTACT) -> DataFrame:
    """F1 + F2: for each grid threshold, TP / FP / FN, F1 and profit."""
    group = list(group)
    k = thresholds_at_or_below(F.col("p"))
    y = F.col("label") == 1
    per_k = scores.groupBy(*group, k.alias("k")).agg(
        F.count(F.when(y, 1)).alias("pos"), F.count(F.when(~y, 1)).alias("neg"))
    models = per_k.select(*group).distinct()
    cells = models.select(*group, F.explode(F.sequence(F.lit(0), F.lit(SWEEP_POINTS - 1)))
                          .alias("i"))                       # 91 rows per model
    # row with bucket k is contacted at threshold i iff t_i <= p iff i < k
    j = cells.join(per_k, group).where(F.col("k") > F.col("i"))
    agg = j.groupBy(*group, "i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    tot = per_k.groupBy(*group).agg(F.sum("pos").alias("n_pos"))
    full = cells.join(agg, [*group, "i"], "left").join(F.broadcast(tot), group)
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("long")
    fp = F.coalesce(F.col("fp"), F.lit(0)).cast("long")
    fn = F.col("n_pos").cast("long") - tp
    return full.select(
        *group, F.col("i").alias("step"), r6(sweep_threshold(F.col("i"))).alias("threshold"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        r6(safe_div(2 * tp, 2 * tp + fp + fn, 0.0)).alias("f1"),
        r6(tp * value - fp * cost).alias("profit"))


def best_thresholds(sweep: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """first (lowest) threshold reaching the maximum F1, and the maximum profit."""
    group = list(group)
    f1 = sweep.groupBy(*group).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("step"))).alias("best_f1_threshold"),
        F.max("f1").alias("best_f1"),
        F.max_by("threshold", F.struct(F.col("profit"), -F.col("step"))).alias("best_profit_threshold"),
        F.max("profit").alias("best_profit"))
    return f1


def campaign_outcome(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                     group: Sequence[str] = ("model",), value: float = VALUE_PER_RESPONDER,
                     cost: float = COST_PER_CONTACT) -> DataFrame:
    """contacted n and %, TP, FP, FN, precision, recall, base rate, lift, profit."""
    group = list(group)
    c = F.col("p") >= F.lit(threshold)
    y = F.col("label") == 1
    agg = scores.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(c & y, 1)).alias("tp"),
        F.count(F.when(c & ~y, 1)).alias("fp"), F.count(F.when(~c & y, 1)).alias("fn"),
        F.avg(F.col("label").cast("double")).alias("base"))
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    prec = safe_div(tp, tp + fp, 0.0)
    return agg.select(
        *group, (tp + fp).alias("contacted"), r6(safe_div((tp + fp) * 100.0, n, 0.0)).alias("contacted_pct"),
        "tp", "fp", "fn", r6(prec).alias("precision"),
        r6(safe_div(tp, tp + fn, 0.0)).alias("recall"), r6("base").alias("base_rate"),
        r6(safe_div(prec, F.col("base"), 0.0)).alias("lift"),
        r6(tp * value - fp * cost).alias("net_profit"))


def tier_of(p: Column) -> Column:
    return F.when(p >= TIER_A, "A").when(p >= TIER_B, "B").otherwise("C")


def tier_plan(scores: DataFrame, customers: DataFrame | None = None,
              group: Sequence[str] = ("model",)) -> DataFrame:
    """customers, responders, response rate and mean spend per tier.

    ``customers`` (id, TotalSpend) is joined on id: one row per customer on
    both sides, so the join is a plain shuffle join without skew.
    """
    group = list(group)
    s = scores.withColumn("tier", tier_of(F.col("p")))
    if customers is not None:
        s = s.join(customers, "id", "left")
        spend = F.avg(F.col("TotalSpend").cast("double"))
    else:
        spend = F.lit(None).cast("double")
    agg = s.groupBy(*group, "tier").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("label").cast("long").alias("responders"),
        spend.alias("spend"))
    return agg.select(*group, "tier", "customers", "responders",
                      r6(F.col("responders") / F.col("customers")).alias("response_rate"),
                      r6("spend").alias("avg_spend"))


def rank_rows(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Row number by p descending, then id ascending, within each model."""
    return rank_within(scores, group, "p", "id", descending=True)


def decile_lift(scores: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """response and lift per decile (ntile(10) by p desc, id) and for the top 1 %."""
    group = list(group)
    ranked = rank_rows(scores, group)
    n = scores.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                   F.avg(F.col("label").cast("double")).alias("base"))
    j = ranked.join(F.broadcast(n), group)                   # one row per model
    r, nn = F.col("row_rank"), F.col("n")
    q = F.floor(nn / 10)
    rem = nn - q * 10
    big = rem * (q + 1)
    decile = F.when(r <= big, F.ceil(r / (q + 1))).otherwise(rem + F.ceil((r - big) / q))
    top1 = r <= F.ceil(nn / 100.0)
    seg = F.array(F.concat(F.lit("decile_"), F.lpad(decile.cast("int").cast("string"), 2, "0")),
                  F.when(top1, F.lit("top_1pct")))
    e = j.select(*group, "label", "base", F.explode(seg).alias("segment")).where(
        F.col("segment").isNotNull())
    agg = e.groupBy(*group, "segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("label").cast("long").alias("responders"),
        F.first("base").alias("base"))
    rate = F.col("responders") / F.col("customers")
    return agg.select(*group, "segment", "customers", "responders", r6(rate).alias("response_rate"),
                      r6(safe_div(rate, F.col("base"), 0.0)).alias("lift"))


def control_group(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  fraction: float = CONTROL_FRACTION, seed: int = CONTROL_SEED,
                  group: Sequence[str] = ("model",)) -> DataFrame:
    """hold out a hash-chosen random share of the targeted customers and
    compare their response with the treated ones (no shuffle to split)."""
    group = list(group)
    t = scores.where(F.col("p") >= F.lit(threshold)).withColumn(
        "arm", F.when(hash_unit(seed, "id") < fraction, "control").otherwise("treated"))
    agg = t.groupBy(*group).agg(
        F.count(F.when(F.col("arm") == "treated", 1)).alias("treated"),
        F.avg(F.when(F.col("arm") == "treated", F.col("label").cast("double"))).alias("tr"),
        F.count(F.when(F.col("arm") == "control", 1)).alias("control"),
        F.avg(F.when(F.col("arm") == "control", F.col("label").cast("double"))).alias("cr"))
    return agg.select(*group, "treated", r6("tr").alias("treated_rate"), "control",
                      r6("cr").alias("control_rate"), r6(F.col("tr") - F.col("cr")).alias("uplift"))

