"""Queries for evaluation (E1-E12) and targeting (F1-F7) on the scores table.

Where it gives an independent check, the oracle is the brute-force form: the
pairwise definition of ROC AUC, the rows x thresholds sweep, ``ntile``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlab.operators import evaluate as E
from reachlab.operators import target as T
from reachlab.plans import base
from reachlab.plans.oracle_base import SCORES_CTE, with_prep, with_scores
from reachlab.plans.registry import register

_COUNTS = """
, c AS (SELECT model, p, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
        FROM scores GROUP BY model, p),
rc AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
              sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
              count(*) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS idx
       FROM c),
tot AS (SELECT model, sum(pos) AS n_pos, sum(neg) AS n_neg FROM c GROUP BY model)"""

_AUC = """
, pos AS (SELECT model, p FROM scores WHERE label = 1),
neg AS (SELECT model, p FROM scores WHERE label <> 1),
pairs AS (SELECT pos.model, sum(CASE WHEN pos.p > neg.p THEN 1.0 WHEN pos.p = neg.p THEN 0.5 ELSE 0 END)
                 AS wins FROM pos JOIN neg USING (model) GROUP BY pos.model),
cnt AS (SELECT model, count(CASE WHEN label = 1 THEN 1 END) AS P, count(CASE WHEN label <> 1 THEN 1 END) AS N
        FROM scores GROUP BY model),
auc AS (SELECT cnt.model, round(CASE WHEN P * N = 0 THEN NULL ELSE coalesce(wins, 0) / (P * N) END, 6) AS roc_auc
        FROM cnt LEFT JOIN pairs USING (model))"""

_AP = _COUNTS + """,
ap AS (SELECT model, round(CASE WHEN sum(pos) = 0 THEN NULL
                              ELSE sum(pos * (cum_pos / (cum_pos + cum_neg))) / sum(pos) END, 6)
              AS average_precision FROM rc GROUP BY model)"""

_CLS = """
, cm AS (SELECT model, count(CASE WHEN label = 1 AND p > 0.5 THEN 1 END) AS tp,
                count(CASE WHEN label <> 1 AND p > 0.5 THEN 1 END) AS fp,
                count(CASE WHEN label = 1 AND NOT p > 0.5 THEN 1 END) AS fn,
                count(CASE WHEN label <> 1 AND NOT p > 0.5 THEN 1 END) AS tn
         FROM scores GROUP BY model),
cls AS (SELECT model,
          round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy,
          round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
          round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
          round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
        FROM cm)"""

_BOARD = _AUC + _AP + _CLS + """,
board AS (SELECT cls.*, auc.roc_auc, ap.average_precision,
                 CAST(row_number() OVER (ORDER BY auc.roc_auc DESC NULLS LAST, cls.model) AS INTEGER) AS rank
          FROM cls JOIN auc USING (model) JOIN ap USING (model))"""


def _scores(spark, sf_dir):
    return base.scores(spark, sf_dir)


@register("roc_auc", with_scores(_AUC) + "\nSELECT * FROM auc")
def roc_auc(spark, sf_dir):
    return E.roc_auc(_scores(spark, sf_dir))


@register("average_precision", with_scores(_AP) + "\nSELECT * FROM ap")
def average_precision(spark, sf_dir):
    return E.average_precision(_scores(spark, sf_dir))


@register("class_metrics", with_scores(_CLS) + "\nSELECT * FROM cls")
def class_metrics(spark, sf_dir):
    return E.class_metrics(_scores(spark, sf_dir))


@register("roc_curve", with_scores(_COUNTS + """,
nb AS (SELECT a.model, a.p, a.cum_pos AS tps, a.cum_neg AS fps,
              prv.cum_pos AS tps_prev, prv.cum_neg AS fps_prev, nx.cum_pos AS tps_next, nx.cum_neg AS fps_next
       FROM rc a LEFT JOIN rc prv ON prv.model = a.model AND prv.idx = a.idx - 1
                 LEFT JOIN rc nx ON nx.model = a.model AND nx.idx = a.idx + 1)
SELECT nb.model, nb.p AS threshold,
       round(CASE WHEN n_neg = 0 THEN NULL ELSE fps / n_neg END, 6) AS fpr,
       round(CASE WHEN n_pos = 0 THEN NULL ELSE tps / n_pos END, 6) AS tpr
FROM nb JOIN tot USING (model)
WHERE tps_prev IS NULL OR tps_next IS NULL
   OR fps_next - 2 * fps + fps_prev <> 0 OR tps_next - 2 * tps + tps_prev <> 0
UNION ALL
SELECT model, 'Infinity'::DOUBLE, 0.0, 0.0 FROM tot"""))
def roc_curve(spark, sf_dir):
    return E.roc_curve(_scores(spark, sf_dir))


@register("pr_curve", with_scores(_COUNTS + """
SELECT rc.model, rc.p AS threshold,
       round(CASE WHEN cum_pos + cum_neg = 0 THEN 0.0 ELSE cum_pos / (cum_pos + cum_neg) END, 6) AS precision,
       round(CASE WHEN n_pos = 0 THEN 1.0 ELSE cum_pos / n_pos END, 6) AS recall
FROM rc JOIN tot USING (model)
UNION ALL
SELECT model, NULL, 1.0, 0.0 FROM tot"""))
def pr_curve(spark, sf_dir):
    return E.pr_curve(_scores(spark, sf_dir))


@register("confusion_matrix", with_scores("""
, cells AS (SELECT DISTINCT model, a.actual, b.predicted FROM scores,
            (VALUES (0), (1)) a(actual), (VALUES (0), (1)) b(predicted)),
cnt AS (SELECT model, label AS actual, CAST(p > 0.5 AS INTEGER) AS predicted, count(*) AS count
        FROM scores GROUP BY ALL),
j AS (SELECT cells.model, cells.actual, cells.predicted, CAST(coalesce(count, 0) AS BIGINT) AS count
      FROM cells LEFT JOIN cnt USING (model, actual, predicted))
SELECT model, actual, predicted, count,
       round(CASE WHEN sum(count) OVER (PARTITION BY model) = 0 THEN 0.0
                  ELSE count * 100.0 / sum(count) OVER (PARTITION BY model) END, 6) AS pct
FROM j"""))
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_scores(spark, sf_dir))


@register("probability_histogram", with_scores("""
, rng AS (SELECT model, min(p) AS lo, max(p) AS hi FROM scores GROUP BY model),
b AS (SELECT model, label, lo, hi,
             CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((p - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin
      FROM scores JOIN rng USING (model))
SELECT model, label, bin, round(lo + bin * ((hi - lo) / 30), 6) AS lower,
       round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS upper, count(*) AS count
FROM b GROUP BY model, label, bin, lo, hi"""))
def probability_histogram(spark, sf_dir):
    return E.probability_histogram(_scores(spark, sf_dir))


@register("leaderboard", with_scores(_BOARD) + "\nSELECT * FROM board")
def leaderboard(spark, sf_dir):
    return E.leaderboard(_scores(spark, sf_dir))


@register("metric_comparison", with_scores(_BOARD + """
, long AS (UNPIVOT (SELECT model, accuracy, precision, recall, f1, roc_auc, average_precision FROM board)
           ON accuracy, precision, recall, f1, roc_auc, average_precision INTO NAME metric VALUE value)""")
          + "\nSELECT model, metric, value FROM long")
def metric_comparison(spark, sf_dir):
    return E.metric_comparison(E.leaderboard(_scores(spark, sf_dir)))


@register("pr_verdict", with_scores(_BOARD + """
, br AS (SELECT model, avg(CAST(label AS DOUBLE)) AS base_rate FROM scores GROUP BY model)
SELECT model, average_precision, round(base_rate, 6) AS base_rate,
       round(CASE WHEN base_rate = 0 THEN 0.0 ELSE average_precision / base_rate END, 6) AS lift,
       CASE WHEN average_precision < base_rate * 1.5 THEN 'near_random'
            WHEN average_precision < base_rate * 2.5 THEN 'modest'
            WHEN average_precision < base_rate * 4.0 THEN 'solid' ELSE 'excellent' END AS verdict
FROM board JOIN br USING (model) WHERE rank = 1"""))
def pr_verdict(spark, sf_dir):
    return E.pr_verdict(_scores(spark, sf_dir))


@register("pr_expectation", with_scores(_BOARD + """
SELECT model, round(greatest(0.0, roc_auc * 0.7 - 0.05), 6) AS band_low,
       round(least(1.0, roc_auc * 0.85), 6) AS band_high,
       CASE WHEN greatest(0.0, roc_auc * 0.7 - 0.05) <= average_precision
             AND average_precision <= least(1.0, roc_auc * 0.85) THEN 'inside' ELSE 'near' END AS position,
       round(least(0.95, average_precision * 0.85), 6) AS top_decile_low,
       round(least(0.95, average_precision + 0.1), 6) AS top_decile_high
FROM board"""))
def pr_expectation(spark, sf_dir):
    return E.pr_expectation(E.leaderboard(_scores(spark, sf_dir)))


@register("recall_guard", with_scores(_CLS + "\nSELECT model, recall, recall < 0.3 AS low_recall FROM cls"))
def recall_guard(spark, sf_dir):
    return E.recall_guard(E.class_metrics(_scores(spark, sf_dir)))


# F ----------------------------------------------------------------------------------
_SWEEP = """
, grid AS (SELECT CAST(i AS INTEGER) AS i, (5 + i) / 100.0 AS t FROM range(91) r(i)),
models AS (SELECT DISTINCT model FROM scores),
sw AS (
  SELECT m.model, g.i AS step, round(g.t, 6) AS threshold,
         CAST(count(CASE WHEN s.p >= g.t AND s.label = 1 THEN 1 END) AS BIGINT) AS tp,
         CAST(count(CASE WHEN s.p >= g.t AND s.label <> 1 THEN 1 END) AS BIGINT) AS fp,
         CAST(count(CASE WHEN NOT s.p >= g.t AND s.label = 1 THEN 1 END) AS BIGINT) AS fn
  FROM models m CROSS JOIN grid g JOIN scores s ON s.model = m.model
  GROUP BY m.model, g.i, g.t),
sweep AS (SELECT model, step, threshold, tp, fp, fn,
                 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
                 round(tp * 50.0 - fp * 1.0, 6) AS profit
          FROM sw)"""


@register("threshold_sweep", with_scores(_SWEEP + "\nSELECT * FROM sweep"))
def threshold_sweep(spark, sf_dir):
    return T.threshold_sweep(_scores(spark, sf_dir))


@register("best_thresholds", with_scores(_SWEEP + """
SELECT model, arg_max(threshold, (f1, -step)) AS best_f1_threshold, max(f1) AS best_f1,
       arg_max(threshold, (profit, -step)) AS best_profit_threshold, max(profit) AS best_profit
FROM sweep GROUP BY model"""))
def best_thresholds(spark, sf_dir):
    return T.best_thresholds(T.threshold_sweep(_scores(spark, sf_dir)))


@register("campaign_outcome", with_scores("""
, a AS (SELECT model, count(*) AS n,
               count(CASE WHEN p >= 0.5 AND label = 1 THEN 1 END) AS tp,
               count(CASE WHEN p >= 0.5 AND label <> 1 THEN 1 END) AS fp,
               count(CASE WHEN NOT p >= 0.5 AND label = 1 THEN 1 END) AS fn,
               avg(CAST(label AS DOUBLE)) AS base
        FROM scores GROUP BY model),
b AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS prec FROM a)
SELECT model, tp + fp AS contacted,
       round(CASE WHEN n = 0 THEN 0.0 ELSE (tp + fp) * 100.0 / n END, 6) AS contacted_pct,
       tp, fp, fn, round(prec, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(base, 6) AS base_rate,
       round(CASE WHEN base = 0 OR base IS NULL THEN 0.0 ELSE prec / base END, 6) AS lift,
       round(tp * 50.0 - fp * 1.0, 6) AS net_profit
FROM b"""))
def campaign_outcome(spark, sf_dir):
    return T.campaign_outcome(_scores(spark, sf_dir))


@register("tier_plan", with_prep("", "," + SCORES_CTE) + """
, t AS (SELECT s.model, CASE WHEN s.p >= 0.7 THEN 'A' WHEN s.p >= 0.3 THEN 'B' ELSE 'C' END AS tier,
               s.label, CAST(pr.TotalSpend AS DOUBLE) AS spend
        FROM scores s LEFT JOIN prepared pr ON pr.ID = s.id)
SELECT model, tier, count(*) AS customers, CAST(sum(label) AS BIGINT) AS responders,
       round(sum(label) / count(*), 6) AS response_rate, round(avg(spend), 6) AS avg_spend
FROM t GROUP BY model, tier""")
def tier_plan(spark, sf_dir):
    spend = base.prepared(spark, sf_dir).select(F.col("ID").alias("id"), "TotalSpend")
    return T.tier_plan(_scores(spark, sf_dir), spend)


@register("decile_lift", with_scores("""
, r AS (SELECT model, label, ntile(10) OVER (PARTITION BY model ORDER BY p DESC, id) AS d,
               row_number() OVER (PARTITION BY model ORDER BY p DESC, id) AS rn,
               count(*) OVER (PARTITION BY model) AS n,
               avg(CAST(label AS DOUBLE)) OVER (PARTITION BY model) AS base
        FROM scores),
e AS (SELECT model, label, base, 'decile_' || lpad(CAST(d AS VARCHAR), 2, '0') AS segment FROM r
      UNION ALL
      SELECT model, label, base, 'top_1pct' FROM r WHERE rn <= ceil(n / 100.0))
SELECT model, segment, count(*) AS customers, CAST(sum(label) AS BIGINT) AS responders,
       round(sum(label) / count(*), 6) AS response_rate,
       round(CASE WHEN any_value(base) = 0 THEN 0.0 ELSE (sum(label) / count(*)) / any_value(base) END, 6) AS lift
FROM e GROUP BY model, segment"""))
def decile_lift(spark, sf_dir):
    return T.decile_lift(_scores(spark, sf_dir))


@register("control_group", with_scores("""
, t AS (SELECT model, label,
               CASE WHEN CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT)
                         / 4294967296.0 < 0.1 THEN 'control' ELSE 'treated' END AS arm
        FROM scores WHERE p >= 0.5),
a AS (SELECT model, count(CASE WHEN arm = 'treated' THEN 1 END) AS treated,
             avg(CASE WHEN arm = 'treated' THEN CAST(label AS DOUBLE) END) AS tr,
             count(CASE WHEN arm = 'control' THEN 1 END) AS control,
             avg(CASE WHEN arm = 'control' THEN CAST(label AS DOUBLE) END) AS cr
      FROM t GROUP BY model)
SELECT model, treated, round(tr, 6) AS treated_rate, control, round(cr, 6) AS control_rate,
       round(tr - cr, 6) AS uplift FROM a"""))
def control_group(spark, sf_dir):
    return T.control_group(_scores(spark, sf_dir))
