"""Deterministic tables derived from the customer table (FIXTURES.md).

``scores`` stands in for a fitted model's test-set output so that every
evaluation and targeting operator gets an exact SQL oracle: the probability is
an integer hash of the customer id shifted by the label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlab.functions.columns import r6
from reachlab.operators.evaluate import ranking_metrics
from reachlab.operators.runs import BASELINE_JOB, SEARCH_JOB, _map, fmt
from reachlab.operators.tune import SEED, _unit

# --- fixed values of the scores fixture (FIXTURES.md section 3) ---------------
# model name, id multiplier, modulus, label shift, divisor
SCORE_MODELS = [
    ("hash_a", 7919, 1000, 300, 1300.0),
    ("hash_b", 104729, 100, 10, 110.0),
]
# Linear attribution fixtures (FIXTURES.md section 4): per model, weights over
# raw columns, intercept and the space the contributions live in.
ATTRIBUTION_MODELS = {
    "linear_a": ({"Recency": -0.02, "Income": 0.00001, "MntWines": 0.001,
                  "NumWebPurchases": 0.05, "AcceptedCmp5": 1.0}, -1.7, "log_odds"),
    "linear_b": ({"Teenhome": 0.02, "Kidhome": -0.03, "NumStorePurchases": 0.004,
                  "AcceptedCmp1": 0.1, "Recency": -0.001}, 0.15, "probability"),
}
# -------------------------------------------------------------------------------


def scores_table(raw: DataFrame) -> DataFrame:
    """``scores(model, id, label, p)``: one row per (model, customer)."""
    base = raw.select(F.col("ID").alias("id"), F.col("Response").cast("int").alias("label"))
    per_model = F.array(*[
        F.struct(F.lit(name).alias("model"),
                 ((F.pmod(F.col("id") * mult, F.lit(mod)) + shift * F.col("label"))
                  / F.lit(div)).cast("double").alias("p"))
        for name, mult, mod, shift, div in SCORE_MODELS])
    return (base.select("id", "label", F.explode(per_model).alias("m"))
                .select("m.model", "id", "label", "m.p"))


def attributions_table(raw: DataFrame) -> DataFrame:
    """``attributions(model, id, feature, value, contribution, base_value, space)``
    from fixed linear scores over the customer table (exact linear SHAP)."""
    from reachlab.operators.explain import linear_attributions

    rows = raw.withColumnRenamed("ID", "id")
    parts = [linear_attributions(rows, name, w, intercept=b, space=space)
             for name, (w, b, space) in ATTRIBUTION_MODELS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- linear scoring rules: SQL-checkable trials for H4-H6 and I1-I5 --------------------------
# fixed values of the rule family: weighted raw columns, one spend column chosen
# per trial, and a recency weight that only exists when use_recency = 'yes'
RULE_BASE_FEATURES = ["Income", "NumWebPurchases", "AcceptedCmp5", "Teenhome"]
RULE_SPEND_CHOICES = ["MntWines", "MntMeatProducts", "MntGoldProds"]
RULE_TRIALS = 120
TASKS_PER_SLOT = 4
RULE_SCALE = {"Income": 0.00001, "NumWebPurchases": 0.1, "AcceptedCmp5": 1.0, "Teenhome": 0.5,
              "spend": 0.001, "Recency": 0.02}


def rule_trials(n_trials: int = RULE_TRIALS, seed: int = SEED) -> list[dict]:
    """Draws of the rule family, one dict per trial (bounded by n_trials).

    Weight w = 2u - 1 with u from md5(seed|rule|trial|name): a multiple of
    2^-31, exactly representable, so every engine scores identically.
    """
    out = []
    for t in range(n_trials):
        d = {"trial": t}
        for f in RULE_BASE_FEATURES:
            d[f"w_{f}"] = 2 * _unit(seed, "rule", t, f"w_{f}") - 1
        d["w_spend"] = 2 * _unit(seed, "rule", t, "w_spend") - 1
        d["spend_feature"] = RULE_SPEND_CHOICES[
            int(math.floor(_unit(seed, "rule", t, "spend_feature") * len(RULE_SPEND_CHOICES)))]
        d["use_recency"] = "yes" if _unit(seed, "rule", t, "use_recency") < 0.5 else "no"
        d["w_Recency"] = (2 * _unit(seed, "rule", t, "w_Recency") - 1
                          if d["use_recency"] == "yes" else None)
        out.append(d)
    return out


def rule_params(spark: SparkSession, trials: list[dict]) -> DataFrame:
    """(trial, params map<string,string>) with absent parameters left out."""
    rows = [(d["trial"], {k: (v if isinstance(v, str) else f"{float(v):.6f}")
                          for k, v in d.items() if k != "trial" and v is not None})
            for d in trials]
    return spark.createDataFrame(rows, "trial long, params map<string,string>")


def rule_scores(customers: DataFrame, trials: list[dict], target: str = "Response") -> DataFrame:
    """(trial, id, label, p): every trial's rule applied to every customer.

    Each customer row is expanded to one row per trial with ``explode`` of a
    literal array (the trial count is a parameter, not data) and the scored
    rows are immediately reduced to one row per (trial, distinct score), so
    all trials share one grouped ranking pass.
    """
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in
         RULE_BASE_FEATURES + RULE_SPEND_CHOICES + ["Recency"]}
    spend_idx = {c: i for i, c in enumerate(RULE_SPEND_CHOICES)}
    lit_trials = F.array(*[F.struct(
        F.lit(d["trial"]).cast("long").alias("trial"),
        *[F.lit(d[f"w_{f}"]).alias(f"w_{f}") for f in RULE_BASE_FEATURES],
        F.lit(d["w_spend"]).alias("w_spend"),
        F.lit(spend_idx[d["spend_feature"]]).alias("spend_i"),
        F.lit(d["w_Recency"] or 0.0).alias("w_Recency")) for d in trials])
    rows = customers.select(F.col("ID").alias("id"), F.col(target).alias("label"),
                            *[x[c].alias(c) for c in x])
    # the customers may come out of few partitions; spread them before they are copied
    rows = rows.repartition(TASKS_PER_SLOT * customers.sparkSession.sparkContext.defaultParallelism, "id")
    e = rows.select("id", "label", *x, F.explode(lit_trials).alias("t"))
    spend = F.coalesce(*[F.when(F.col("t.spend_i") == i, F.col(c)) for c, i in spend_idx.items()])
    z = F.lit(0.0)
    for f in RULE_BASE_FEATURES:
        z = z + F.col(f"t.w_{f}") * F.lit(RULE_SCALE[f]) * F.col(f)
    z = z + F.col("t.w_spend") * F.lit(RULE_SCALE["spend"]) * spend
    z = z + F.col("t.w_Recency") * F.lit(RULE_SCALE["Recency"]) * F.col("Recency")
    return e.select(F.col("t.trial").alias("trial"), "id", "label", z.alias("p"))


def rule_search(customers: DataFrame, n_trials: int = RULE_TRIALS, seed: int = SEED,
                target: str = "Response", with_metrics: bool = False) -> DataFrame:
    """H2 over the rule family: average precision of every trial on the whole
    table -> trials (trial, score, params). ``with_metrics`` adds ap, auc and
    the row count per trial (used to derive run records)."""
    spark = customers.sparkSession
    trials = rule_trials(n_trials, seed)
    scored = rule_scores(customers, trials, target)
    m = ranking_metrics(scored, group=("trial",))           # one ranking pass, eager
    out = m.join(F.broadcast(rule_params(spark, trials)), "trial")   # n_trials rows
    if with_metrics:
        return out.select(F.col("trial").cast("long"), r6("average_precision").alias("ap"),
                          r6("roc_auc").alias("auc"), (F.col("n_pos") + F.col("n_neg")).alias("n"),
                          "params")
    return out.select(F.col("trial").cast("long"), r6("average_precision").alias("score"), "params")



# --- run records of those trials, in the states that a tracker shows ------------------------
def runs_from_search(trials: DataFrame, base_time: str = "2026-01-01 00:00:00") -> DataFrame:
    """One run per search trial. ``trials`` has trial, ap, auc, n and the
    parameter map. Every sixth run is an older one that only logged
    final/best_cv_roc_auc; every ninth (offset 4) is still running and has no
    final test metrics."""
    t = F.col("trial")
    older = (t % 6) == 0
    running = (t % 9) == 4
    state = F.when(running, "running").otherwise("finished")
    summary = _map([
        ("final/best_cv_score", F.when(~older, fmt(F.col("ap")))),
        ("final/scoring_metric", F.when(~older, F.lit("average_precision"))),
        ("final/best_cv_roc_auc", F.when(older, fmt(F.col("auc")))),
        ("final/test_roc_auc", F.when(~running, fmt(F.col("auc")))),
        ("final/test_pr_auc", F.when(~running, fmt(F.col("ap")))),
        ("test/n_customers", F.col("n").cast("string")),
        ("note", F.lit("rule search")),
    ])
    config = F.map_concat(F.col("params"), F.create_map(
        F.lit("_tracker"), F.lit("internal"), F.lit("dataset"), F.lit("marketing"),
        F.lit("model"), F.lit("rule")))
    return trials.select(
        F.concat(F.lit("rule-"), F.lpad(t.cast("string"), 4, "0")).alias("id"),
        F.concat(F.lit("marketing-Réponse · trial "), t.cast("string"), F.lit(" 🎯")).alias("name"),
        F.lit("rule").alias("model"), F.lit(SEARCH_JOB).alias("job_type"),
        (F.to_timestamp_ntz(F.lit(base_time)) + F.make_dt_interval(mins=(t * 37).cast("int"))).alias("created_at"),
        state.alias("state"), summary.alias("summary"), config.alias("config"))


def runs_from_board(board: DataFrame, base_time: str = "2025-12-31 12:00:00") -> DataFrame:
    """One baseline run per model of a leaderboard."""
    r = F.col("rank")
    summary = _map([("test/roc_auc", fmt(F.col("roc_auc"))),
                    ("test/pr_auc", fmt(F.col("average_precision"))),
                    ("test/f1", fmt(F.col("f1")))])
    return board.select(
        F.concat(F.lit("base-"), F.col("model")).alias("id"),
        F.concat(F.lit("marketing-"), F.col("model")).alias("name"),
        F.col("model"), F.lit(BASELINE_JOB).alias("job_type"),
        (F.to_timestamp_ntz(F.lit(base_time)) + F.make_dt_interval(hours=r.cast("int"))).alias("created_at"),
        F.lit("finished").alias("state"), summary.alias("summary"),
        F.create_map(F.lit("model"), F.col("model")).alias("config"))


def tracked_runs(runs: DataFrame) -> DataFrame:
    """Run rows as a tracker's records: JSON documents that hold nested values too."""
    def document(column: str) -> Column:
        return F.concat(F.lit('{"_step": 12, "_done": true, "_bins": {"n": [1, 2]}, "tags": ["a", "b"], "nothing": null, '),
                        F.substring(F.to_json(column), F.lit(2), F.length(F.to_json(column))))
    return runs.select("id", "name", F.nullif("job_type", F.lit(BASELINE_JOB)).alias("job_type"), "created_at", "state",
                       document("summary").alias("summary"), document("config").alias("config"),
                       F.concat(F.lit("tracker/runs/"), "id").alias("url"))
