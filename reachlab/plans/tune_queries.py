"""Queries for tuning (H1-H6) and the experiment log.

The trial views and the run log are SQL-checked on the rule search, whose
trials are scored over the whole customer table; ``tune_model`` (MLlib search
with k-fold CV) is rows-only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from reachlab.operators import evaluate as E
from reachlab.operators import runs as R
from reachlab.operators import tune as T
from reachlab.operators.catalog import feature_list_names
from reachlab.operators.split import cv_folds
from reachlab.plans import base
from reachlab.plans.oracle_base import SCORES_CTE, with_raw
from reachlab.plans.registry import register
from reachlab.session import ensure_checkpoint_dir
from reachlab.sources import fixtures as X
from reachlab.sources import run_log as run_log_files


def _lit(w: float) -> str:
    return f"CAST({w!r} AS DOUBLE)"


def _u(name: str) -> str:
    return (f"(CAST(('0x' || substr(md5('42|rule|' || CAST(t AS VARCHAR) || '|{name}'), 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")


_NUM_PARAMS = [f"w_{f}" for f in X.RULE_BASE_FEATURES] + ["w_spend", "w_Recency"]
_CAT_PARAMS = ["spend_feature", "use_recency"]
_X = X.RULE_BASE_FEATURES + X.RULE_SPEND_CHOICES + ["Recency"]
_spend_case = "CASE spend_i " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(X.RULE_SPEND_CHOICES)) + " END"
_z = "0.0" + "".join(f" + w_{f} * {_lit(X.RULE_SCALE[f])} * {f}" for f in X.RULE_BASE_FEATURES) \
    + f" + w_spend * {_lit(X.RULE_SCALE['spend'])} * ({_spend_case})" \
    + f" + w_Recency0 * {_lit(X.RULE_SCALE['Recency'])} * Recency"

RULE = f"""
, cust AS (SELECT ID AS id, Response AS label,
                  {", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _X)} FROM campaign_raw),
tr0 AS (SELECT CAST(t AS BIGINT) AS trial,
               {", ".join(f"2 * {_u('w_' + f)} - 1 AS w_{f}" for f in X.RULE_BASE_FEATURES)},
               2 * {_u('w_spend')} - 1 AS w_spend,
               CAST(floor({_u('spend_feature')} * {len(X.RULE_SPEND_CHOICES)}) AS INTEGER) AS spend_i,
               CASE WHEN {_u('use_recency')} < 0.5 THEN 'yes' ELSE 'no' END AS use_recency,
               2 * {_u('w_Recency')} - 1 AS w_rec_raw
        FROM range({X.RULE_TRIALS}) r(t)),
tr AS (SELECT *, CASE WHEN use_recency = 'yes' THEN w_rec_raw END AS w_Recency,
              CASE WHEN use_recency = 'yes' THEN w_rec_raw ELSE 0.0 END AS w_Recency0,
              [{", ".join(f"'{c}'" for c in X.RULE_SPEND_CHOICES)}][spend_i + 1] AS spend_feature
       FROM tr0),
scored AS (SELECT trial, id, label, {_z} AS p FROM cust, tr),
rc AS (SELECT trial, p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY trial, p),
rcum AS (SELECT *, sum(pos) OVER (PARTITION BY trial ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cp,
                sum(neg) OVER (PARTITION BY trial ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn FROM rc),
metrics AS (SELECT trial,
                   round(CASE WHEN sum(pos) = 0 THEN NULL ELSE sum(pos * (cp / (cp + cn))) / sum(pos) END, 6) AS ap,
                   round(CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL
                              ELSE sum(neg * (cp - pos + 0.5 * pos)) / (sum(pos) * sum(neg)) END, 6) AS auc,
                   sum(pos + neg) AS n
            FROM rcum GROUP BY trial),
trials AS (SELECT m.trial, m.ap AS score, m.ap, m.auc, m.n,
                  {", ".join(f"round(CAST(printf('%.6f', tr.{p}) AS DOUBLE), 6) AS {p}" for p in _NUM_PARAMS)},
                  tr.spend_feature, tr.use_recency
           FROM metrics m JOIN tr USING (trial))"""


def _rule(spark, sf_dir, with_metrics=False):
    """The rule search's trials, computed once per data directory (one row
    per trial, persisted) and shared by every trial and run view."""
    full = base.memo(spark, sf_dir, "rule_trials",
                     lambda: X.rule_search(base.raw(spark, sf_dir), with_metrics=True))
    if with_metrics:
        return full
    return full.select("trial", F.col("ap").alias("score"), "params")


def _flat(trials):
    return trials.select("trial", "score", *[F.round(F.col("params")[p].cast("double"), 6).alias(p)
                                             for p in _NUM_PARAMS],
                         *[F.col("params")[p].alias(p) for p in _CAT_PARAMS])


@register("rule_search", with_raw(RULE + f"""
SELECT trial, score, {", ".join(_NUM_PARAMS + _CAT_PARAMS)} FROM trials"""))
def rule_search(spark, sf_dir):
    return _flat(_rule(spark, sf_dir))


@register("trial_log", with_raw(RULE + f"""
SELECT trial, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, trial) AS INTEGER) AS rank,
       {", ".join(_NUM_PARAMS + _CAT_PARAMS)} FROM trials"""))
def trial_log(spark, sf_dir):
    t = _rule(spark, sf_dir)
    log = T.trial_log(t, _NUM_PARAMS + _CAT_PARAMS)
    return log.select("trial", "score", "rank",
                      *[F.round(F.col(p).cast("double"), 6).alias(p) for p in _NUM_PARAMS], *_CAT_PARAMS)


@register("best_so_far", with_raw(RULE + """
SELECT trial, score, CASE WHEN score IS NULL THEN NULL
                          ELSE max(score) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) END AS best_so_far
FROM trials"""))
def best_so_far(spark, sf_dir):
    return T.best_so_far(_rule(spark, sf_dir))


_PC_DIMS = " UNION ALL ".join(
    [f"SELECT trial, 'score' AS dimension, score AS num, NULL AS cat FROM trials"]
    + [f"SELECT trial, '{p}', {p}, NULL FROM trials" for p in _NUM_PARAMS]
    + [f"SELECT trial, '{p}', NULL, coalesce({p}, 'nan') FROM trials" for p in _CAT_PARAMS])


@register("parallel_coords", with_raw(RULE + f"""
, long AS ({_PC_DIMS}),
firsts AS (SELECT dimension, cat, min(trial) AS first_trial FROM long WHERE cat IS NOT NULL GROUP BY 1, 2),
codes AS (SELECT dimension, cat, dense_rank() OVER (PARTITION BY dimension ORDER BY first_trial) - 1 AS code
          FROM firsts),
j AS (SELECT l.trial, l.dimension, CASE WHEN l.cat IS NOT NULL THEN CAST(c.code AS DOUBLE) ELSE l.num END AS v,
             l.cat AS label
      FROM long l LEFT JOIN codes c ON c.dimension = l.dimension AND c.cat = l.cat)
SELECT trial, dimension, round(v, 6) AS value, label,
       round(min(v) OVER (PARTITION BY dimension), 6) AS dim_min,
       round(max(v) OVER (PARTITION BY dimension), 6) AS dim_max
FROM j"""))
def parallel_coords(spark, sf_dir):
    t = _rule(spark, sf_dir)
    return T.parallel_coords(t, _NUM_PARAMS, _CAT_PARAMS)


def _tuned(spark, sf_dir, model, scoring="average_precision", n_trials=T.DEFAULT_TRIALS):
    """One study per (data, model, objective): trials and the refit's test scores."""
    key = base.state_key(spark, sf_dir, f"study:{model}:{scoring}:{n_trials}")
    if key not in _STUDIES:
        sp = base.split(spark, sf_dir)
        folds = cv_folds(sp.where(F.col("split") == "train"))
        trials, _best, scored = T.tune_model(folds, sp.where(F.col("split") == "test"),
                                             feature_list_names(sp, "label"), model, n_trials, scoring=scoring)
        _STUDIES[key] = (trials, scored)
    return _STUDIES[key]


_STUDIES: dict[tuple, tuple] = {}
# The studies that queries run: the model and what its trials are scored by.
STUDIES = [("tree", "average_precision"), ("logistic", "roc_auc")]


@register("tune_model")
def tune_model(spark, sf_dir):
    """H1-H2: seeded random search for the decision tree, 5-fold CV on average
    precision; the trials with their drawn parameters."""
    return _tuned(spark, sf_dir, "tree")[0].select("trial", "score", F.to_json("params").alias("params"))


@register("tune_model_roc")
def tune_model_roc(spark, sf_dir):
    """H2 with the other objective, ROC AUC, for logistic regression."""
    return _tuned(spark, sf_dir, "logistic", "roc_auc")[0].select("trial", "score", F.to_json("params").alias("params"))


@register("tuned_test_metrics")
def tuned_test_metrics(spark, sf_dir):
    """H3: test metrics of the best trial, refitted on the whole training split."""
    from reachlab.operators import evaluate as E
    return E.leaderboard(_tuned(spark, sf_dir, "tree")[1])


@register("search_space")
def search_space(spark, sf_dir):
    """H1: the drawn parameters of the studies run on the data, one row per trial and
    parameter, with the trial's score and its rank in the study."""
    parts = []
    for model, scoring in STUDIES:
        w = Window.orderBy(F.col("score").desc_nulls_last(), "trial")  # #trials rows
        scored = _tuned(spark, sf_dir, model, scoring)[0].select(
            F.lit(model).alias("model"), F.lit(scoring).alias("objective"), "trial", "score", F.row_number().over(w).alias("rank"))
        parts.append(T.search_space(spark, model).join(scored, ["model", "trial"]))
    return parts[0].unionByName(parts[1])


# I1 - I5 ----------------------------------------------------------------------------
_BOARD_SQL = """
, sc_counts AS (SELECT model, p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                       sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scores GROUP BY model, p),
sc_cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cp,
                  sum(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn
           FROM sc_counts),
sc_rank AS (SELECT model, round(sum(neg * (cp - pos + 0.5 * pos)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
                   round(sum(pos * (cp / (cp + cn))) / sum(pos), 6) AS average_precision
            FROM sc_cum GROUP BY model),
sc_cls AS (SELECT model, count(CASE WHEN label = 1 AND p > 0.5 THEN 1 END) AS tp,
                  count(CASE WHEN label <> 1 AND p > 0.5 THEN 1 END) AS fp,
                  count(CASE WHEN label = 1 AND NOT p > 0.5 THEN 1 END) AS fn FROM scores GROUP BY model),
board AS (SELECT model, roc_auc, average_precision,
                 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
                 row_number() OVER (ORDER BY roc_auc DESC, model) AS rank
          FROM sc_rank JOIN sc_cls USING (model))"""

_RUNS = RULE + ",\n" + SCORES_CTE + _BOARD_SQL + """,
runs AS (
  SELECT 'rule-' || lpad(CAST(trial AS VARCHAR), 4, '0') AS id,
         'marketing-Réponse · trial ' || CAST(trial AS VARCHAR) || ' 🎯' AS name, 'rule' AS model,
         'hparam-search' AS job_type,
         TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(trial * 37 AS BIGINT)) AS created_at,
         CASE WHEN trial % 9 = 4 THEN 'running' ELSE 'finished' END AS state,
         CASE WHEN trial % 6 <> 0 THEN printf('%.6f', ap) END AS best_cv_score,
         CASE WHEN trial % 6 <> 0 THEN 'average_precision' END AS scoring_metric,
         CASE WHEN trial % 6 = 0 THEN printf('%.6f', auc) END AS best_cv_roc_auc,
         CASE WHEN trial % 9 <> 4 THEN printf('%.6f', auc) END AS test_roc_auc,
         CASE WHEN trial % 9 <> 4 THEN printf('%.6f', ap) END AS test_pr_auc,
         CAST(n AS VARCHAR) AS n_customers,
         (CASE WHEN trial % 6 <> 0 THEN 2 ELSE 1 END) + (CASE WHEN trial % 9 <> 4 THEN 2 ELSE 0 END) + 2
           AS n_summary,
         (CASE WHEN use_recency = 'yes' THEN 8 ELSE 7 END) + 3 AS n_config
  FROM trials
  UNION ALL
  SELECT 'base-' || model, 'marketing-' || model, model, 'classify-baseline',
         TIMESTAMP '2025-12-31 12:00:00' + to_hours(CAST(rank AS BIGINT)), 'finished',
         NULL, NULL, NULL, NULL, NULL, NULL, 3, 1
  FROM board),
named AS (SELECT *, CASE WHEN trim(regexp_replace(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g'),
                                                  '\\s+', ' ', 'g'), ' -_·') = '' THEN 'run'
                         ELSE trim(regexp_replace(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g'),
                                                  '\\s+', ' ', 'g'), ' -_·') END AS safe_name
          FROM runs),
recent AS (SELECT * FROM (SELECT * FROM named ORDER BY created_at DESC, id LIMIT 100)
           WHERE contains(coalesce(job_type, ''), 'hparam-search')),
lb AS (SELECT id, safe_name AS name, model,
              CAST(coalesce(best_cv_score, best_cv_roc_auc) AS DOUBLE) AS best_cv,
              coalesce(scoring_metric, 'roc_auc') AS optimised_on,
              CAST(test_roc_auc AS DOUBLE) AS test_roc_auc, CAST(test_pr_auc AS DOUBLE) AS test_pr_auc,
              strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, state
       FROM recent WHERE test_roc_auc IS NOT NULL),
lb_ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY test_roc_auc DESC, id) AS INTEGER) AS rank FROM lb)"""


def _runs(spark, sf_dir):
    trials = _rule(spark, sf_dir, with_metrics=True)
    board = E.leaderboard(base.scores(spark, sf_dir))
    return X.runs_from_search(trials).unionByName(X.runs_from_board(board))


@register("run_log", with_raw(_RUNS + """
SELECT id, safe_name AS name, model, job_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, state,
       n_summary, n_config FROM named"""))
def run_log(spark, sf_dir):
    return R.run_table(_runs(spark, sf_dir))


_LOG_COLUMNS = "id, safe_name AS name, model, job_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, state"


@register("run_log_appended", with_raw(_RUNS + f"\nSELECT {_LOG_COLUMNS}, n_summary, n_config FROM named"))
def run_log_appended(spark, sf_dir):
    """I1 sink: the runs, appended in three batches, one of them twice, and compacted."""
    runs = _runs(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark)}/run-log-{uuid.uuid4().hex}"
    early = F.col("created_at") < F.lit("2026-01-02").cast("timestamp_ntz")
    search = F.col("job_type") == R.SEARCH_JOB
    for batch, rows in [("baseline", ~search), ("search 1", search & early), ("search 1", search & early),
                        ("search 2", search & ~early)]:
        R.append_runs(runs.where(rows), root, batch)
    run_log_files.compact(spark, root, runs.schema)
    R.append_runs(runs.where(search & early), root, "search 1")   # a late retry
    return R.run_table(run_log_files.read(spark, root, runs.schema))


@register("fetched_runs", with_raw(_RUNS + """
SELECT id, safe_name AS name, model, CASE WHEN job_type = 'classify-baseline' THEN '—' ELSE job_type END AS job_type,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, state,
       n_summary + 2 AS n_summary, n_config + 2 AS n_config, 'tracker/runs/' || id AS url FROM named"""))
def fetched_runs(spark, sf_dir):
    """Runs read from a tracker's records, scalar entries only, with their url."""
    runs = R.fetched_runs(X.tracked_runs(_runs(spark, sf_dir)))
    return R.run_table(runs).join(runs.select("id", "url"), "id")


@register("run_metrics", with_raw(RULE + """
, steps AS (SELECT trial, ap, CASE WHEN ap IS NULL THEN NULL
                                  ELSE max(ap) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) END AS best
            FROM trials)
SELECT 'rule-study' AS run_id, trial AS step, 'trial_score' AS metric, round(ap, 6) AS value FROM steps
UNION ALL
SELECT 'rule-study', trial, 'best_so_far', round(best, 6) FROM steps"""))
def run_metrics(spark, sf_dir):
    return R.run_metrics(_rule(spark, sf_dir, with_metrics=True))


@register("ascii_safe", with_raw(_RUNS + "\nSELECT id, name AS raw_name, safe_name FROM named"))
def ascii_safe(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs.select("id", F.col("name").alias("raw_name"), R.ascii_safe(F.col("name")).alias("safe_name"))


@register("ascii_safe_maps")
def ascii_safe_maps(spark, sf_dir):
    """I2 on maps: every run's config with safe keys and values, one row per entry."""
    return _runs(spark, sf_dir).select("id", F.explode(R.ascii_safe_map(F.col("config"))).alias("key", "value"))


@register("recent_runs", with_raw(_RUNS + """
SELECT id, safe_name AS name, model, job_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, state,
       n_summary, n_config FROM recent"""))
def recent_runs(spark, sf_dir):
    return R.run_table(R.recent_runs(_runs(spark, sf_dir)))


@register("run_leaderboard", with_raw(_RUNS + "\nSELECT * FROM lb_ranked"))
def run_leaderboard(spark, sf_dir):
    return R.run_leaderboard(R.recent_runs(_runs(spark, sf_dir)))


@register("run_inspect", with_raw(_RUNS + f"""
, best AS (SELECT id FROM lb_ranked WHERE rank = 1),
b AS (SELECT t.* FROM trials t JOIN best ON best.id = 'rule-' || lpad(CAST(t.trial AS VARCHAR), 4, '0')),
r AS (SELECT n.* FROM named n JOIN best USING (id)),
cfg AS ({" UNION ALL ".join(
    [f"SELECT '{p}' AS key, printf('%.6f', {p}) AS text FROM b WHERE {p} IS NOT NULL" for p in _NUM_PARAMS]
    + [f"SELECT '{p}', {p} FROM b" for p in _CAT_PARAMS] + ["SELECT 'model', 'rule' FROM b"])}),
met AS (SELECT 'final/best_cv_score' AS key, best_cv_score AS v FROM r
        UNION ALL SELECT 'final/best_cv_roc_auc', best_cv_roc_auc FROM r
        UNION ALL SELECT 'final/test_roc_auc', test_roc_auc FROM r
        UNION ALL SELECT 'final/test_pr_auc', test_pr_auc FROM r
        UNION ALL SELECT 'test/n_customers', n_customers FROM r)
SELECT (SELECT id FROM best) AS id, 'config' AS kind, key, text, CAST(NULL AS DOUBLE) AS number FROM cfg
UNION ALL
SELECT (SELECT id FROM best), 'metric', key, NULL, round_even(CAST(v AS DOUBLE), 4) FROM met WHERE v IS NOT NULL"""))
def run_inspect(spark, sf_dir):
    runs = R.recent_runs(_runs(spark, sf_dir))
    best = R.run_leaderboard(runs).where(F.col("rank") == 1).select("id")
    return R.run_inspect(runs.join(best, "id"))
