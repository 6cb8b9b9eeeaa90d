"""Experiment log as tables (I1-I5), re-aimed from a hosted tracker.

A run is a row ``(id, name, model, job_type, created_at, state, summary
map<string,string>, config map<string,string>)``; per-step metrics are rows of
``run_metrics(run_id, step, metric, value)``. Both are appended in batches to a log
of parquet folders (``sources.run_log``) and read back with ordinary filters.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlab.functions.columns import r6
from reachlab.sources import run_log

# --- fixed values of the reference's run handling ------------------------------------
STRIP_CHARS = " -_·"
EMPTY_NAME = "run"
UNKNOWN = "—"
RECENT_LIMIT = 100
SEARCH_JOB = "hparam-search"
BASELINE_JOB = "classify-baseline"
DEFAULT_SCORING = "roc_auc"
CONFIG_SKIP = ["dataset", "target", "n_features", "features", "test_size", "scale_data",
               "train_samples", "test_samples"]
METRIC_PREFIXES = ["final/", "test/"]
# ---------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfkd_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then drop every non-ASCII character."""
    return s.map(lambda v: None if v is None else
                 unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))


def ascii_safe(c: Column) -> Column:
    """I2 for one string column: NFKD, drop non-ASCII, collapse whitespace, strip
    ' -_·' from both ends; an empty result becomes 'run'.

    Only the Unicode decomposition needs Python (Arrow-batched pandas UDF);
    the rest is JVM-side regex.
    """
    t = _nfkd_ascii(c)
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"^[ \-_·]+|[ \-_·]+$", "")
    return F.when(c.isNull(), None).when(t == "", F.lit(EMPTY_NAME)).otherwise(t)


def _safe(v: str | None) -> str | None:
    """I2 for one Python string (higher-order functions cannot hold a Python UDF)."""
    if v is None:
        return None
    v = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"\s+", " ", v).strip(STRIP_CHARS) or EMPTY_NAME


@F.pandas_udf(T.ArrayType(T.StringType()))
def _safe_list(s: pd.Series) -> pd.Series:
    return s.map(lambda values: None if values is None else [_safe(v) for v in values])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _safe_keys(keys: pd.Series) -> pd.Series:
    return keys.map(lambda ks: None if ks is None else list(dict.fromkeys(_safe(k) for k in ks)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _safe_values(keys: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([None if ks is None else list({_safe(k): _safe(v) for k, v in zip(ks, vs)}.values())
                      for ks, vs in zip(keys, values)], dtype=object)


def ascii_safe_list(c: Column) -> Column:
    """I2 applied to the elements of an array<string>; NULL stays NULL."""
    return _safe_list(c)


def ascii_safe_map(c: Column) -> Column:
    """I2 applied to keys and values of a map<string,string>.

    Keys that become equal keep the last entry, as assigning them in order would.
    """
    keys, values = F.map_keys(c), F.map_values(c)
    return F.map_from_arrays(_safe_keys(keys), _safe_values(keys, values))


def fmt(x: Column) -> Column:
    """Numbers are stored in the run maps as fixed 6-decimal text."""
    return F.format_string("%.6f", x.cast("double"))


def _map(entries: list[tuple[str, Column]]) -> Column:
    arr = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in entries])
    return F.map_from_entries(F.filter(arr, lambda e: e.getField("v").isNotNull()))


def append_runs(runs: DataFrame, path: str, batch: str) -> bool:
    """I1 sink: append to the run log at ``path``; a batch that is retried adds nothing."""
    return run_log.append(runs, path, batch)


def append_run_metrics(metrics: DataFrame, path: str, batch: str) -> bool:
    """I1 sink for per-step metrics, with the same care for retried batches."""
    return run_log.append(metrics, path, batch)


def run_metrics(trials: DataFrame, run_id: str = "rule-study") -> DataFrame:
    """I1 per-step metrics of a search study: each trial is a step, logging
    its score and the best score so far."""
    w = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)   # #trials rows
    best = F.when(F.col("ap").isNull(), None).otherwise(F.max("ap").over(w))
    steps = trials.select(F.lit(run_id).alias("run_id"), F.col("trial").alias("step"),
                          F.col("ap").alias("trial_score"), best.alias("best_so_far"))
    return steps.unpivot(["run_id", "step"], ["trial_score", "best_so_far"], "metric", "value") \
        .select("run_id", "step", "metric", r6("value").alias("value"))


def _scalars(document: Column) -> Column:
    """The entries of a JSON object that are numbers, strings or booleans, as text."""
    entries = F.from_json(document, "map<string,variant>")
    kept = F.map_filter(entries, lambda _, v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
    return F.coalesce(F.transform_values(kept, lambda _, v: v.cast("string")),
                      F.create_map().cast("map<string,string>"))


def fetched_runs(tracked: DataFrame) -> DataFrame:
    """Runs from the records of a tracker (id, name, job_type, created_at, state,
    summary and config as JSON objects, url).

    The maps keep scalar entries only; lists, objects and nulls in them go. ``model``
    comes from the config. A run without a model or job type has a dash there. A
    document that is null or no JSON object gives an empty map.
    """
    config = _scalars(F.col("config"))
    text = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(c)
    return tracked.select(
        "id", "name", F.coalesce(F.try_element_at(config, F.lit("model")), F.lit(UNKNOWN)).alias("model"),
        text(F.col("job_type")).alias("job_type"), "created_at", "state",
        _scalars(F.col("summary")).alias("summary"), config.alias("config"), "url")


def recent_runs(runs: DataFrame, job_type_substring: str | None = SEARCH_JOB,
                limit: int = RECENT_LIMIT) -> DataFrame:
    """The ``limit`` most recent runs first, then the job-type filter (a
    filter must not move below the limit; Catalyst keeps this order)."""
    recent = runs.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)
    if job_type_substring:
        recent = recent.where(F.coalesce(F.col("job_type"), F.lit("")).contains(job_type_substring))
    return recent


def run_table(runs: DataFrame) -> DataFrame:
    """Flat view of runs: safe name, timestamp text, map sizes."""
    return runs.select("id", ascii_safe(F.col("name")).alias("name"), "model", "job_type",
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
                       "state", F.size("summary").alias("n_summary"), F.size("config").alias("n_config"))


def run_leaderboard(runs: DataFrame) -> DataFrame:
    """I4: best CV score (new key, else the older one), scoring metric
    (default roc_auc), test metrics; runs without a test ROC AUC dropped;
    ranked by test ROC AUC."""
    s = F.col("summary")
    out = runs.select(
        "id", ascii_safe(F.col("name")).alias("name"), "model",
        F.coalesce(s["final/best_cv_score"], s["final/best_cv_roc_auc"]).cast("double").alias("best_cv"),
        F.coalesce(s["final/scoring_metric"], F.lit(DEFAULT_SCORING)).alias("optimised_on"),
        s["final/test_roc_auc"].cast("double").alias("test_roc_auc"),
        s["final/test_pr_auc"].cast("double").alias("test_pr_auc"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "state")
    done = out.where(F.col("test_roc_auc").isNotNull())
    w = Window.orderBy(F.col("test_roc_auc").desc(), F.col("id"))   # <= limit rows
    return done.withColumn("rank", F.row_number().over(w))


def run_inspect(runs: DataFrame, run_id: Column | str | None = None) -> DataFrame:
    """Hyperparameters (config without '_*' keys and the skip list) and
    numeric final/test metrics rounded to 4 places, as (kind, key, text, number)."""
    sel = runs if run_id is None else runs.where(F.col("id") == run_id)
    cfg = sel.select("id", F.explode("config").alias("key", "v")).where(
        ~F.col("key").startswith("_") & ~F.col("key").isin(*CONFIG_SKIP)).select(
        "id", F.lit("config").alias("kind"), "key", F.col("v").alias("text"),
        F.lit(None).cast("double").alias("number"))
    num = F.col("v").try_cast("double") if hasattr(Column, "try_cast") else F.expr("try_cast(v AS double)")
    prefix = F.lit(False)
    for p in METRIC_PREFIXES:
        prefix = prefix | F.col("key").startswith(p)
    met = sel.select("id", F.explode("summary").alias("key", "v")).where(prefix & num.isNotNull()).select(
        "id", F.lit("metric").alias("kind"), "key", F.lit(None).cast("string").alias("text"),
        F.bround(num, 4).alias("number"))
    return cfg.unionByName(met)
