"""Queries for explainability.

The SQL-checked views run on the linear attribution fixture derived from the
customer table; the model-based ones (built-in importance, coefficients, SHAP
of the fitted logistic model) are rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlab.operators import explain as X
from reachlab.operators.catalog import (ENGINEERED_DESCRIPTIONS, FEATURE_DESCRIPTIONS,
                                        describe_features, feature_list_names)
from reachlab.operators.models import MODEL_NAMES, fit_model
from reachlab.plans import base
from reachlab.plans.oracle_base import with_raw
from reachlab.plans.registry import register
from reachlab.sources.fixtures import ATTRIBUTION_MODELS


def _lit(w: float) -> str:
    return f"CAST({w!r} AS DOUBLE)"


def _attr_sql() -> str:
    feats = sorted({f for w, _, _ in ATTRIBUTION_MODELS.values() for f in w})
    means = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in feats)
    parts = []
    for name, (w, b, space) in ATTRIBUTION_MODELS.items():
        base_expr = f"{_lit(b)} + (" + " + ".join(f"{_lit(v)} * m_{f}" for f, v in w.items()) + ")"
        for f, v in w.items():
            val = f"coalesce(CAST({f} AS DOUBLE), m_{f})"
            parts.append(f"SELECT '{name}' AS model, ID AS id, '{f}' AS feature, {val} AS value, "
                         f"{_lit(v)} * ({val} - m_{f}) AS contribution, {base_expr} AS base_value, "
                         f"'{space}' AS space FROM campaign_raw, attr_means")
    return (f"\n, attr_means AS (SELECT {means} FROM campaign_raw),\n"
            f"attributions AS ({' UNION ALL '.join(parts)})")


ATTR = _attr_sql()
_DESC_ROWS = ", ".join(
    "('{}', {}, {})".format(n, f"'{FEATURE_DESCRIPTIONS[n]}'" if n in FEATURE_DESCRIPTIONS else "NULL",
                            f"'{ENGINEERED_DESCRIPTIONS[n]}'" if n in ENGINEERED_DESCRIPTIONS else "NULL")
    for n in sorted(set(FEATURE_DESCRIPTIONS) | set(ENGINEERED_DESCRIPTIONS)))
_SHAP = ATTR + """,
shap AS (SELECT model, feature, round(avg(abs(contribution)), 6) AS mean_abs_shap FROM attributions
         GROUP BY model, feature),
shap_rank AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY mean_abs_shap DESC, feature)
                              AS INTEGER) AS rank FROM shap)"""


def _attr(spark, sf_dir):
    return base.attributions(spark, sf_dir)


@register("linear_attributions", with_raw(ATTR + """
SELECT model, id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution,
       round(base_value, 6) AS base_value, space FROM attributions"""))
def linear_attributions(spark, sf_dir):
    a = _attr(spark, sf_dir)
    return a.select("model", "id", "feature", *[F.round(c, 6).alias(c) for c in
                                                ("value", "contribution", "base_value")], "space")


@register("attribution_store", with_raw(ATTR + """
SELECT id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution, space
FROM attributions WHERE model = 'linear_a'"""))
def attribution_store(spark, sf_dir):
    """A5 + A6: ask a new store for one model's attributions, which computes and stores
    them, store all models, and read the one back from its own folder."""
    import uuid

    from reachlab.sources.store import dataset_key, default_store, load_attributions, store_attributions
    root, dataset = f"{default_store(spark)}/{uuid.uuid4().hex}", dataset_key(sf_dir)
    load_attributions(spark, root, dataset, "linear_a", compute=lambda: _attr(spark, sf_dir))
    store_attributions(_attr(spark, sf_dir), root, dataset)
    got = load_attributions(spark, root, dataset, "linear_a")
    return got.select("id", "feature", F.round("value", 6).alias("value"),
                      F.round("contribution", 6).alias("contribution"), "space")


@register("mean_abs_shap", with_raw(_SHAP + "\nSELECT * FROM shap_rank"))
def mean_abs_shap(spark, sf_dir):
    return X.mean_abs_shap(_attr(spark, sf_dir))


@register("key_drivers", with_raw(_SHAP + f"""
, cat AS (SELECT * FROM (VALUES {_DESC_ROWS}) AS t(feature, primary_desc, engineered_desc))
SELECT model, feature, mean_abs_shap, rank,
       coalesce(primary_desc, engineered_desc, '') AS description
FROM shap_rank LEFT JOIN cat USING (feature) WHERE rank <= 3"""))
def key_drivers(spark, sf_dir):
    ranking = X.mean_abs_shap(_attr(spark, sf_dir))
    return X.key_drivers(ranking, describe=describe_features)


@register("driver_direction", with_raw(ATTR + """,
st AS (SELECT model, feature, count(DISTINCT value) AS n_values,
              covar_pop(rv, rc) AS cov, var_pop(rv) AS vv, var_pop(rc) AS vc
       FROM (SELECT model, feature, value,
                    (rank() OVER (PARTITION BY model, feature ORDER BY value)
                     + count(*) OVER (PARTITION BY model, feature, value) - 1) / 2.0
                    + rank() OVER (PARTITION BY model, feature ORDER BY value) / 2.0 AS rv,
                    (rank() OVER (PARTITION BY model, feature ORDER BY contribution)
                     + count(*) OVER (PARTITION BY model, feature, contribution) - 1) / 2.0
                    + rank() OVER (PARTITION BY model, feature ORDER BY contribution) / 2.0 AS rc
             FROM attributions) GROUP BY model, feature)
SELECT model, feature,
       round(CASE WHEN vv * vc IS NULL OR vv * vc = 0 THEN NULL ELSE cov / sqrt(vv * vc) END, 6) AS spearman,
       CASE WHEN n_values < 2 THEN '→'
            WHEN vv * vc IS NULL OR vv * vc = 0 THEN '→'
            WHEN cov / sqrt(vv * vc) > 0.25 THEN '↑'
            WHEN cov / sqrt(vv * vc) < -0.25 THEN '↓' ELSE '↔' END AS direction
FROM st"""))
def driver_direction(spark, sf_dir):
    return X.driver_direction(_attr(spark, sf_dir))


_H60 = "CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 15)) AS BIGINT)"


@register("beeswarm_points", with_raw(_SHAP + f"""
, ids AS (SELECT DISTINCT model, id FROM attributions),
picked AS (SELECT model, id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_H60}, id) AS r
                                  FROM ids) WHERE r <= 400)
SELECT a.model, a.id, a.feature, round(a.value, 6) AS value, round(a.contribution, 6) AS contribution
FROM attributions a JOIN (SELECT model, feature FROM shap_rank WHERE rank <= 10) t USING (model, feature)
JOIN picked USING (model, id)"""))
def beeswarm_points(spark, sf_dir):
    a = _attr(spark, sf_dir)
    return X.beeswarm_points(a, X.mean_abs_shap(a))


@register("customer_explanation", with_raw(ATTR + """,
c AS (SELECT *, base_value + sum(contribution) OVER (PARTITION BY model, id) AS output,
             sum(CASE WHEN contribution > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY model, id) AS n_positive,
             sum(CASE WHEN contribution < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY model, id) AS n_negative,
             row_number() OVER (PARTITION BY model, id ORDER BY abs(contribution) DESC, feature) AS rank
      FROM attributions),
d AS (SELECT *, CASE WHEN space = 'log_odds' THEN 1.0 / (1.0 + exp(-output)) ELSE output END AS probability,
             CASE WHEN space = 'log_odds' THEN 1.0 / (1.0 + exp(-base_value)) ELSE base_value END AS base_probability
      FROM c)
SELECT model, id, CAST(rank AS INTEGER) AS rank, feature, round(value, 6) AS value,
       round(contribution, 6) AS contribution, round(output, 6) AS output,
       round(probability, 6) AS probability, round(base_probability, 6) AS base_probability,
       round((probability - base_probability) * 100.0, 6) AS delta_points,
       CASE WHEN (probability - base_probability) * 100.0 >= 0 THEN 'above' ELSE 'below' END AS vs_base,
       CAST(n_positive AS INTEGER) AS n_positive, CAST(n_negative AS INTEGER) AS n_negative
FROM d WHERE rank <= 10"""))
def customer_explanation(spark, sf_dir):
    return X.customer_explanation(_attr(spark, sf_dir))


# G3 on the fixed linear scores ---------------------------------------------------------
def _perm_sql() -> str:
    feats = sorted({f for w, _, _ in ATTRIBUTION_MODELS.values() for f in w})
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in feats)
    # one step of the permutation: four rounds on the halves of a place, by md5 of the key
    mixed = lambda i, half: (
        f"CAST(('0x' || substr(md5('42|' || feature || '|' || CAST(rep AS VARCHAR) || '|{i}|' || "
        f"CAST({half} AS VARCHAR)), 1, 15)) AS BIGINT)")

    def step(source):
        out = f"(SELECT feature, rep, i, place // b AS l, place % b AS r, n, a, b FROM {source})"
        for i in range(4):
            new = f"(l + {mixed(i, 'r')}) % a AS l, r" if i % 2 == 0 else f"l, (r + {mixed(i, 'l')}) % b AS r"
            out = f"(SELECT feature, rep, i, {new}, n, a, b FROM {out})"
        return f"SELECT feature, rep, i, l * b + r AS place, n, a, b FROM {out}"

    blocks = []
    for name, (w, b, _space) in ATTRIBUTION_MODELS.items():
        fl = list(w)
        combos = ", ".join(f"('{f}')" for f in fl)
        case_v = "CASE t.feature " + " ".join(f"WHEN '{f}' THEN o.{f}" for f in fl) + " END"
        score = lambda src: f"{_lit(b)} + " + " + ".join(
            f"{_lit(v)} * coalesce({src}{f}, 0.0)" for f, v in w.items())
        swapped = ", ".join(f"CASE WHEN d.feature = '{f}' THEN d.v ELSE o.{f} END AS {f}" for f in fl)
        blocks.append(f"""
{name}_start AS (SELECT f.feature, CAST(r.rep AS INTEGER) AS rep, o.i, o.i - 1 AS place, s.*
                 FROM ordered o, (VALUES {combos}) f(feature), range(10) r(rep), perm_size s),
{name}_walk AS ({step(f"{name}_start")}
                UNION ALL {step(f"(SELECT * FROM {name}_walk WHERE place >= n)")}),
{name}_donors AS (SELECT t.feature, t.rep, t.place + 1 AS j, {case_v} AS v FROM {name}_walk t JOIN ordered o USING (i)
                  WHERE t.place < t.n),
{name}_perm AS (SELECT d.feature, d.rep, o.label, {swapped} FROM {name}_donors d JOIN ordered o ON o.i = d.j),
{name}_scored AS (SELECT feature, rep, label, {score('')} AS p FROM {name}_perm),
{name}_base AS (SELECT label, {score('')} AS p FROM ordered),
{name}_auc AS (
  SELECT s.feature, s.rep,
         sum(CASE WHEN s.p > n.p THEN 1.0 WHEN s.p = n.p THEN 0.5 ELSE 0.0 END)
           / (count(DISTINCT s.rid) * count(DISTINCT n.rid)) AS auc
  FROM (SELECT *, row_number() OVER () AS rid FROM {name}_scored WHERE label = 1) s
  JOIN (SELECT *, row_number() OVER () AS rid FROM {name}_scored WHERE label <> 1) n
    ON s.feature = n.feature AND s.rep = n.rep
  GROUP BY s.feature, s.rep),
{name}_base_auc AS (
  SELECT sum(CASE WHEN s.p > n.p THEN 1.0 WHEN s.p = n.p THEN 0.5 ELSE 0.0 END)
           / (count(DISTINCT s.rid) * count(DISTINCT n.rid)) AS base_auc
  FROM (SELECT *, row_number() OVER () AS rid FROM {name}_base WHERE label = 1) s,
       (SELECT *, row_number() OVER () AS rid FROM {name}_base WHERE label <> 1) n),
{name}_imp AS (SELECT '{name}' AS model, feature, round(avg(base_auc - auc), 6) AS importance_mean,
                      round(stddev_pop(base_auc - auc), 6) AS importance_std
               FROM {name}_auc, {name}_base_auc GROUP BY feature)""")
    union = " UNION ALL ".join(f"SELECT * FROM {n}_imp" for n in ATTRIBUTION_MODELS)
    return (f"\n, rows_t AS (SELECT ID AS id, Response AS label, {cols} FROM campaign_raw),\n"
            f"ordered AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM rows_t),\n"
            f"perm_side AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1 AS a FROM rows_t),\n"
            f"perm_size AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM perm_side),"
            + ",".join(blocks) + f",\nperm_imp AS ({union})")


PERM = _perm_sql()


def _perm(spark, sf_dir):
    raw = base.raw(spark, sf_dir).withColumnRenamed("ID", "id").withColumnRenamed("Response", "label")
    parts = []
    for name, (w, b, _space) in ATTRIBUTION_MODELS.items():
        rows = raw.select("id", "label", *list(w))
        parts.append(X.permutation_importance(rows, X.linear_score(w, b), list(w), model=name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("permutation_importance", with_raw(PERM + "\nSELECT * FROM perm_imp"))
def permutation_importance(spark, sf_dir):
    return _perm(spark, sf_dir)


_COEF_RANK = "\n" + ", coef AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, '{f}' AS feature, abs({_lit(v)}) * stddev_pop(CAST({f} AS DOUBLE)) AS s "
    f"FROM campaign_raw" for name, (w, _, _) in ATTRIBUTION_MODELS.items() for f, v in w.items()) + ")"


@register("ranking_agreement", with_raw(_SHAP + PERM.replace("\n, rows_t", ",\nrows_t", 1) + _COEF_RANK + """,
r_shap AS (SELECT model, feature, rank AS rank_shap FROM shap_rank),
r_perm AS (SELECT model, feature, CAST(row_number() OVER (PARTITION BY model ORDER BY importance_mean DESC,
                  feature) AS INTEGER) AS rank_permutation FROM perm_imp),
r_coef AS (SELECT model, feature, CAST(row_number() OVER (PARTITION BY model ORDER BY s DESC, feature)
                  AS INTEGER) AS rank_coefficient FROM coef)
SELECT coalesce(r_shap.model, r_perm.model, r_coef.model) AS model,
       coalesce(r_shap.feature, r_perm.feature, r_coef.feature) AS feature,
       rank_shap, rank_permutation, rank_coefficient,
       greatest(rank_shap, rank_permutation, rank_coefficient)
         - least(rank_shap, rank_permutation, rank_coefficient) AS rank_spread
FROM r_shap FULL OUTER JOIN r_perm ON r_shap.model = r_perm.model AND r_shap.feature = r_perm.feature
FULL OUTER JOIN r_coef ON coalesce(r_shap.model, r_perm.model) = r_coef.model
                      AND coalesce(r_shap.feature, r_perm.feature) = r_coef.feature"""))
def ranking_agreement(spark, sf_dir):
    from pyspark.sql import Window

    a = _attr(spark, sf_dir)
    shap = X.mean_abs_shap(a)
    perm = _perm(spark, sf_dir)
    w = Window.partitionBy("model").orderBy(F.col("importance_mean").desc(), "feature")
    perm_rank = perm.withColumn("rank", F.row_number().over(w))   # #features rows per model
    raw = base.raw(spark, sf_dir)
    coef_rows = []
    for name, (wts, _, _) in ATTRIBUTION_MODELS.items():
        sds = raw.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in wts]).first()
        coef_rows += [(name, f, abs(v) * (sds[f] or 0.0)) for f, v in wts.items()]
    coef = spark.createDataFrame(coef_rows, "model string, feature string, s double")
    wc = Window.partitionBy("model").orderBy(F.col("s").desc(), "feature")
    coef_rank = coef.withColumn("rank", F.row_number().over(wc))
    return X.ranking_agreement({"shap": shap, "permutation": perm_rank, "coefficient": coef_rank})


# model-based, rows-only -------------------------------------------------------------------
def _feats(spark, sf_dir):
    return feature_list_names(base.split(spark, sf_dir), "label")


@register("tree_importance")
def tree_importance(spark, sf_dir):
    """G1 + G2: built-in importance for tree models; permutation importance
    (5 repeats on the test split) for models without one."""
    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test")
    parts = []
    fitted = base.fitted_all(spark, sf_dir, MODEL_NAMES, profile="explain")
    for name in MODEL_NAMES:
        m = fitted[name]
        imp = X.tree_importance(m, feats, name)
        if imp is None:
            perm = X.permutation_importance(test.select("id", "label", *feats), X.model_score(m, feats),
                                            feats, repeats=5, model=name)
            from pyspark.sql import Window
            w = Window.partitionBy("model").orderBy(F.col("importance_mean").desc(), "feature")
            imp = perm.select("model", "feature", F.col("importance_mean").alias("importance"),
                              F.row_number().over(w).alias("rank"))
            imp = imp.withColumn("method", F.lit("permutation"))
        else:
            imp = imp.withColumn("method", F.lit("impurity"))
        parts.append(imp)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("logistic_coefficients")
def logistic_coefficients(spark, sf_dir):
    """Coefficients on standardised features of a logistic model that is
    fitted on all rows, after median fill and scaling."""
    feats = _feats(spark, sf_dir)
    return X.logistic_coefficients(fit_model("logistic", base.labelled(spark, sf_dir), feats, profile="explain"), feats)


@register("logistic_shap")
def logistic_shap(spark, sf_dir):
    """Exact SHAP values of the fitted logistic model on the test split."""
    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test")
    return X.logistic_attributions(base.fitted(spark, sf_dir, "logistic", profile="explain"), test, feats)


def _tree_shap(spark, sf_dir, name):
    from reachlab.operators.treeshap import tree_attributions
    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test").select("id", *feats)
    return tree_attributions(base.fitted(spark, sf_dir, name, profile="explain"), test, feats, name)


@register("tree_shap")
def tree_shap(spark, sf_dir):
    """Exact Tree SHAP of the decision tree (explain profile) on the test split."""
    return _tree_shap(spark, sf_dir, "tree")


@register("forest_shap")
def forest_shap(spark, sf_dir):
    """Exact Tree SHAP of the random forest (explain profile) on the test split."""
    return _tree_shap(spark, sf_dir, "forest")


@register("gbt_shap")
def gbt_shap(spark, sf_dir):
    """Exact Tree SHAP of gradient boosting (explain profile), log-odds space."""
    return _tree_shap(spark, sf_dir, "gbt")


@register("model_mean_abs_shap")
def model_mean_abs_shap(spark, sf_dir):
    """G6 on the fitted models' SHAP values (tree, forest, gbt, logistic)."""
    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test")
    base.fitted_all(spark, sf_dir, ("tree", "forest", "gbt", "logistic"), profile="explain")
    parts = [_tree_shap(spark, sf_dir, n) for n in ("tree", "forest", "gbt")]
    parts.append(X.logistic_attributions(base.fitted(spark, sf_dir, "logistic", profile="explain"), test, feats))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return X.mean_abs_shap(out)


@register("kernel_shap")
def kernel_shap(spark, sf_dir):
    """Sampled Shapley values of the MLP (explain profile) for every test
    row, against a background of the explain sample's train rows."""
    from reachlab.operators.kernelshap import kernel_attributions
    from reachlab.operators.split import explain_sample
    feats = _feats(spark, sf_dir)
    sp = base.split(spark, sf_dir)
    sample = explain_sample(sp.select("id", "label"))
    rows = sp.where(F.col("split") == "test").select("id", *feats)
    bg = sp.select("id", *feats).join(sample.where(F.col("split") == "train").select("id"), "id")
    return kernel_attributions(base.fitted(spark, sf_dir, "mlp", profile="explain"), rows, bg, feats, "mlp")


@register("model_permutation_importance")
def model_permutation_importance(spark, sf_dir):
    """G3 on the fitted models (explain profile): mean and std of the drop over
    10 repeats, on the test split."""
    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test").select("id", "label", *feats)
    fitted = base.fitted_all(spark, sf_dir, MODEL_NAMES, profile="explain")
    parts = [X.permutation_importance(test, X.model_score(fitted[n], feats), feats, model=n) for n in MODEL_NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("model_key_drivers")
def model_key_drivers(spark, sf_dir):
    """G7 + G13 on the fitted models: top 3 features per model by mean |SHAP|
    where attributions exist (logistic: exact linear SHAP; decision tree: Tree
    SHAP), otherwise by the model's importance (impurity, or permutation for
    the MLP), with descriptions."""
    from pyspark.sql import Window

    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test")
    base.fitted_all(spark, sf_dir, MODEL_NAMES, profile="explain")
    shap = X.logistic_attributions(base.fitted(spark, sf_dir, "logistic", profile="explain"), test, feats).unionByName(
        _tree_shap(spark, sf_dir, "tree"))
    by_shap = X.mean_abs_shap(shap).select("model", "feature", F.col("mean_abs_shap").alias("score"),
                                           F.lit("shap").alias("source"))
    parts = [X.tree_importance(base.fitted(spark, sf_dir, n, profile="explain"), feats, n).select(
        "model", "feature", F.col("importance").alias("score"), F.lit("importance:impurity").alias("source"))
        for n in ("forest", "gbt")]
    mlp = base.fitted(spark, sf_dir, "mlp", profile="explain")
    perm = X.permutation_importance(test.select("id", "label", *feats), X.model_score(mlp, feats), feats,
                                    repeats=5, model="mlp")
    parts.append(perm.select("model", "feature", F.col("importance_mean").alias("score"),
                             F.lit("importance:permutation").alias("source")))
    ranking = by_shap
    for part in parts:
        ranking = ranking.unionByName(part)
    w = Window.partitionBy("model").orderBy(F.col("score").desc(), "feature")   # #features rows per model
    top = ranking.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    return describe_features(top)


# A5 / A6 on the fitted models ---------------------------------------------------------
def _payload(spark, sf_dir, name, kind):
    """One stored table of a fitted model: its SHAP values, importance or permutation importance."""
    feats = _feats(spark, sf_dir)
    test = base.split(spark, sf_dir).where(F.col("split") == "test")
    fitted = base.fitted(spark, sf_dir, name, profile="explain")
    if kind == "permutation":
        return X.permutation_importance(test.select("id", "label", *feats), X.model_score(fitted, feats), feats, model=name)
    if kind == "importance":
        built_in = X.tree_importance(fitted, feats, name)
        if built_in is not None:
            return built_in.select("model", "feature", "importance")
        stored = _stored(spark, sf_dir, name, "permutation")
        return stored.select("model", "feature", F.col("importance_mean").alias("importance"))
    if name == "logistic":
        return X.logistic_attributions(fitted, test, feats)
    return kernel_shap(spark, sf_dir) if name == "mlp" else _tree_shap(spark, sf_dir, name)


def _stored(spark, sf_dir, name, kind):
    from reachlab.sources.store import dataset_key, default_store, load
    app, _, state, _ = base.state_key(spark, sf_dir, name)
    return load(spark, default_store(spark), dataset_key(sf_dir), f"{app}-{state}-{name}", kind,
                compute=lambda: _payload(spark, sf_dir, name, kind))


@register("stored_explanations")
def stored_explanations(spark, sf_dir):
    """A5 + A6: SHAP values, importance and permutation importance of the five fitted
    models, each computed and stored on a miss and read back from its own folder; per
    model and feature, with the model's base value."""
    out = None
    base.fitted_all(spark, sf_dir, MODEL_NAMES, profile="explain")
    for name in MODEL_NAMES:
        shap = _stored(spark, sf_dir, name, "shap").groupBy("model", "feature").agg(
            F.avg(F.abs("contribution")).alias("mean_abs_shap"), F.first("base_value").alias("base_value"))
        one = shap.join(_stored(spark, sf_dir, name, "importance"), ["model", "feature"]).join(
            _stored(spark, sf_dir, name, "permutation"), ["model", "feature"]).select(
            "model", "feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"),
            F.round("base_value", 6).alias("base_value"), "importance", "importance_mean", "importance_std")
        out = one if out is None else out.unionByName(one)
    return out
