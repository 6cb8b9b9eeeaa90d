"""Queries for split, scaling, weights and folds (D1-D5, D13 folds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlab.functions.columns import r6
from reachlab.operators import split as S
from reachlab.operators.catalog import feature_list_names
from reachlab.plans import base
from reachlab.plans.oracle_base import PREP_FEATURES, with_prep
from reachlab.plans.registry import register


def labelled(spark, sf_dir):
    return base.labelled(spark, sf_dir)


def split_table(spark, sf_dir):
    return base.split(spark, sf_dir)


_H60 = "CAST(('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 15)) AS BIGINT)"
_SPLIT = f"""
, lab AS (SELECT * RENAME (ID AS id, Response AS label) FROM prepared),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H60}, id) AS rn,
                  count(*) OVER (PARTITION BY label) AS n_class FROM lab),
splitted AS (SELECT * EXCLUDE (rn, n_class),
                    CASE WHEN rn <= floor(n_class * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
             FROM ranked)"""


@register("stratified_split", with_prep(_SPLIT + "\nSELECT id, label, split FROM splitted"))
def stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("id", "label", "split")


@register("hash_split", with_prep("""
SELECT ID AS id, Response AS label,
       CASE WHEN CAST(('0x' || substr(md5('42|' || CAST(ID AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2
            THEN 'test' ELSE 'train' END AS split
FROM prepared"""))
def hash_split(spark, sf_dir):
    return S.hash_split(labelled(spark, sf_dir)).select("id", "label", "split")


@register("explain_sample", with_prep("""
, lab AS (SELECT ID AS id, Response AS label FROM prepared),
capped AS (SELECT * FROM lab ORDER BY md5('42|' || CAST(id AS VARCHAR)), id LIMIT 5500),
m AS (SELECT count(*) AS m FROM capped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY """ + _H60 + """, id) AS rn,
                  count(*) OVER (PARTITION BY label) AS n_class FROM capped)
SELECT id, label, CASE WHEN rn <= floor(n_class * least(500.0 / m, 0.2) + 0.5) THEN 'test' ELSE 'train' END
       AS split
FROM ranked, m"""))
def explain_sample(spark, sf_dir):
    return S.explain_sample(labelled(spark, sf_dir).select("id", "label")).select("id", "label", "split")


@register("split_report", with_prep(_SPLIT + """
SELECT split, count(*) AS rows, round(avg(CAST(label AS DOUBLE)) * 100.0, 6) AS positive_pct
FROM splitted GROUP BY split"""))
def split_report(spark, sf_dir):
    return S.split_report(split_table(spark, sf_dir))


_STD_SELECT = ", ".join(
    f"round((CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END), 6) AS {c}"
    for c in PREP_FEATURES)
_STD_STATS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                       for c in PREP_FEATURES)


@register("standardize", with_prep(_SPLIT + f"""
, st AS (SELECT {_STD_STATS} FROM splitted WHERE split = 'train')
SELECT id, split, {_STD_SELECT} FROM splitted, st"""))
def standardize(spark, sf_dir):
    df = split_table(spark, sf_dir)
    feats = feature_list_names(df, target="label")
    out = S.standardize(df, feats)
    return out.select("id", "split", *[r6(c).alias(c) for c in feats])


@register("class_weights", with_prep("""
, c AS (SELECT Response AS label, count(*) AS n_class FROM prepared GROUP BY Response)
SELECT label, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS weight FROM c"""))
def class_weights(spark, sf_dir):
    return S.class_weights(labelled(spark, sf_dir))


@register("cv_folds", with_prep(_SPLIT + f"""
, tr AS (SELECT id, label FROM splitted WHERE split = 'train')
SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_H60}, id) - 1) % 5 AS INTEGER) AS fold
FROM tr"""))
def cv_folds(spark, sf_dir):
    train = split_table(spark, sf_dir).where(F.col("split") == "train").select("id", "label")
    return S.cv_folds(train)
