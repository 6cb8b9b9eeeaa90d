"""Queries for sources (A), preparation (B) and conclusions (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reachlab.functions.columns import r6
from reachlab.operators import conclude, prep
from reachlab.plans import base
from reachlab.plans.oracle_base import with_prep, with_raw
from reachlab.plans.registry import register


@register("load_campaign", with_raw("SELECT * FROM campaign_raw"))
def load_campaign(spark, sf_dir):
    return base.raw(spark, sf_dir)


@register("prep_age", with_raw(
    "SELECT ID, CAST(CASE WHEN 2025 - Year_Birth > 100 THEN 100 ELSE 2025 - Year_Birth END "
    "AS INTEGER) AS Age FROM campaign_raw"))
def prep_age(spark, sf_dir):
    return prep.prep_age(base.raw(spark, sf_dir)).select("ID", "Age")


@register("prep_tenure", with_raw("""
, d AS (SELECT ID, CAST(try_strptime(Dt_Customer, '%d-%m-%Y') AS DATE) AS dt FROM campaign_raw)
SELECT ID, dt AS enrolled, CAST(date_diff('day', dt, (SELECT max(dt) FROM d)) AS INTEGER) AS Tenure_Days
FROM d"""))
def prep_tenure(spark, sf_dir):
    raw = base.raw(spark, sf_dir).select("ID", "Dt_Customer")
    enrolled = raw.withColumn("enrolled", prep.parse_day_first(F.col("Dt_Customer")))
    return prep.prep_tenure(enrolled).select("ID", "enrolled", "Tenure_Days")


@register("prep_income", with_prep("SELECT ID, round(Income, 6) AS Income FROM prepared"))
def prep_income(spark, sf_dir):
    return prep.prep_income(base.raw(spark, sf_dir)).select("ID", r6("Income").alias("Income"))


@register("prep_education", with_prep("SELECT ID, Education FROM prepared"))
def prep_education(spark, sf_dir):
    return prep.prep_education(base.raw(spark, sf_dir)).select("ID", "Education")


@register("prep_marital", with_prep("SELECT ID, Marital_Status FROM prepared"))
def prep_marital(spark, sf_dir):
    return prep.prep_marital(base.raw(spark, sf_dir)).select("ID", "Marital_Status")


@register("prep_totals", with_prep(
    "SELECT ID, TotalSpend, TotalPurchases, TotalAccepted FROM prepared"))
def prep_totals(spark, sf_dir):
    return prep.prep_totals(base.raw(spark, sf_dir)).select(
        "ID", "TotalSpend", "TotalPurchases", "TotalAccepted")


@register("prep_children", with_prep("SELECT ID, HasChildren FROM prepared"))
def prep_children(spark, sf_dir):
    return prep.prep_children(base.raw(spark, sf_dir)).select("ID", "HasChildren")


@register("prep_full", with_prep("SELECT * REPLACE (round(Income, 6) AS Income) FROM prepared"))
def prep_full(spark, sf_dir):
    df = base.prepared(spark, sf_dir)
    return df.withColumn("Income", r6("Income"))


@register("campaign_summary", with_prep("""
SELECT count(*) AS n_customers, CAST(sum(Response) AS BIGINT) AS n_responders,
       round(avg(Response), 6) AS response_rate,
       round(CASE WHEN avg(Response) = 0 THEN NULL ELSE (1 - avg(Response)) / avg(Response) END, 6)
         AS imbalance
FROM prepared"""))
def campaign_summary(spark, sf_dir):
    return conclude.campaign_summary(base.prepared(spark, sf_dir))


@register("responder_contrast", with_prep("""
, m AS (
  SELECT coalesce(avg(CASE WHEN Response = 1 THEN CAST(TotalSpend AS DOUBLE) END), 0.0) AS spend_resp,
         coalesce(avg(CASE WHEN Response = 0 THEN CAST(TotalSpend AS DOUBLE) END), 0.0) AS spend_non,
         coalesce(avg(CASE WHEN Response = 1 THEN CAST(TotalAccepted AS DOUBLE) END), 0.0) AS accepted_resp,
         coalesce(avg(CASE WHEN Response = 0 THEN CAST(TotalAccepted AS DOUBLE) END), 0.0) AS accepted_non,
         coalesce(avg(CASE WHEN Response = 1 THEN Income END), 0.0) AS income_resp,
         coalesce(avg(CASE WHEN Response = 0 THEN Income END), 0.0) AS income_non
  FROM prepared)
SELECT round(spend_resp, 6) AS spend_resp, round(spend_non, 6) AS spend_non,
       round(accepted_resp, 6) AS accepted_resp, round(accepted_non, 6) AS accepted_non,
       round(income_resp, 6) AS income_resp, round(income_non, 6) AS income_non,
       round(CASE WHEN spend_non > 0 THEN spend_resp / spend_non ELSE 1.0 END, 6) AS spend_lift
FROM m"""))
def responder_contrast(spark, sf_dir):
    return conclude.responder_contrast(base.prepared(spark, sf_dir))


# A2 - A8 ---------------------------------------------------------------------------------
from reachlab.functions.columns import hash_order  # noqa: E402
from reachlab.operators import catalog  # noqa: E402
from reachlab.plans.oracle_base import PREP_FEATURES  # noqa: E402

_PREP_TYPES = {"Education": "int", "Marital_Status": "int", "Income": "double", "Kidhome": "int",
               "Teenhome": "int", "Recency": "int", "TotalSpend": "decimal(18,2)", "TotalPurchases": "bigint",
               "TotalAccepted": "int", "HasChildren": "int", "Age": "int", "Tenure_Days": "int"}


def _dtype(c):
    if c.startswith("Mnt"):
        return "decimal(18,2)"
    if c.startswith("Num"):
        return "bigint"
    if c.startswith("AcceptedCmp"):
        return "int"
    return _PREP_TYPES[c]


_FEATURE_LIST = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, '{_dtype(c)}' AS dtype, count({c}) AS non_null FROM prepared"
    for i, c in enumerate(PREP_FEATURES))


@register("feature_list", with_prep(f"\n, fl AS ({_FEATURE_LIST})\nSELECT * FROM fl"))
def feature_list(spark, sf_dir):
    return catalog.feature_list(base.prepared(spark, sf_dir))


_SUBSET = ["Income", "Recency", "TotalSpend", "TotalAccepted"]


@register("feature_subset", with_prep(
    f"SELECT ID, round(Income, 6) AS Income, Recency, TotalSpend, TotalAccepted, Response FROM prepared"))
def feature_subset(spark, sf_dir):
    df = catalog.feature_subset(base.prepared(spark, sf_dir), _SUBSET)
    return df.withColumn("Income", r6("Income"))


def _desc_rows():
    names = sorted(set(catalog.FEATURE_DESCRIPTIONS) | set(catalog.ENGINEERED_DESCRIPTIONS))
    q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    return ", ".join(f"('{n}', {q(catalog.FEATURE_DESCRIPTIONS.get(n))}, "
                     f"{q(catalog.ENGINEERED_DESCRIPTIONS.get(n))})" for n in names)


@register("feature_descriptions", with_prep(f"""
, fl AS ({_FEATURE_LIST}),
cat AS (SELECT * FROM (VALUES {_desc_rows()}) AS t(feature, primary_desc, engineered_desc))
SELECT fl.feature, fl.position, fl.dtype, fl.non_null,
       coalesce(primary_desc, engineered_desc, '') AS description
FROM fl LEFT JOIN cat USING (feature)"""))
def feature_descriptions(spark, sf_dir):
    return catalog.describe_features(catalog.feature_list(base.prepared(spark, sf_dir)))


@register("preview_head", with_raw("SELECT * FROM campaign_raw ORDER BY ID LIMIT 10"))
def preview_head(spark, sf_dir):
    """First 10 rows by ID (a top-k: the limit is the feature)."""
    return base.raw(spark, sf_dir).orderBy("ID").limit(10)


@register("preview_tail", with_raw("SELECT * FROM campaign_raw ORDER BY ID DESC LIMIT 10"))
def preview_tail(spark, sf_dir):
    """Last 10 rows by ID."""
    return base.raw(spark, sf_dir).orderBy(F.col("ID").desc()).limit(10)


@register("preview_sample", with_raw(
    "SELECT * FROM campaign_raw ORDER BY md5('42|' || CAST(ID AS VARCHAR)), ID LIMIT 10"))
def preview_sample(spark, sf_dir):
    """A reproducible 10-row sample: first 10 by md5(seed|ID)."""
    return base.raw(spark, sf_dir).orderBy(hash_order(42, "ID"), "ID").limit(10)


@register("load_campaign_tsv", with_raw("SELECT * FROM campaign_raw"))
def load_campaign_tsv(spark, sf_dir):
    """A1: the customer table written as tab-separated text with a header and
    read back with the explicit raw schema (no inference pass)."""
    import os
    import uuid

    from reachlab.session import ensure_checkpoint_dir
    from reachlab.sources.campaign import read_campaign_file, write_campaign_file
    path = os.path.join(ensure_checkpoint_dir(spark), "campaign-tsv", uuid.uuid4().hex)
    write_campaign_file(base.raw(spark, sf_dir), path, "tsv")
    return read_campaign_file(spark, path, "tsv")
