"""Dataset catalog and feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlab.functions.columns import numeric_columns

ROW_KEY = "ID"

# Column meanings, as sources/campaign.py and operators/prep.py derive them.
# Names are fixed values that must match the reference's columns.
FEATURE_DESCRIPTIONS = {
    "Age": "Reference year minus birth year, at most 100",
    "Tenure_Days": "Days between the first order and the newest first order of any customer",
    "Education": "Market segment as an ordered code from 0 to 3",
    "Marital_Status": "1 for the two partnered groups of nations, otherwise 0",
    "Income": "Account balance times ten; missing if negative, limited to the 99th percentile",
    "Kidhome": "Customer key modulo 3",
    "Teenhome": "Customer key modulo 2",
    "HasChildren": "1 if Kidhome or Teenhome is above 0",
    "Recency": "Days from the last order to the cut-off date",
    "MntWines": "Extended price of STANDARD parts ordered up to the cut-off",
    "MntFruits": "Extended price of ECONOMY parts ordered up to the cut-off",
    "MntMeatProducts": "Extended price of MEDIUM parts ordered up to the cut-off",
    "MntFishProducts": "Extended price of SMALL parts ordered up to the cut-off",
    "MntSweetProducts": "Extended price of LARGE parts ordered up to the cut-off",
    "MntGoldProds": "Extended price of PROMO parts ordered up to the cut-off",
    "TotalSpend": "Sum of the six Mnt columns",
    "NumWebPurchases": "Line items with return flag N",
    "NumCatalogPurchases": "Line items with return flag R",
    "NumStorePurchases": "Line items with return flag A",
    "TotalPurchases": "Line items of the three channels together",
    "AcceptedCmp1": "1 if a large finished order of priority 1 exists",
    "AcceptedCmp2": "1 if a large finished order of priority 2 exists",
    "AcceptedCmp3": "1 if a large finished order of priority 3 exists",
    "AcceptedCmp4": "1 if a large finished order of priority 4 exists",
    "AcceptedCmp5": "1 if a large finished order of priority 5 exists",
    "TotalAccepted": "Number of the five campaign flags that are set",
}
ENGINEERED_DESCRIPTIONS = {
    "Age": "Derived from Year_Birth",
    "Tenure_Days": "Derived from Dt_Customer",
    "TotalSpend": "Derived from the Mnt columns",
    "TotalPurchases": "Derived from the purchase counts",
    "TotalAccepted": "Derived from the campaign flags",
    "HasChildren": "Derived from Kidhome and Teenhome",
    "Education": "Recoded from the segment name",
    "Marital_Status": "Recoded from the status name",
}
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class DatasetSpec:
    key: str
    title: str
    target: str
    target_desc: str
    source: str
    descriptions: dict = field(default_factory=dict)


DATASETS = {
    "marketing": DatasetSpec(
        key="marketing", title="Marketing Campaign Response", target="Response",
        target_desc="1 if the customer ordered after the cut-off date",
        source="customer, orders, lineitem, part and events tables", descriptions=FEATURE_DESCRIPTIONS),
}


def get_target(key: str) -> str:
    return DATASETS[key].target


def feature_list_names(df: DataFrame, target: str = "Response") -> list[str]:
    """A3: numeric columns except the target (and the row key).

    Spark resolves names case-insensitively, so the exclusion does too.
    """
    skip = {target.lower(), ROW_KEY.lower()}
    return [c for c in numeric_columns(df) if c.lower() not in skip]


def feature_list(df: DataFrame, target: str = "Response") -> DataFrame:
    """A3 as a table: feature, position, type and non-null count (one pass)."""
    feats = feature_list_names(df, target)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in feats])
    long = counts.unpivot([], feats, "feature", "non_null")
    spark = df.sparkSession
    meta = spark.createDataFrame([(f, i, types[f]) for i, f in enumerate(feats)],
                                 "feature string, position int, dtype string")
    return meta.join(long, "feature")


def feature_subset(df: DataFrame, selected: Sequence[str], target: str = "Response") -> DataFrame:
    """A4: the row key, the selected features and the target (a projection)."""
    if not selected:
        raise ValueError("select at least one feature")
    missing = [c for c in selected if c not in df.columns]
    if missing:
        raise ValueError(f"unknown features {missing}")
    return df.select(ROW_KEY, *selected, target)


def descriptions_table(spark, key: str = "marketing") -> DataFrame:
    spec = DATASETS[key]
    names = sorted(set(spec.descriptions) | set(ENGINEERED_DESCRIPTIONS))
    rows = [(n, spec.descriptions.get(n), ENGINEERED_DESCRIPTIONS.get(n)) for n in names]
    return spark.createDataFrame(rows, "feature string, primary_desc string, engineered_desc string")


def describe_features(features: DataFrame, key: str = "marketing") -> DataFrame:
    """Attach a description with fallback primary -> engineered -> ''.

    The catalog has a fixed handful of rows, so it is broadcast.
    """
    cat = descriptions_table(features.sparkSession, key)
    j = features.join(F.broadcast(cat), "feature", "left")
    return j.select(*features.columns,
                    F.coalesce("primary_desc", "engineered_desc", F.lit("")).alias("description"))
