"""Feature preparation (B1-B11): raw customer table -> model-ready table.

Each step is a ``DataFrame -> DataFrame`` function; ``prep_full`` chains them
in the reference's order. Whole-table statistics (latest enrolment date,
income median and 99th percentile) are computed as bounded aggregates and
applied as literals or a broadcast one-row join, never as a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlab.functions.quantiles import exact_quantile, exact_quantiles

# --- fixed values of the reference's preprocessing ----------------------------
REFERENCE_YEAR = 2025
AGE_CAP = 100
INCOME_CAP_QUANTILE = 0.99
DATE_FORMAT = "dd-MM-yyyy"
EDUCATION_ORDER = {"Basic": 0, "Graduation": 1, "2n Cycle": 1, "Master": 2, "PhD": 3}
EDUCATION_DEFAULT = 1
PARTNERED = ["Married", "Together"]
SPEND_COLUMNS = ["MntWines", "MntFruits", "MntMeatProducts",
                 "MntFishProducts", "MntSweetProducts", "MntGoldProds"]
PURCHASE_COLUMNS = ["NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases"]
CAMPAIGN_COLUMNS = ["AcceptedCmp1", "AcceptedCmp2", "AcceptedCmp3",
                    "AcceptedCmp4", "AcceptedCmp5"]
LOW_SIGNAL_COLUMNS = ["Complain", "NumDealsPurchases", "NumWebVisitsMonth"]
CONSTANT_COLUMNS = ["Z_CostContact", "Z_Revenue"]
# -------------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)


def prep_age(df: DataFrame) -> DataFrame:
    """B1: Age = 2025 - Year_Birth, capped at 100; NULL stays NULL.

    ``least(NULL, 100)`` would be 100, so the cap is a CASE.
    """
    age = F.lit(REFERENCE_YEAR) - F.col("Year_Birth")
    return df.withColumn("Age", F.when(age > AGE_CAP, F.lit(AGE_CAP)).otherwise(age)
                         .cast("int")).drop("Year_Birth")


def parse_day_first(c: Column) -> Column:
    """B2: day-first date text to DATE; an invalid date gives NULL, not an error."""
    return F.try_to_date(c, DATE_FORMAT)


def prep_tenure(df: DataFrame) -> DataFrame:
    """Tenure_Days = latest enrolment date over all rows - own enrolment date."""
    parsed = df.withColumn("__dt", parse_day_first(F.col("Dt_Customer")))
    latest = parsed.agg(F.max("__dt").alias("__ref"))          # one row
    out = parsed.crossJoin(F.broadcast(latest))
    return (out.withColumn("Tenure_Days", F.datediff("__ref", "__dt"))
               .drop("__dt", "__ref", "Dt_Customer"))


def income_stats(df: DataFrame) -> tuple[float | None, float | None]:
    """Median of Income, then the 99th percentile after median imputation.

    The imputed column is the raw one with NULLs replaced by the median, so its
    99th percentile is computed on that expression directly.
    """
    med = exact_quantile(df, "Income", 0.5)
    filled = F.coalesce(F.col("Income"), F.lit(med).cast("double"))
    cap = exact_quantiles(df, {"f": filled}, [INCOME_CAP_QUANTILE])["f"][0]
    return med, cap


def prep_income(df: DataFrame, median: float | None = None, cap: float | None = None) -> DataFrame:
    """B4 + B5: median-impute Income, then cap it at its 99th percentile.

    Statistics may be passed in (fitted on a training split); by default they
    come from ``df`` itself, as the reference does.
    """
    if median is None or cap is None:
        median, cap = income_stats(df)
    filled = F.coalesce(F.col("Income"), F.lit(median).cast("double"))
    capped = F.when(filled > F.lit(cap), F.lit(cap).cast("double")).otherwise(filled)
    return df.withColumn("Income", capped)


def education_code(c: Column) -> Column:
    pairs = []
    for k, v in EDUCATION_ORDER.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(EDUCATION_DEFAULT)).cast("int")


def prep_education(df: DataFrame) -> DataFrame:
    """Ordinal Education; unknown or NULL -> 1."""
    return df.withColumn("Education", education_code(F.col("Education")))


def prep_marital(df: DataFrame) -> DataFrame:
    """Married / Together -> 1, anything else (NULL included) -> 0."""
    return df.withColumn("Marital_Status",
                         F.when(F.col("Marital_Status").isin(*PARTNERED), 1).otherwise(0))


def _row_sum(cols: list[str]) -> Column:
    total = None
    for c in cols:
        term = F.coalesce(F.col(c), F.lit(0))
        total = term if total is None else total + term
    return total


def prep_totals(df: DataFrame) -> DataFrame:
    """Horizontal sums; a missing part counts as 0 (pandas skipna sum)."""
    return (df.withColumn("TotalSpend", _row_sum(SPEND_COLUMNS).cast(MONEY))
              .withColumn("TotalPurchases", _row_sum(PURCHASE_COLUMNS).cast("long"))
              .withColumn("TotalAccepted", _row_sum(CAMPAIGN_COLUMNS).cast("int")))


def prep_children(df: DataFrame) -> DataFrame:
    """HasChildren = Kidhome + Teenhome > 0; NULL -> 0."""
    has = F.coalesce((F.col("Kidhome") + F.col("Teenhome")) > 0, F.lit(False))
    return df.withColumn("HasChildren", has.cast("int"))


def prep_drop(df: DataFrame, drop_constants: bool = True, keep_id: bool = True) -> DataFrame:
    """Drop low-signal columns (absent ones are ignored).

    ``keep_id`` keeps ID as a row key (it is never a feature, see
    ``operators.catalog.feature_list``). ``drop_constants`` drops Z_CostContact
    and Z_Revenue, which the reference means to drop but does not.
    """
    cols = list(LOW_SIGNAL_COLUMNS)
    if drop_constants:
        cols += CONSTANT_COLUMNS
    if not keep_id:
        cols.append("ID")
    return df.drop(*cols)


def prep_full(df: DataFrame, drop_constants: bool = True, keep_id: bool = True,
              income: tuple[float, float] | None = None) -> DataFrame:
    """The whole of B, in the reference's order."""
    out = prep_age(df)
    out = prep_tenure(out)
    out = prep_income(out, *(income or (None, None)))
    out = prep_education(out)
    out = prep_marital(out)
    out = prep_totals(out)
    out = prep_children(out)
    return prep_drop(out, drop_constants=drop_constants, keep_id=keep_id)


def median_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill NULLs of every listed column with that column's exact median."""
    meds = exact_quantiles(df, cols, [0.5])
    fills = {c: meds[c][0] for c in cols if meds[c][0] is not None}
    return df.select(*[
        (F.coalesce(F.col(f.name).cast("double"), F.lit(fills[f.name])).alias(f.name)
         if f.name in fills else F.col(f.name))
        for f in df.schema.fields])
