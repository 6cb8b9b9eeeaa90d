"""Conclusions (J1, J2): one-pass summaries of the prepared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlab.functions.columns import r6, safe_div


def campaign_summary(df: DataFrame, target: str = "Response") -> DataFrame:
    """Customers, responders, response rate and imbalance (1 - r) / r."""
    y = F.col(target).cast("double")
    agg = df.agg(F.count(F.lit(1)).alias("n_customers"),
                 F.sum(y).cast("long").alias("n_responders"),
                 F.avg(y).alias("rate"))
    rate = F.col("rate")
    return agg.select("n_customers", "n_responders", r6(rate).alias("response_rate"),
                      r6(safe_div(1 - rate, rate)).alias("imbalance"))


def responder_contrast(df: DataFrame, target: str = "Response") -> DataFrame:
    """Mean TotalSpend / TotalAccepted / Income for responders vs the rest.

    A missing column gives 0.0; spend lift is 1.0 when the non-responder mean
    is not positive.
    """
    cols = set(df.columns)
    pos = F.col(target) == 1
    neg = F.col(target) == 0

    def means(c: str):
        if c not in cols:
            return F.lit(0.0), F.lit(0.0)
        x = F.col(c).cast("double")
        return (F.coalesce(F.avg(F.when(pos, x)), F.lit(0.0)),
                F.coalesce(F.avg(F.when(neg, x)), F.lit(0.0)))

    sr, sn = means("TotalSpend")
    ar, an = means("TotalAccepted")
    ir, inn = means("Income")
    agg = df.agg(sr.alias("spend_resp"), sn.alias("spend_non"), ar.alias("accepted_resp"),
                 an.alias("accepted_non"), ir.alias("income_resp"), inn.alias("income_non"))
    lift = F.when(F.col("spend_non") > 0, F.col("spend_resp") / F.col("spend_non")).otherwise(1.0)
    return agg.select(*[r6(c).alias(c) for c in agg.columns], r6(lift).alias("spend_lift"))
