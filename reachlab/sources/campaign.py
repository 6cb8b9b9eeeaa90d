"""The customer table every operator works on.

``campaign_raw`` derives one row per customer with the 29-column raw schema of
the marketing-campaign data set from the star tables (customer, orders,
lineitem, part, events). The recipe is in FIXTURES.md section 2.

Plan shape (checked with ``explain``): lineitem is joined to part on partkey
and pre-aggregated per order; orders join that per-order result on orderkey
(the aggregate is already hash-partitioned by it) and aggregate per customer;
events are aggregated per user before their join. Every join after the first
is therefore one row per key on both sides, so a customer holding a third of
all orders costs one partial-aggregate row per map task, not a skewed join.
The cut-off date is a one-row aggregate joined with an explicit broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlab.sources.tables import read_table

# --- fixed values of the derived table (FIXTURES.md section 2) ---------------
# Spend categories: output column and the part type whose line items feed it.
SPEND_COLUMNS = [
    ("MntWines", "STANDARD"),
    ("MntFruits", "ECONOMY"),
    ("MntMeatProducts", "MEDIUM"),
    ("MntFishProducts", "SMALL"),
    ("MntSweetProducts", "LARGE"),
    ("MntGoldProds", "PROMO"),
]
# Purchase channels: output column and the line-item return flag that feeds it.
CHANNEL_COLUMNS = [
    ("NumWebPurchases", "N"),
    ("NumCatalogPurchases", "R"),
    ("NumStorePurchases", "A"),
]
# Market segment to education level.
EDUCATION_BY_SEGMENT = {
    "MACHINERY": "Basic",
    "AUTOMOBILE": "Graduation",
    "HOUSEHOLD": "2n Cycle",
    "FURNITURE": "Master",
    "BUILDING": "PhD",
}
# c_nationkey mod 5 to marital status.
MARITAL_BY_NATION_MOD5 = ["Married", "Together", "Single", "Divorced", "Widow"]
CUTOFF_DAYS = 40
DEAL_DISCOUNT = 0.08
CAMPAIGN_PRICE = 250000.0
Z_COST_CONTACT = 3
Z_REVENUE = 11
# -----------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)

# Column order of the raw marketing file.
RAW_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("Year_Birth", T.IntegerType()),
    T.StructField("Education", T.StringType()),
    T.StructField("Marital_Status", T.StringType()),
    T.StructField("Income", T.DoubleType()),
    T.StructField("Kidhome", T.IntegerType()),
    T.StructField("Teenhome", T.IntegerType()),
    T.StructField("Dt_Customer", T.StringType()),
    T.StructField("Recency", T.IntegerType()),
    *[T.StructField(c, MONEY) for c, _ in SPEND_COLUMNS],
    T.StructField("NumDealsPurchases", T.LongType()),
    *[T.StructField(c, T.LongType()) for c, _ in CHANNEL_COLUMNS],
    T.StructField("NumWebVisitsMonth", T.LongType()),
    T.StructField("AcceptedCmp3", T.IntegerType()),
    T.StructField("AcceptedCmp4", T.IntegerType()),
    T.StructField("AcceptedCmp5", T.IntegerType()),
    T.StructField("AcceptedCmp1", T.IntegerType()),
    T.StructField("AcceptedCmp2", T.IntegerType()),
    T.StructField("Complain", T.IntegerType()),
    T.StructField("Z_CostContact", T.IntegerType()),
    T.StructField("Z_Revenue", T.IntegerType()),
    T.StructField("Response", T.IntegerType()),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]
TARGET = "Response"


def _map_expr(mapping: dict, key: Column) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[key]


def _flag(cond: Column) -> Column:
    return F.max(F.when(cond, 1).otherwise(0))


def campaign_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, 29 raw columns; see module docstring."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                        "o_totalprice", "o_orderdate", "o_orderpriority")
    lineitem = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey",
                          "l_extendedprice", "l_discount", "l_returnflag")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey",
                          "c_acctbal", "c_mktsegment")
    events = read_table(spark, sf_dir, "events", "user_id", "event_type")

    # one row: the campaign cut-off; size is fixed, so broadcasting it is safe
    cutoff = orders.agg(F.expr(f"max(o_orderdate) - INTERVAL {CUTOFF_DAYS} DAYS").alias("cutoff"))

    # line items -> per-order partial sums (one row per order)
    priced = lineitem.join(part, lineitem.l_partkey == part.p_partkey, "left")
    money = F.col("l_extendedprice").cast(MONEY)
    per_order = priced.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("p_type") == t, money)).alias(c) for c, t in SPEND_COLUMNS],
        F.count(F.when(F.col("l_discount") > DEAL_DISCOUNT, 1)).alias("NumDealsPurchases"),
        *[F.count(F.when(F.col("l_returnflag") == f, 1)).alias(c) for c, f in CHANNEL_COLUMNS],
    )

    dated = orders.crossJoin(F.broadcast(cutoff)).withColumn(
        "before", F.col("o_orderdate") <= F.col("cutoff"))
    joined = dated.join(per_order, dated.o_orderkey == per_order.l_orderkey, "left")
    before = F.col("before")
    campaign_hit = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > CAMPAIGN_PRICE)
    count_cols = ["NumDealsPurchases"] + [c for c, _ in CHANNEL_COLUMNS]
    per_customer = joined.groupBy("o_custkey").agg(
        F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
        F.max(F.when(before, F.col("o_orderdate"))).alias("last_order"),
        F.first("cutoff").alias("cutoff"),
        *[F.sum(F.when(before, F.col(c))).alias(c) for c, _ in SPEND_COLUMNS],
        *[F.sum(F.when(before, F.col(c))).alias(c) for c in count_cols],
        *[_flag(before & campaign_hit & F.col("o_orderpriority").startswith(f"{i}-"))
          .alias(f"AcceptedCmp{i}") for i in range(1, 6)],
        _flag(~before).alias("Response"),
    )

    per_user = events.groupBy("user_id").agg(
        F.count(F.when(F.col("event_type") == "view", 1)).alias("NumWebVisitsMonth"),
        _flag(F.col("event_type") == "error").alias("Complain"),
    )

    c = customer
    out = (c.join(per_customer, c.c_custkey == per_customer.o_custkey, "left")
            .join(per_user, c.c_custkey == per_user.user_id, "left"))

    key = F.col("c_custkey")
    acct = F.col("c_acctbal")
    income = F.when(F.isnan(acct) | (acct < 0), F.lit(None).cast("double")).otherwise(acct * 10.0)
    marital = F.element_at(F.array(*[F.lit(m) for m in MARITAL_BY_NATION_MOD5]),
                           F.pmod(F.col("c_nationkey"), F.lit(5)) + 1)
    cols = {
        "ID": key.cast("long"),
        "Year_Birth": (F.lit(1890) + F.pmod(key * 37, F.lit(110))).cast("int"),
        "Education": _map_expr(EDUCATION_BY_SEGMENT, F.col("c_mktsegment")),
        "Marital_Status": marital,
        "Income": income,
        "Kidhome": F.pmod(key, F.lit(3)).cast("int"),
        "Teenhome": F.pmod(key, F.lit(2)).cast("int"),
        "Dt_Customer": F.date_format(F.col("first_order"), "dd-MM-yyyy"),
        "Recency": F.datediff(F.to_date("cutoff"), F.to_date("last_order")).cast("int"),
        **{c_: F.coalesce(F.col(c_), F.lit(0)).cast(MONEY) for c_, _ in SPEND_COLUMNS},
        **{c_: F.coalesce(F.col(c_), F.lit(0)).cast("long") for c_ in count_cols},
        "NumWebVisitsMonth": F.coalesce(F.col("NumWebVisitsMonth"), F.lit(0)).cast("long"),
        **{f"AcceptedCmp{i}": F.coalesce(F.col(f"AcceptedCmp{i}"), F.lit(0)).cast("int")
           for i in range(1, 6)},
        "Complain": F.coalesce(F.col("Complain"), F.lit(0)).cast("int"),
        "Z_CostContact": F.lit(Z_COST_CONTACT).cast("int"),
        "Z_Revenue": F.lit(Z_REVENUE).cast("int"),
        "Response": F.coalesce(F.col("Response"), F.lit(0)).cast("int"),
    }
    return out.select(*[cols[n].alias(n) for n in RAW_COLUMNS])


def read_campaign_file(spark: SparkSession, path: str, fmt: str = "tsv") -> DataFrame:
    """A1: load the raw table from a tab-separated file with header, or parquet.

    An explicit schema avoids an inference pass over the whole file. A line that
    does not fit it fails the read instead of becoming NULLs. NaN in floating
    columns becomes NULL so that later operators see one kind of missing value.
    """
    if fmt in ("tsv", "csv"):
        sep = "\t" if fmt == "tsv" else ","
        df = spark.read.csv(path, sep=sep, header=True, schema=RAW_SCHEMA, mode="FAILFAST")
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    fixed = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixed.append(F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            fixed.append(F.col(f.name))
    return df.select(*fixed)


def write_campaign_file(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Sink: write the raw table as TSV with header, or as parquet."""
    if fmt == "tsv":
        df.write.mode("overwrite").csv(path, sep="\t", header=True)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
