"""DuckDB CTE prefixes shared by the oracle queries.

Written independently of the Spark code from the recipes in FIXTURES.md, so
that a Spark query and its oracle agree only if both follow the recipe.
"""

from __future__ import annotations

_SPEND = [("MntWines", "STANDARD"), ("MntFruits", "ECONOMY"), ("MntMeatProducts", "MEDIUM"),
          ("MntFishProducts", "SMALL"), ("MntSweetProducts", "LARGE"), ("MntGoldProds", "PROMO")]
_CHANNEL = [("NumWebPurchases", "N"), ("NumCatalogPurchases", "R"), ("NumStorePurchases", "A")]
_COUNTS = ["NumDealsPurchases"] + [c for c, _ in _CHANNEL]


def _lines(items):
    return ",\n    ".join(items)


RAW_CTES = f"""
cutoff_t AS (SELECT max(o_orderdate) - INTERVAL 40 DAY AS cutoff FROM orders),
per_order AS (
  SELECT l_orderkey,
    {_lines(f"sum(CASE WHEN p_type = '{t}' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS {c}" for c, t in _SPEND)},
    count(CASE WHEN l_discount > 0.08 THEN 1 END) AS NumDealsPurchases,
    {_lines(f"count(CASE WHEN l_returnflag = '{f}' THEN 1 END) AS {c}" for c, f in _CHANNEL)}
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey),
dated AS (
  SELECT o.*, k.cutoff, o.o_orderdate <= k.cutoff AS is_before
  FROM orders o CROSS JOIN cutoff_t k),
per_customer AS (
  SELECT o_custkey,
    min(CASE WHEN is_before THEN o_orderdate END) AS first_order,
    max(CASE WHEN is_before THEN o_orderdate END) AS last_order,
    any_value(cutoff) AS cutoff,
    {_lines(f"sum(CASE WHEN is_before THEN {c} END) AS {c}" for c, _ in _SPEND)},
    {_lines(f"sum(CASE WHEN is_before THEN {c} END) AS {c}" for c in _COUNTS)},
    {_lines(f"max(CASE WHEN is_before AND o_orderstatus = 'F' AND o_totalprice > 250000 AND starts_with(o_orderpriority, '{i}-') THEN 1 ELSE 0 END) AS AcceptedCmp{i}" for i in range(1, 6))},
    max(CASE WHEN NOT is_before THEN 1 ELSE 0 END) AS Response
  FROM dated LEFT JOIN per_order ON o_orderkey = l_orderkey
  GROUP BY o_custkey),
per_user AS (
  SELECT user_id,
    count(CASE WHEN event_type = 'view' THEN 1 END) AS NumWebVisitsMonth,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS Complain
  FROM events GROUP BY user_id),
campaign_raw AS (
  SELECT
    CAST(c_custkey AS BIGINT) AS ID,
    CAST(1890 + ((c_custkey * 37) % 110) AS INTEGER) AS Year_Birth,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'Basic' WHEN 'AUTOMOBILE' THEN 'Graduation'
      WHEN 'HOUSEHOLD' THEN '2n Cycle' WHEN 'FURNITURE' THEN 'Master'
      WHEN 'BUILDING' THEN 'PhD' END AS Education,
    CASE c_nationkey % 5 WHEN 0 THEN 'Married' WHEN 1 THEN 'Together' WHEN 2 THEN 'Single'
      WHEN 3 THEN 'Divorced' WHEN 4 THEN 'Widow' END AS Marital_Status,
    CASE WHEN isnan(c_acctbal) OR c_acctbal < 0 THEN NULL ELSE c_acctbal * 10.0 END AS Income,
    CAST(c_custkey % 3 AS INTEGER) AS Kidhome,
    CAST(c_custkey % 2 AS INTEGER) AS Teenhome,
    strftime(first_order, '%d-%m-%Y') AS Dt_Customer,
    CAST(date_diff('day', CAST(last_order AS DATE), CAST(cutoff AS DATE)) AS INTEGER) AS Recency,
    {_lines(f"CAST(coalesce({c}, 0) AS DECIMAL(18,2)) AS {c}" for c, _ in _SPEND)},
    {_lines(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS)},
    CAST(coalesce(NumWebVisitsMonth, 0) AS BIGINT) AS NumWebVisitsMonth,
    {_lines(f"CAST(coalesce(AcceptedCmp{i}, 0) AS INTEGER) AS AcceptedCmp{i}" for i in (3, 4, 5, 1, 2))},
    CAST(coalesce(Complain, 0) AS INTEGER) AS Complain,
    CAST(3 AS INTEGER) AS Z_CostContact,
    CAST(11 AS INTEGER) AS Z_Revenue,
    CAST(coalesce(Response, 0) AS INTEGER) AS Response
  FROM customer
  LEFT JOIN per_customer ON c_custkey = o_custkey
  LEFT JOIN per_user ON c_custkey = user_id)"""

_PREP_KEEP = (["ID", "Education_c AS Education", "Marital_c AS Marital_Status", "Income_c AS Income",
               "Kidhome", "Teenhome", "Recency"] + [c for c, _ in _SPEND]
              + [c for c, _ in _CHANNEL] + [f"AcceptedCmp{i}" for i in (3, 4, 5, 1, 2)]
              + ["Response"])

PREP_CTES = RAW_CTES + f""",
prep_a AS (
  SELECT *,
    CASE WHEN 2025 - Year_Birth > 100 THEN 100 ELSE 2025 - Year_Birth END AS Age_c,
    CAST(try_strptime(Dt_Customer, '%d-%m-%Y') AS DATE) AS dt_c
  FROM campaign_raw),
inc_med AS (SELECT quantile_cont(Income, 0.5) AS med FROM campaign_raw),
inc_cap AS (SELECT quantile_cont(coalesce(Income, med), 0.99) AS cap FROM campaign_raw, inc_med),
prep_b AS (
  SELECT prep_a.*,
    CASE WHEN coalesce(Income, med) > cap THEN cap ELSE coalesce(Income, med) END AS Income_c,
    CAST(coalesce(CASE Education WHEN 'Basic' THEN 0 WHEN 'Graduation' THEN 1 WHEN '2n Cycle' THEN 1
      WHEN 'Master' THEN 2 WHEN 'PhD' THEN 3 END, 1) AS INTEGER) AS Education_c,
    CASE WHEN Marital_Status IN ('Married', 'Together') THEN 1 ELSE 0 END AS Marital_c,
    CAST(date_diff('day', dt_c, (SELECT max(dt_c) FROM prep_a)) AS INTEGER) AS Tenure_c
  FROM prep_a, inc_med, inc_cap),
prepared AS (
  SELECT {", ".join(_PREP_KEEP)},
    CAST(Age_c AS INTEGER) AS Age,
    Tenure_c AS Tenure_Days,
    CAST({" + ".join(f"coalesce({c}, 0)" for c, _ in _SPEND)} AS DECIMAL(18,2)) AS TotalSpend,
    CAST({" + ".join(f"coalesce({c}, 0)" for c, _ in _CHANNEL)} AS BIGINT) AS TotalPurchases,
    CAST({" + ".join(f"coalesce(AcceptedCmp{i}, 0)" for i in range(1, 6))} AS INTEGER) AS TotalAccepted,
    CAST(coalesce(Kidhome + Teenhome > 0, false) AS INTEGER) AS HasChildren
  FROM prep_b)"""

SCORES_CTE = """
scores AS (
  SELECT 'hash_a' AS model, ID AS id, Response AS label,
         CAST(((ID * 7919) % 1000 + 300 * Response) / 1300.0 AS DOUBLE) AS p FROM campaign_raw
  UNION ALL
  SELECT 'hash_b' AS model, ID AS id, Response AS label,
         CAST(((ID * 104729) % 100 + 10 * Response) / 110.0 AS DOUBLE) AS p FROM campaign_raw)"""
SCORES_CTES = RAW_CTES + "," + SCORES_CTE


def with_raw(body: str) -> str:
    return f"WITH RECURSIVE {RAW_CTES}\n{body}"


def with_prep(body: str, extra: str = "") -> str:
    return f"WITH {PREP_CTES}{extra}\n{body}"


def with_scores(body: str, extra: str = "") -> str:
    return f"WITH {SCORES_CTES}{extra}\n{body}"

# model features of the prepared table (numeric, not the key, not the target)
PREP_FEATURES = (["Education", "Marital_Status", "Income", "Kidhome", "Teenhome", "Recency"]
                 + [c for c, _ in _SPEND] + [c for c, _ in _CHANNEL]
                 + [f"AcceptedCmp{i}" for i in (3, 4, 5, 1, 2)]
                 + ["Age", "Tenure_Days", "TotalSpend", "TotalPurchases", "TotalAccepted",
                    "HasChildren"])
