"""reachlab: campaign-response analytics as Spark jobs.

Every public operator is a ``DataFrame -> DataFrame`` function built on the
DataFrame / SQL / MLlib APIs so that Catalyst plans it and the work scales
with the number of customers.

Sub-packages
------------
sources    -- reading the star tables, the derived customer table, stores
functions  -- column expressions and scale-aware building blocks
              (exact quantiles, ordered running totals, hashing)
operators  -- the analytics: prep, profiling, split, models, evaluation,
              targeting, attribution, tuning, run log, conclusions
plans      -- the query registry used by ``__spark_entry__`` and its SQL oracle
"""

__all__ = ["session"]
