"""Exact running totals over an ordered column, without a one-partition window.

Ranking curves (ROC, precision-recall, deciles) need, for every distinct score,
the sum of some counts over all scores ranked above it. A window with only
``orderBy`` puts the whole table in one task. Here the input is first reduced
to one row per distinct (group, score); the score axis is then cut into ranges
of roughly equal row count, per-range totals give each range's starting offset,
and the running window is evaluated per (group, range). Each task then holds
about ``ROWS_PER_TASK`` rows, and the result is exact: the ranges only decide
where work is split, not what is summed.

NULL groups are groups and NULL scores are values: they take the place that
Spark's ``orderBy`` gives them (first when ascending, last when descending), on
every size of input. One range is the same plan without cut points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
# Cut points that one job finds; larger inputs are cut again inside each range.
MAX_CUTS = 10_000


def same_values(left: DataFrame, right: DataFrame, cols: Sequence[str], suffix: str) -> Column:
    """Null-safe equality of ``cols`` with the columns of ``right`` named with ``suffix``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c + suffix])
    return cond


def _place(value: Column, cuts: Column) -> Column:
    """Number of cut points below ``value``; NULL goes before all (-1).

    Binary search by a fold over the sorted array would need a UDF; counting
    with ``filter`` is built in and the array is short.
    """
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda c: c < value)))


def _with_range(df: DataFrame, order_col: str, n: int, rows_per_task: int) -> DataFrame:
    """Add ``__range``, ascending with ``order_col``, of about rows_per_task / 4 rows each.

    Values are only compared with cut points, as doubles; equal doubles share a
    range, so ties of the cast never separate rows of one value.
    """
    x = F.col(order_col).cast("double")
    n_ranges = math.ceil(4 * n / rows_per_task)
    if n_ranges <= 1:
        return df.withColumn("__range", F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    first = min(MAX_CUTS, n_ranges)
    probs = [i / first for i in range(1, first)]
    cuts = df.agg(F.percentile_approx(x, probs, max(10_000, 10 * first)).alias("c")).first()["c"] or []
    cuts = sorted({float(c) for c in cuts})
    # the Bucketizer's ranges [a, b): a binary search in the JVM, at any number of cuts
    from pyspark.ml.feature import Bucketizer
    splits = [-math.inf, *(c for c in cuts if math.isfinite(c)), math.inf]
    out = Bucketizer(splits=splits, inputCol="__x", outputCol="__range", handleInvalid="keep").transform(
        df.withColumn("__x", x)).withColumn(
        "__range", F.when(F.col("__x").isNull(), F.lit(-1)).otherwise(F.col("__range")).cast("long"))
    second = min(MAX_CUTS, math.ceil(n_ranges / first))
    if second > 1:
        probs = [i / second for i in range(1, second)]
        inner = out.groupBy("__range").agg(
            F.array_sort(F.array_distinct(F.percentile_approx("__x", probs, max(10_000, 10 * second)))).alias("__cuts")
        ).withColumnRenamed("__range", "__range_c")
        out = out.join(inner, F.col("__range") == F.col("__range_c")).withColumn(
            "__range", F.col("__range") * F.lit(MAX_CUTS + 2) + F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
                _place(F.col("__x"), F.col("__cuts")) + 1)).drop("__range_c", "__cuts")
    return out.drop("__x")


def running_totals(df: DataFrame, group_cols: Sequence[str], order_col: str,
                   sum_cols: Sequence[str], descending: bool = True,
                   rows_per_task: int | None = None, prefix: str = "cum_",
                   n_rows: int | None = None) -> DataFrame:
    """Add ``{prefix}{c}``: inclusive running sum of ``c`` in ``order_col`` order.

    ``df`` must hold at most one row per (group_cols, order_col) value, so rows
    with tied scores were already combined and the running sum steps once per
    distinct score. ``n_rows`` (the row count of ``df``, if the caller already
    knows it) saves the counting job.
    """
    group_cols = list(group_cols)
    rows_per_task = rows_per_task or ROWS_PER_TASK
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    n = df.count() if n_rows is None else n_rows
    whole = Window.partitionBy(*group_cols).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if n <= rows_per_task:  # one range: no offsets to add
        return df.select("*", *[F.sum(c).over(whole).alias(prefix + c) for c in sum_cols])

    ranged = _with_range(df, order_col, n, rows_per_task)
    rng = F.col("__range").desc() if descending else F.col("__range").asc()
    totals = ranged.groupBy(*group_cols, "__range").agg(
        *[F.sum(c).alias("__t_" + c) for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group_cols, "__range"]
    offsets = totals.select(*[F.col(c).alias(c + "__k") for c in keys],
                            *[F.coalesce(F.sum("__t_" + c).over(before), F.lit(0))
                              .alias("__o_" + c) for c in sum_cols])
    # offsets has (#groups x #ranges) rows; AQE broadcasts it when its
    # measured size is under the broadcast threshold, otherwise shuffles
    joined = ranged.join(offsets, same_values(ranged, offsets, keys, "__k"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*[ranged[c] for c in df.columns],
                         *[(F.col("__o_" + c) + F.sum(c).over(w)).alias(prefix + c) for c in sum_cols])


def rank_within(df: DataFrame, group_cols: Sequence[str], order_col: str, tie_col: str,
                descending: bool = False, out: str = "row_rank",
                rows_per_task: int | None = None) -> DataFrame:
    """1-based row number within each group, ordered by ``order_col`` then
    ``tie_col`` ascending -- the same as ``row_number() OVER (PARTITION BY
    group ORDER BY order_col, tie_col)`` but without putting a group in one
    task: rank = (#rows ordered strictly before this value) + (position among
    rows sharing the value), both from ``running_totals``.
    """
    group_cols = list(group_cols)
    rows_per_task = rows_per_task or ROWS_PER_TASK
    n = df.count()
    if n <= rows_per_task:
        # every group fits one task: the definition itself
        order = F.col(order_col).desc() if descending else F.col(order_col).asc()
        w = Window.partitionBy(*group_cols).orderBy(order, F.col(tie_col).asc())
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    keys = list(dict.fromkeys([*group_cols, order_col]))
    ties = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    before = running_totals(ties, group_cols, order_col, ["__c"], descending=descending,
                            rows_per_task=rows_per_task).select(
        *[F.col(c).alias(c + "__b") for c in keys], (F.col("cum___c") - F.col("__c")).alias("__before"))
    within = running_totals(df.withColumn("__one", F.lit(1).cast("long")), keys, tie_col, ["__one"],
                            descending=False, rows_per_task=rows_per_task, n_rows=n)
    joined = within.join(before, same_values(within, before, keys, "__b"))
    return joined.select(*[within[c] for c in df.columns], (F.col("__before") + F.col("cum___one")).alias(out))
