"""Exact quantiles by radix selection; no task and no driver ever holds a column.

Spark's exact ``percentile`` aggregate keeps a value -> count map of the whole
group in a single buffer, so a global median over billions of distinct incomes
lands in one task. This module finds the exact, linearly interpolated quantile (the
definition shared by pandas ``quantile``, Spark ``percentile`` and DuckDB
``quantile_cont``) digit by digit:

1. one aggregate counts each column's values, which fixes the ranks to find;
2. doubles become 64-bit integers of the same order (``order_key``, taken from the bits
   of an Arrow batch; as expressions, those of 26 columns are too long to be compiled).
   One partial aggregation counts, for all columns at once, the values per leading 16 bits:
   at most 65,536 counts a column, however many rows there are. A running sum over
   these counts names the digit that holds each rank;
3. the next 16 bits are counted among the values with that digit only, and so on:
   four passes at most, fewer where a digit holds a single value (integers, ties).

What reaches the driver is one row per requested rank and pass: a digit, how many
values lie before it, its least and largest value. Heavy ties, narrow bands and
long tails take the same four passes; nothing is sketched or sampled.

Small inputs take a shortcut after step 1: when all requested columns together hold
at most ``SMALL_TOTAL`` values, Spark's exact ``percentile`` finishes in one more
pass -- its value map is then bounded by that count.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

SMALL_TOTAL = 400_000
DIGIT_BITS = 16
# Fixed values of the 64-bit floating-point format.
_FRACTION_BITS = 52
_BIAS = 1023
_INFINITE = 2047 << _FRACTION_BITS


def order_key(x: Column) -> Column:
    """The double ``x`` as a 64-bit integer: a < b exactly if key(a) < key(b).

    For positive numbers it is the number's own bit pattern (exponent, then
    fraction), for negative ones its opposite. Both zeros are 0; infinities lie
    beyond all numbers and NaN beyond them (as Spark sorts it); NULL stays NULL.
    Every step is exact: powers of two, and quotients by them.
    """
    a = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(a)).cast("double")  # off by one at most, next to a power of two
    e = F.when(a < power(near), near - 1).when(a / 2 >= power(near), near + 1).otherwise(near)
    fraction = ((a / power(e) - 1) * float(1 << _FRACTION_BITS)).cast("long")
    normal = (e + _BIAS).cast("long") * F.lit(1 << _FRACTION_BITS) + fraction
    size = (F.when(F.isnan(x), F.lit(_INFINITE + 1)).when(a == float("inf"), F.lit(_INFINITE))
            .when(a < 2.0 ** -1022, (a / 2.0 ** -1074).cast("long")).otherwise(normal))
    return F.when(x.isNull(), F.lit(None).cast("long")).when(x < 0, -size).otherwise(size)


def key_value(key: int) -> float:
    """The double whose ``order_key`` is ``key``."""
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


@dataclass
class _Target:
    """One value to find: the ``rank``-th (from 0) among those that begin with ``prefix``."""

    column: int
    rank: int
    prefix: int = 0
    value: float | None = None


def _select(df: DataFrame, xs: Sequence[Column], targets: Sequence[_Target]) -> None:
    """Set each target's value, a digit of all of them per pass."""
    columns = sorted({t.column for t in targets})
    values = df.select(*[xs[c].alias(f"x{c}") for c in columns])
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        left = [t for t in targets if t.value is None]
        if not left:
            return
        for t, found in _digit(values, left, shift):
            t.rank -= found["before"]
            t.prefix = found["digit"]
            if found["least"] == found["largest"]:
                t.value = key_value(found["least"])


def _digit(values: DataFrame, targets: list[_Target], shift: int) -> list[tuple[_Target, Row]]:
    """For each target the digit (with all before it) that holds its rank."""
    first = shift + DIGIT_BITS == 64
    prefixes = {c: sorted({t.prefix for t in targets if t.column == c}) for c in sorted({t.column for t in targets})}

    def keys(x: np.ndarray) -> np.ndarray:      # ``order_key`` of an array
        bits = np.ascontiguousarray(x, dtype=np.float64).view(np.int64)
        signed = np.where(bits < 0, -(bits & np.int64(2**63 - 1)), bits)
        return np.where(np.isnan(x), np.int64(_INFINITE + 1), signed)

    def count(batches):
        for batch in batches:
            parts = []
            for i, (c, begins) in enumerate(prefixes.items()):
                k = keys(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                k = np.sort(k if first else k[np.isin(k >> (shift + DIGIT_BITS), begins)])
                digit = k >> shift
                starts = np.flatnonzero(np.diff(digit, prepend=digit[:1] - 1))
                ends = np.append(starts[1:], len(k))[:len(starts)]
                parts.append((np.full(len(starts), c, dtype=np.int32), digit[starts], ends - starts, k[starts], k[ends - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts)],
                                             names=["c", "digit", "n", "least", "largest"])

    counts = values.select(*[f"x{c}" for c in prefixes]).mapInArrow(
        count, "c int, digit long, n long, least long, largest long").groupBy("c", "digit").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    counts = counts.withColumn("prefix", F.lit(0).cast("long") if first else F.shiftright("digit", DIGIT_BITS))
    # at most 2^DIGIT_BITS counts per column and prefix
    so_far = Window.partitionBy("c", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("before", F.sum("n").over(so_far) - F.col("n"))
    wanted = values.sparkSession.createDataFrame(
        [(i, t.column, t.prefix, t.rank) for i, t in enumerate(targets)], "t int, wc int, wp long, rank long")
    held = counts.join(F.broadcast(wanted), (F.col("c") == F.col("wc")) & (F.col("prefix") == F.col("wp"))  # #ranks rows
                       & (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    return [(targets[r["t"]], r) for r in _read(held.select("t", "digit", "before", "least", "largest"))]


def _read(rows: DataFrame) -> list[Row]:
    """The only rows that come to the driver: one per rank to find."""
    return rows.collect()


def exact_quantiles(df: DataFrame, exprs: Mapping[str, Column] | Sequence[str],
                    probs: Sequence[float], small_total: int | None = None,
                    extra: Mapping[str, Column] | None = None) -> dict[str, list[float | None]]:
    """Return ``{name: [q(p) for p in probs]}``; None where a column has no values.

    ``exprs`` maps a name to a numeric Column (or is a list of column names);
    NULLs are ignored, as in every engine's quantile. ``extra`` aggregate
    columns are computed in the first pass (same scan) and returned under the
    key ``"__extra"`` as a dict.
    """
    if not isinstance(exprs, Mapping):
        exprs = {c: F.col(c) for c in exprs}
    names = list(exprs)
    xs = [exprs[n].cast("double") for n in names]
    probs = [float(p) for p in probs]
    extra = dict(extra or {})
    row = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                 *[c.alias(f"x_{i}") for i, c in enumerate(extra.values())]).first()

    result: dict = {n: [None] * len(probs) for n in names}
    if extra:
        result["__extra"] = {k: row[f"x_{i}"] for i, k in enumerate(extra)}
    live = [i for i in range(len(names)) if row[f"n{i}"]]
    if not live or not probs:
        return result
    if sum(row[f"n{i}"] for i in live) <= (SMALL_TOTAL if small_total is None else small_total):
        got = df.agg(*[F.percentile(xs[i], F.array(*[F.lit(p) for p in probs])).alias(f"e{i}") for i in live]).first()
        for i in live:
            result[names[i]] = [float(v) for v in got[f"e{i}"]]
        return result

    places = {(i, j): (row[f"n{i}"] - 1) * p for i in live for j, p in enumerate(probs)}
    ranks = sorted({(i, r) for (i, _), h in places.items() for r in (math.floor(h), math.ceil(h))})
    targets = {(i, r): _Target(i, r) for i, r in ranks}
    _select(df, xs, list(targets.values()))
    for (i, j), h in places.items():
        low, high = targets[i, math.floor(h)].value, targets[i, math.ceil(h)].value
        result[names[i]][j] = low if low == high else low + (high - low) * (h - math.floor(h))
    return result


def exact_quantile(df: DataFrame, col: str | Column, p: float) -> float | None:
    expr = F.col(col) if isinstance(col, str) else col
    return exact_quantiles(df, {"x": expr}, [p])["x"][0]
