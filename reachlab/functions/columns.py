"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Doubles leave every query rounded to this many places so that the Spark
# result and the SQL oracle compare equal despite summation order.
DIGITS = 6


def r6(c: Column | str, digits: int = DIGITS) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def safe_div(num: Column, den: Column, default: Column | float | None = None) -> Column:
    """num / den, or ``default`` (NULL by default) when den is 0 or NULL.

    Written as a guarded CASE so that ANSI mode never sees a zero divisor.
    """
    d = F.lit(default) if not isinstance(default, Column) else default
    if default is None:
        d = F.lit(None).cast("double")
    return F.when(den.isNull() | (den == 0), d).otherwise(num.cast("double") / den)


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """Reproducible pseudo-random order key: md5 of the seed and the key(s).

    Same text on both engines (``md5(concat(seed, '|', key))``), so a seeded
    sample or split is identical in Spark and in the SQL oracle.
    """
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("|"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.md5(F.concat(*parts))


def hash_unit(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of ``hash_order``."""
    h = hash_order(seed, *keys)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numeric_columns(df: DataFrame, exclude: set[str] | frozenset[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def unpivot_numeric(df: DataFrame, cols: list[str], id_cols: list[str] | None = None,
                    name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to long (feature, value) rows, values as double."""
    ids = id_cols or []
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(ids, cols, name, value)
