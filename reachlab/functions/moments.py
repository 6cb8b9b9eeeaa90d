"""Pairwise-complete second moments of many columns in one pass.

Each task turns its Arrow batches into NumPy and emits one partial row of
sufficient statistics for every column pair (counts, sums, sums of squares
and cross products over rows where both columns are present, on data
centred by a per-column shift). The partials are summed by a grouped
aggregation keyed by statistic index, so the shuffle carries
(#batches x 5p^2) numbers, never rows. The driver receives the p x p totals
only -- bounded by the number of columns -- and finishes correlation or
covariance there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise_moments(df: DataFrame, cols: Sequence[str], shift: Sequence[float] | None = None) -> dict:
    """Return dict of p x p arrays: n, sa, sb, qa, qb, ab (pairwise complete).

    ``sa[i, j]`` is the sum of column i over rows where i and j are both
    present, ``qa`` the sum of squares, ``ab`` the sum of products; ``sb`` and
    ``qb`` are the transposes. Values are shifted by ``shift`` (e.g. the column
    means) before summing, which keeps the sums well conditioned.
    """
    cols = list(cols)
    p = len(cols)
    shift = np.zeros(p) if shift is None else np.asarray(shift, dtype=float)
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def partial(batches):
        acc = np.zeros((4, p, p))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            v = pdf.to_numpy(dtype=float, na_value=np.nan) - shift
            m = (~np.isnan(v)).astype(float)
            z = np.where(m > 0, v, 0.0)
            acc[0] += m.T @ m
            acc[1] += z.T @ m
            acc[2] += (z * z).T @ m
            acc[3] += z.T @ z
        if seen:
            yield pd.DataFrame({"s": [acc.ravel()]})

    parts = x.mapInPandas(partial, "s array<double>")
    summed = (parts.select(F.posexplode("s").alias("k", "v"))
                   .groupBy("k").agg(F.sum("v").alias("v")))
    flat = np.zeros(4 * p * p)
    for r in summed.collect():                         # 4 p^2 numbers
        flat[r["k"]] = r["v"]
    n, sa, qa, ab = flat.reshape(4, p, p)
    return {"n": n, "sa": sa, "sb": sa.T, "qa": qa, "qb": qa.T, "ab": ab}


def pearson_matrix(mom: dict) -> np.ndarray:
    """Pairwise-complete Pearson r from ``pairwise_moments``; NaN where undefined."""
    n, sa, sb, qa, qb, ab = (mom[k] for k in ("n", "sa", "sb", "qa", "qb", "ab"))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = n * ab - sa * sb
        va = n * qa - sa * sa
        vb = n * qb - sb * sb
        r = cov / np.sqrt(va * vb)
    r[(va <= 0) | (vb <= 0) | (n < 2)] = np.nan
    return np.clip(r, -1.0, 1.0)


def covariance_matrix(mom: dict) -> np.ndarray:
    """Population covariance from complete-case moments (no missing values)."""
    n, sa, sb, ab = mom["n"], mom["sa"], mom["sb"], mom["ab"]
    with np.errstate(divide="ignore", invalid="ignore"):
        return ab / n - (sa / n) * (sb / n)
