"""Profiling and exploration.

Plan shapes, for a table of any size:

* per-column statistics are one pass: either a wide aggregate (one row per
  task leaves the map side) or ``unpivot`` + ``groupBy(feature)`` whose partial
  aggregation also leaves one row per (task, feature);
* quantiles (describe, box, IQR) come from ``functions.quantiles``, which never
  holds a whole column in one task;
* distinct counts group by (feature, value) with partial aggregation;
* duplicate detection shuffles an 8-byte row hash first and compares whole
  rows only inside colliding hash groups;
* what reaches the driver is bounded by the number of features (constant
  checks, quantile values, the p x p covariance block for VIF).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachlab.functions.columns import numeric_columns, r6, safe_div, unpivot_numeric
from reachlab.functions.quantiles import exact_quantiles

# --- fixed values of the reference's explorer ---------------------------------
NON_FEATURES = {"ID", "Z_CostContact", "Z_Revenue"}
MAX_UNIQUE_INT = 5
DEFAULT_BINS = 30
IQR_K = 1.5
Z_THRESHOLD = 3.0
SEVERITY_LOW_PCT = 1.0
SEVERITY_MEDIUM_PCT = 5.0
SCREEN_DISTINCT = 50          # HLL screen: above this a feature is surely continuous
FILTER_BITS = 28             # bits (as a power of two) that mark fingerprints of repeated rows
MINUS = "−"
# -------------------------------------------------------------------------------


def explorer_features(df: DataFrame, target: str = "Response") -> list[str]:
    """Numeric columns except the target and the identifier / constants."""
    return [c for c in numeric_columns(df, exclude={target}) if c not in NON_FEATURES]


def _long(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return unpivot_numeric(df, list(features), list(keep))


# C1 -----------------------------------------------------------------------------
def profile_overview(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(features)).alias("n_features"))


# C2 -----------------------------------------------------------------------------
def profile_describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max per feature.

    The moments ride along in the quantile helper's first pass, so the whole
    table is scanned once for them; the result has one row per feature.
    """
    spark = df.sparkSession
    extra = {}
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        extra.update({f"c{i}": F.count(x), f"m{i}": F.avg(x), f"s{i}": F.stddev_samp(x),
                      f"lo{i}": F.min(x), f"hi{i}": F.max(x)})
    q = exact_quantiles(df, list(features), [0.25, 0.5, 0.75], extra=extra)
    st = q["__extra"]
    rows = [(f, int(st[f"c{i}"]), st[f"m{i}"], st[f"s{i}"], st[f"lo{i}"], *q[f], st[f"hi{i}"])
            for i, f in enumerate(features)]
    out = spark.createDataFrame(rows, "feature string, count long, mean double, std double, min double, "
                                      "q25 double, q50 double, q75 double, max double")
    return out.select("feature", "count", *[r6(c).alias(c) for c in
                                            ("mean", "std", "min", "q25", "q50", "q75", "max")])


# C3 / C4 / C5 / C6 ----------------------------------------------------------------
def profile_missing(df: DataFrame) -> DataFrame:
    """Missing count and % (half-even to 2 places) for every column."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "missing")
    return long.select("column", "missing",
                       F.bround(F.col("missing") / F.col("__n") * 100.0, 2).alias("missing_pct"))


def profile_completeness(df: DataFrame) -> DataFrame:
    """(1 - mean over columns of the column's null rate) x 100."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    rates = wide.unpivot(["__n"], cols, "column", "missing").select(
        (F.col("missing") / F.col("__n")).alias("rate"))
    return rates.agg(r6((1 - F.avg("rate")) * 100.0).alias("completeness_pct"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows (NULLs equal).

    The first grouping shuffles an 8-byte fingerprint per row. Those that repeat set
    bits of a filter (2^28 bits in pieces of 4 KB, so 32 MB at most), which goes to a
    second scan; only rows whose bit is set are shuffled whole and compared. The
    filter lets through a few rows too many, never one too few, and equal
    fingerprints of unlike rows do no harm, as whole rows are compared.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    place = F.pmod(F.xxhash64(*cols), F.lit(1 << FILTER_BITS)).alias("place")
    repeated = df.select(F.xxhash64(*cols).alias("h")).groupBy("h").count().where(F.col("count") > 1) \
        .select(F.pmod("h", F.lit(1 << FILTER_BITS)).alias("place"))
    pieces = repeated.groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)], place)
    bit = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # at most 2^FILTER_BITS / 32,768 pieces of 4 KB
    maybe = rows.join(F.broadcast(pieces), F.bitmap_bucket_number("place") == F.col("piece")) \
        .where(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    groups = maybe.groupBy("place", *[f"c{i}" for i in range(len(cols))]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long")
                      .alias("duplicates"))


def profile_report(df: DataFrame) -> DataFrame:
    """Observations, variables, missing cells and %, duplicates, numeric columns."""
    cols = df.columns
    n_numeric = len(numeric_columns(df))
    cells = df.agg(F.count(F.lit(1)).alias("observations"),
                   sum((F.count(F.when(F.col(c).isNull(), 1)) for c in cols), F.lit(0))
                   .cast("long").alias("missing_cells"))
    dup = duplicate_rows(df)
    out = cells.crossJoin(dup)                             # 1 row x 1 row
    return out.select(
        "observations", F.lit(len(cols)).alias("variables"), "missing_cells",
        r6(safe_div(F.col("missing_cells") * 100.0,
                    F.col("observations") * F.lit(len(cols)), 0.0)).alias("missing_pct"),
        "duplicates", F.lit(n_numeric).alias("numeric"))


# C7 / C8 / C9 / C10 ---------------------------------------------------------------
def variable_kind(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """pie: exactly 2 distinct non-null values; bar: <= 5 distinct, all integral,
    or non-numeric; continuous otherwise.

    One HyperLogLog pass screens out features that clearly have many distinct
    values (the sketch is near-exact at small cardinalities; the cut-off keeps
    a wide margin above 5); only the remaining features are grouped by exact
    (feature, value), so the shuffle carries a handful of values per feature
    instead of every distinct value of every continuous column.
    """
    numeric = set(numeric_columns(df))
    num = [f for f in features if f in numeric]
    spark = df.sparkSession
    approx = df.agg(*[F.approx_count_distinct(F.col(f), 0.05).alias(f) for f in num]).first() if num else {}
    small = [f for f in num if approx[f] <= SCREEN_DISTINCT]
    rows = [(f, int(approx[f]), "continuous") for f in num if f not in small]
    if small:
        stats = _long(df, small).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
            F.lit(1).alias("one")).groupBy("feature").agg(
            F.count(F.lit(1)).alias("n_distinct"),
            F.min((F.col("value") == F.floor("value")).cast("int")).alias("integral"))
        got = {r["feature"]: r for r in stats.collect()}         # <= SCREEN_DISTINCT per feature
        for f in small:
            r = got.get(f)
            if r is None:
                rows.append((f, 0, "continuous"))
            elif r["n_distinct"] == 2:
                rows.append((f, r["n_distinct"], "pie"))
            elif r["n_distinct"] <= MAX_UNIQUE_INT and r["integral"] == 1:
                rows.append((f, r["n_distinct"], "bar"))
            else:
                rows.append((f, r["n_distinct"], "continuous"))
    rows += [(f, None, "bar") for f in features if f not in numeric]
    order = {f: i for i, f in enumerate(features)}
    rows.sort(key=lambda r: order[r[0]])
    return spark.createDataFrame([(f, k) for f, _, k in rows], "feature string, kind string")


def _value_text(df: DataFrame, features: Sequence[str]) -> dict[str, bool]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {f: isinstance(types[f], (T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                                     T.BooleanType)) for f in features}


def value_counts(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """Non-null frequency per (feature, value[, by])."""
    keep = [by] if by else []
    long = _long(df, features, keep).where(F.col("value").isNotNull())
    keys = ["feature", "value"] + keep
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def value_labels(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """C8: 'No (0)' / 'Yes (1)' when a feature's value set is exactly {0, 1},
    else the value as text (integers without a decimal point)."""
    counts = value_counts(df, features)
    w = Window.partitionBy("feature")
    integral = _value_text(df, features)
    int_feats = [f for f, v in integral.items() if v]
    is01 = ((F.min("value").over(w) == 0) & (F.max("value").over(w) == 1)
            & (F.count(F.lit(1)).over(w) == 2))
    text = F.when(F.col("feature").isin(*int_feats) if int_feats else F.lit(False),
                  F.col("value").cast("long").cast("string")).otherwise(
        F.col("value").cast("string"))
    label = (F.when(is01 & (F.col("value") == 0), "No (0)")
             .when(is01 & (F.col("value") == 1), "Yes (1)").otherwise(text))
    return counts.select("feature", "value", label.alias("label"))


# C11 --------------------------------------------------------------------------------
def _bin_counts(df: DataFrame, features: Sequence[str], bins: int,
                by: str | None = None, own_range: bool = False) -> DataFrame:
    """Unrounded (feature[, by], bin, lo, hi, count) for equal-width bins of each
    feature's range, or (``own_range``) of each level's own."""
    keep = [by] if by else []
    long = _long(df, features, keep).where(F.col("value").isNotNull())
    if by:
        long = long.where(F.col(by).isNotNull()) if own_range else long
    keys = ["feature", *keep] if own_range else ["feature"]
    rng = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = long.join(F.broadcast(rng), keys)                  # #features (x #levels) rows
    span = F.col("hi") - F.col("lo")
    raw_bin = F.floor((F.col("value") - F.col("lo")) / span * bins)
    b = F.when(span == 0, F.lit(0)).otherwise(F.least(raw_bin, F.lit(bins - 1))).cast("int")
    return x.select("feature", *keep, "lo", "hi", b.alias("bin")).groupBy(
        "feature", *keep, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, features: Sequence[str], bins: int = DEFAULT_BINS,
              by: str | None = None) -> DataFrame:
    """Equal-width bins between each feature's min and max; max goes to the last bin."""
    keep = [by] if by else []
    counted = _bin_counts(df, features, bins, by)
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("feature", *keep, "bin",
                          r6(F.col("lo") + F.col("bin") * width).alias("lower"),
                          r6(F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                          "count")


# C12 --------------------------------------------------------------------------------
def _fences(df: DataFrame, features: Sequence[str], by: str | None, k: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Long values joined with their (feature[, level])'s quartiles and fences; the fences; the key."""
    spark = df.sparkSession
    levels = ([r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().collect()]
              if by else [None])                           # a target has few levels
    exprs, keys = {}, []
    for f in features:
        for lv in levels:
            name = f"{f}|{lv}"
            x = F.col(f).cast("double")
            exprs[name] = x if lv is None else F.when(F.col(by) == F.lit(lv), x)
            keys.append((name, f, lv))
    q = exact_quantiles(df, exprs, [0.25, 0.5, 0.75])
    rows = []
    for name, f, lv in keys:
        q1, q2, q3 = q[name]
        if q1 is None:
            continue
        iqr = q3 - q1
        rows.append((f, lv, q1, q2, q3, q1 - k * iqr, q3 + k * iqr))
    level_type = df.schema[by].dataType.simpleString() if by else "int"
    qdf = spark.createDataFrame(rows, f"feature string, level {level_type}, q1 double, "
                                      "median double, q3 double, lo_fence double, hi_fence double")
    if not by:
        return df, qdf.drop("level"), ["feature"]
    return df.withColumnRenamed(by, "level"), qdf, ["feature", "level"]


def box_summary(df: DataFrame, features: Sequence[str], by: str | None = None,
                k: float = IQR_K) -> DataFrame:
    """Quartiles, whiskers (furthest values within k x IQR) and outlier count."""
    named, qdf, cond = _fences(df, features, by, k)
    long = _long(named, features, cond[1:]).where(F.col("value").isNotNull())
    j = long.join(F.broadcast(qdf), cond)                  # #features x #levels rows
    v, lo, hi = F.col("value"), F.col("lo_fence"), F.col("hi_fence")
    agg = j.groupBy(*cond).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"),
        F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count(F.when((v < lo) | (v > hi), 1)).alias("n_outliers"))
    return agg.select(*cond, *[r6(c).alias(c) for c in
                               ("q1", "median", "q3", "whisker_low", "whisker_high")],
                      "n_outliers")


def box_outliers(df: DataFrame, features: Sequence[str], key: str, by: str | None = None,
                 k: float = IQR_K) -> DataFrame:
    """The points that a box plot draws beyond its whiskers: (key, feature[, level], value,
    side), side being 'low' or 'high'. Every point is returned."""
    named, qdf, cond = _fences(df, features, by, k)
    long = _long(named, features, [key, *cond[1:]]).where(F.col("value").isNotNull())
    v = F.col("value")
    j = long.join(F.broadcast(qdf), cond).where((v < F.col("lo_fence")) | (v > F.col("hi_fence")))  # #features x #levels
    return j.select(key, *cond, r6(v).alias("value"), F.when(v < F.col("lo_fence"), "low").otherwise("high").alias("side"))


# C13 --------------------------------------------------------------------------------
def density_summary(df: DataFrame, features: Sequence[str], grid: int = 50,
                    bins: int = 200, by: str | None = None) -> DataFrame:
    """Gaussian kernel density on ``grid`` points per feature (violin outline), or
    per feature and level of ``by`` (a violin each, over the level's own range).

    Values are first binned (C11 with ``bins`` bins); the density at each grid
    point sums the kernel over bin centres weighted by bin counts, so cost is
    bins x grid per feature whatever the row count. Bandwidth is Silverman's
    rule: 1.059 x min(std, IQR / 1.349) x n^(-1/5), falling back to std when
    the IQR is 0. ``density_scaled`` is density x (max - min), which keeps the
    shape readable at 6 places for features on large scales.
    """
    named, qdf, keys = _fences(df, features, by, IQR_K)
    counts = _bin_counts(named, features, bins, "level" if by else None, own_range=by is not None)
    stats = _long(named, features, keys[1:]).where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    iqr = (F.col("q3") - F.col("q1")) / 1.349
    spread = F.when(iqr > 0, F.least(F.col("sd"), iqr)).otherwise(F.col("sd"))
    bw = stats.join(F.broadcast(qdf), keys).select(        # #features x #levels rows
        *keys, "n", "lo", "hi",
        (F.lit(1.059) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    bw = bw.where(F.col("bw") > 0)
    gridded = bw.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g")).select(
        *keys, "g", "n", "bw", "lo", "hi",                     # #features x grid rows
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (grid - 1)).alias("x"))
    width = (F.col("hi") - F.col("lo")) / bins
    centres = counts.select(*keys, (F.col("lo") + (F.col("bin") + 0.5) * width).alias("c"),
                            "count")
    pairs = gridded.join(centres, keys)                     # grid x bins per feature
    z = (F.col("x") - F.col("c")) / F.col("bw")
    dens = pairs.groupBy(*keys, "g", "x", "n", "bw", "lo", "hi").agg(
        F.sum(F.col("count") * F.exp(-0.5 * z * z)).alias("s"))
    d = F.col("s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return dens.select(*keys, F.col("g").cast("int").alias("g"), r6("x").alias("x"),
                       r6(d).alias("density"),
                       r6(d * (F.col("hi") - F.col("lo"))).alias("density_scaled"))


# C14 --------------------------------------------------------------------------------
def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factor per feature, sorted descending.

    Median-fills the features (B11), gets the p x p covariance matrix from one
    pass of per-partition moments, then solves each feature's least squares on
    the others from that matrix (pseudo-inverse, so exact collinearity is
    fine). R^2 >= 0.9999 gives inf; a single feature gives NaN.
    """
    from reachlab.functions.moments import covariance_matrix, pairwise_moments
    from reachlab.operators.prep import median_fill

    spark = df.sparkSession
    feats = list(features)
    if len(feats) < 2:
        return spark.createDataFrame([(f, float("nan")) for f in feats], "feature string, vif double")
    filled = median_fill(df.select(*[F.col(f).cast("double").alias(f) for f in feats]), feats)
    means = filled.agg(*[F.avg(f).alias(f) for f in feats]).first()
    cov = covariance_matrix(pairwise_moments(filled, feats, [means[f] or 0.0 for f in feats]))
    p = len(feats)
    out = []
    for j, f in enumerate(feats):
        others = [i for i in range(p) if i != j]
        s_oo = cov[np.ix_(others, others)]
        s_oj = cov[others, j]
        beta = np.linalg.pinv(s_oo) @ s_oj
        var = cov[j, j]
        if var <= 1e-12 * max(1.0, abs(means[f] or 0.0)) ** 2:
            r2 = 1.0
        else:
            r2 = 1.0 - max(var - s_oj @ beta, 0.0) / var
        out.append((f, float("inf") if r2 >= 0.9999 else float(1.0 / (1.0 - r2))))
    res = spark.createDataFrame(out, "feature string, vif double")
    return res.orderBy(F.col("vif").desc(), "feature")


# C15 / C16 --------------------------------------------------------------------------
def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every ordered pair over pairwise-complete rows.

    Constant columns get NULL (pandas and DuckDB give NaN; Spark's ``corr``
    would divide by zero under ANSI). All pairs come from one pass of
    per-partition moments (``functions.moments``); the p x p result is
    returned as p^2 rows.
    """
    from reachlab.functions.moments import pairwise_moments, pearson_matrix

    cols = list(cols)
    spark = df.sparkSession
    st = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    shift = [st[f"m{i}"] or 0.0 for i in range(len(cols))]
    live = [bool(st[f"s{i}"]) and st[f"s{i}"] > 0 for i in range(len(cols))]
    r = pearson_matrix(pairwise_moments(df, cols, shift))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = r[i, j]
            ok = live[i] and live[j] and not np.isnan(v)
            rows.append((a, b, float(v) if ok else None))
    out = spark.createDataFrame(rows, "feature_a string, feature_b string, r double")
    return out.select("feature_a", "feature_b", r6("r").alias("r"))


def top_target_correlations(corr: DataFrame, target: str, k: int = 5) -> DataFrame:
    """Top k features by |r| with the target, with the sign of r (+ or minus)."""
    t = corr.where((F.col("feature_b") == target) & (F.col("feature_a") != target)
                   & F.col("r").isNotNull())
    ranked = t.orderBy(F.abs("r").desc(), F.col("feature_a").asc()).limit(k)
    return ranked.select(F.col("feature_a").alias("feature"), "r",
                         F.abs("r").alias("abs_r"),
                         F.when(F.col("r") > 0, "+").otherwise(MINUS).alias("direction"))


# C17 / C18 ----------------------------------------------------------------------------
def variable_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Continuous card: mean, std, min, max, distinct values, missing n and %.

    All of it comes from one count per (feature, value); the squares are summed
    about each feature's mean, over the same shuffled counts.
    """
    per_value = _long(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    known = F.when(F.col("value").isNotNull(), F.col("c"))
    stats = per_value.groupBy("feature").agg(
        F.sum("c").alias("rows"), F.sum(known).alias("known"),
        F.count("value").alias("n_unique"),
        (F.sum(F.col("value") * known) / F.sum(known)).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    apart = F.col("value") - F.col("mean")
    squares = per_value.join(F.broadcast(stats.select("feature", "mean")), "feature").groupBy("feature").agg(  # a row per feature
        F.sum(apart * apart * F.col("c")).alias("squares"))
    out = stats.join(F.broadcast(squares), "feature")
    missing = F.col("rows") - F.coalesce("known", F.lit(0))
    std = F.when(F.col("known") > 1, F.sqrt(F.col("squares") / (F.col("known") - 1)))
    return out.select("feature", r6("mean").alias("mean"), r6(std).alias("std"),
                      r6("min").alias("min"), r6("max").alias("max"), "n_unique",
                      missing.cast("long").alias("missing"),
                      r6(missing / F.col("rows") * 100.0).alias("missing_pct"))


def categorical_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Categorical card: levels, most common (ties -> smallest), its label, top
    share of non-null rows, % yes for 0/1 features, missing n and %."""
    long = _long(df, features)
    per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    nn = F.col("value").isNotNull()
    stats = per_value.groupBy("feature").agg(
        F.sum("c").alias("rows"),
        F.coalesce(F.sum(F.when(~nn, F.col("c"))), F.lit(0)).alias("missing"),
        F.count("value").alias("levels"),
        F.max_by(F.when(nn, F.col("value")), F.when(nn, F.struct(F.col("c"), -F.col("value"))))
        .alias("top"),
        F.max(F.when(nn, F.col("c"))).alias("top_c"),
        F.sum(F.when(nn, F.col("c"))).alias("nonnull"),
        F.sum(F.when(nn, F.col("value") * F.col("c"))).alias("vsum"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    is01 = (F.col("levels") == 2) & (F.col("vmin") == 0) & (F.col("vmax") == 1)
    integral = _value_text(df, features)
    int_feats = [f for f, v in integral.items() if v]
    text = F.when(F.col("feature").isin(*int_feats) if int_feats else F.lit(False),
                  F.col("top").cast("long").cast("string")).otherwise(F.col("top").cast("string"))
    label = (F.when(is01 & (F.col("top") == 0), "No (0)")
             .when(is01 & (F.col("top") == 1), "Yes (1)").otherwise(text))
    return stats.select(
        "feature", "levels", r6("top").alias("most_common"), label.alias("most_common_label"),
        r6(safe_div(F.col("top_c") * 100.0, F.col("nonnull"))).alias("top_share_pct"),
        r6(F.when(is01, F.col("vsum") / F.col("nonnull") * 100.0)).alias("pct_yes"),
        F.col("missing").cast("long").alias("missing"),
        r6(F.col("missing") / F.col("rows") * 100.0).alias("missing_pct"))


# C19 / C20 / C21 ------------------------------------------------------------------------
def _outliers(df: DataFrame, features: Sequence[str], bounds: dict) -> DataFrame:
    spark = df.sparkSession
    rows = [(f, lo, hi) for f, (lo, hi) in bounds.items() if lo is not None]
    bdf = spark.createDataFrame(rows, "feature string, lower double, upper double")
    long = _long(df, features)
    j = long.join(F.broadcast(bdf), "feature")             # #features rows
    v = F.col("value")
    agg = j.groupBy("feature", "lower", "upper").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when((v < F.col("lower")) | (v > F.col("upper")), 1)).alias("n_outliers"))
    return agg.select("feature", "n_outliers",
                      r6(F.col("n_outliers") / F.col("rows") * 100.0).alias("pct"),
                      r6("lower").alias("lower"), r6("upper").alias("upper"))


def outliers_iqr(df: DataFrame, features: Sequence[str], k: float = IQR_K) -> DataFrame:
    """Strictly outside [q1 - k IQR, q3 + k IQR]; % of all rows."""
    q = exact_quantiles(df, list(features), [0.25, 0.75])
    bounds = {}
    for f in features:
        q1, q3 = q[f]
        bounds[f] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return _outliers(df, features, bounds)


def outliers_zscore(df: DataFrame, features: Sequence[str], z: float = Z_THRESHOLD) -> DataFrame:
    """Strictly outside mean +- z x std (ddof 1); % of all rows."""
    long = _long(df, features)
    st = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    j = long.join(F.broadcast(st), "feature")
    lower = F.col("mu") - z * F.col("sd")
    upper = F.col("mu") + z * F.col("sd")
    v = F.col("value")
    agg = j.groupBy("feature", "mu", "sd").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when((v < lower) | (v > upper), 1)).alias("n_outliers"))
    return agg.select("feature", "n_outliers",
                      r6(F.col("n_outliers") / F.col("rows") * 100.0).alias("pct"),
                      r6(lower).alias("lower"), r6(upper).alias("upper"))


def outlier_severity(outliers: DataFrame) -> DataFrame:
    sev = (F.when(F.col("pct") < SEVERITY_LOW_PCT, "Low")
           .when(F.col("pct") < SEVERITY_MEDIUM_PCT, "Medium").otherwise("High"))
    w = Window.orderBy(F.col("pct").desc(), F.col("feature").asc())
    # one row per feature: a global window over #features rows is bounded
    return outliers.select("feature", "n_outliers", "pct", sev.alias("severity"),
                           F.row_number().over(w).alias("rank"))


# C22 --------------------------------------------------------------------------------------
def target_summary(df: DataFrame, target: str = "Response") -> DataFrame:
    """Rows, levels, most common (ties -> smallest), positive rate for 0/1, top share."""
    t = df.select(F.col(target).cast("double").alias("y")).where(F.col("y").isNotNull())
    per = t.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    agg = per.agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("levels"),
                  F.max_by("y", F.struct(F.col("c"), -F.col("y"))).alias("top"),
                  F.max("c").alias("top_c"), F.sum(F.col("y") * F.col("c")).alias("ysum"),
                  F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    is01 = (F.col("levels") == 2) & (F.col("ymin") == 0) & (F.col("ymax") == 1)
    label = (F.when(is01 & (F.col("top") == 0), "No (0)")
             .when(is01 & (F.col("top") == 1), "Yes (1)")
             .otherwise(F.col("top").cast("long").cast("string")))
    return agg.select("rows", "levels", label.alias("most_common"),
                      r6(F.when(is01, F.col("ysum") / F.col("rows"))).alias("positive_rate"),
                      r6(F.col("top_c") / F.col("rows") * 100.0).alias("top_share_pct"))


def target_describe(df: DataFrame, target: str) -> DataFrame:
    """C22 for a continuous target: count, mean, std, min, quartiles, max."""
    return profile_describe(df, [target]).drop("feature")
