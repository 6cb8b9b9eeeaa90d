"""Queries for profiling and exploration (C1-C22) on the raw customer table."""

from __future__ import annotations

from pyspark.sql import types as T

from reachlab.operators import profile as P
from reachlab.operators.catalog import feature_list_names
from reachlab.plans import base
from reachlab.plans.oracle_base import with_raw
from reachlab.plans.registry import register
from reachlab.sources.campaign import RAW_COLUMNS, RAW_SCHEMA, TARGET

NUMERIC_RAW = [f.name for f in RAW_SCHEMA.fields if isinstance(f.dataType, T.NumericType)]
FEATURES_RAW = [c for c in NUMERIC_RAW if c != TARGET and c not in P.NON_FEATURES]
CORR_COLS = [c for c in NUMERIC_RAW if c not in P.NON_FEATURES]


def _unpivot(cols, keep=(), src="campaign_raw"):
    keep_sel = "".join(f"{k}, " for k in keep)
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f"(SELECT {keep_sel}feature, value FROM (SELECT {keep_sel}{casts} FROM {src}) "
            f"UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(cols)})))")


def _names(cols):
    return "(VALUES " + ", ".join(f"('{c}')" for c in cols) + ") AS names(feature)"


LONG = f", long AS {_unpivot(FEATURES_RAW)}"
KINDS = LONG + f""",
distinct_vals AS (SELECT DISTINCT feature, value FROM long WHERE value IS NOT NULL),
kind_stats AS (
  SELECT feature, count(*) AS n_distinct,
         min(CASE WHEN value = floor(value) THEN 1 ELSE 0 END) AS integral
  FROM distinct_vals GROUP BY feature),
kinds AS (
  SELECT names.feature, CAST(coalesce(n_distinct, 0) AS BIGINT) AS n_distinct,
         CASE WHEN n_distinct IS NULL THEN 'continuous'
              WHEN n_distinct = 2 THEN 'pie'
              WHEN n_distinct <= 5 AND integral = 1 THEN 'bar'
              ELSE 'continuous' END AS kind
  FROM {_names(FEATURES_RAW)} LEFT JOIN kind_stats USING (feature))"""


def _kind_features(spark, sf_dir, continuous: bool):
    raw = base.raw(spark, sf_dir)
    kinds = P.variable_kind(raw, FEATURES_RAW).collect()     # one row per feature
    return [r["feature"] for r in kinds if (r["kind"] == "continuous") == continuous]


# C1 ---------------------------------------------------------------------------
@register("profile_overview", with_raw(
    f"SELECT count(*) AS n_rows, {len(FEATURES_RAW)} AS n_features FROM campaign_raw"))
def profile_overview(spark, sf_dir):
    return P.profile_overview(base.raw(spark, sf_dir), FEATURES_RAW)


# C2 ---------------------------------------------------------------------------
@register("profile_describe", with_raw(f"""
, d AS {_unpivot(NUMERIC_RAW)}
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM d GROUP BY feature"""))
def profile_describe(spark, sf_dir):
    return P.profile_describe(base.raw(spark, sf_dir), NUMERIC_RAW)


# C3 / C4 / C5 / C6 ---------------------------------------------------------------
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS n FROM campaign_raw"
    for c in RAW_COLUMNS)


@register("profile_missing", with_raw(f"""
, m AS ({_MISSING})
SELECT "column", missing, round_even(CAST(missing / n * 100.0 AS DOUBLE), 2) AS missing_pct FROM m"""))
def profile_missing(spark, sf_dir):
    return P.profile_missing(base.raw(spark, sf_dir))


@register("profile_completeness", with_raw(f"""
, m AS ({_MISSING})
SELECT round((1 - avg(missing / n)) * 100.0, 6) AS completeness_pct FROM m"""))
def profile_completeness(spark, sf_dir):
    return P.profile_completeness(base.raw(spark, sf_dir))


_DUPS = (f"SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates FROM "
         f"(SELECT count(*) AS c FROM campaign_raw GROUP BY {', '.join(RAW_COLUMNS)})")


@register("profile_duplicates", with_raw(_DUPS))
def profile_duplicates(spark, sf_dir):
    return P.duplicate_rows(base.raw(spark, sf_dir))


_N_NUMERIC = len(NUMERIC_RAW)
_NULL_CELLS = " + ".join(f"(count(*) - count({c}))" for c in RAW_COLUMNS)


@register("profile_report", with_raw(f"""
, cells AS (SELECT count(*) AS observations, CAST({_NULL_CELLS} AS BIGINT) AS missing_cells
            FROM campaign_raw),
dups AS ({_DUPS})
SELECT observations, {len(RAW_COLUMNS)} AS variables, missing_cells,
       round(CASE WHEN observations = 0 THEN 0.0
                  ELSE missing_cells * 100.0 / (observations * {len(RAW_COLUMNS)}) END, 6) AS missing_pct,
       duplicates, {_N_NUMERIC} AS numeric
FROM cells, dups"""))
def profile_report(spark, sf_dir):
    return P.profile_report(base.raw(spark, sf_dir))


# C7 - C10 -------------------------------------------------------------------------
@register("variable_kind", with_raw(KINDS + "\nSELECT feature, kind FROM kinds"))
def variable_kind(spark, sf_dir):
    return P.variable_kind(base.raw(spark, sf_dir), FEATURES_RAW)


@register("value_counts", with_raw(KINDS + """
SELECT feature, value, count(*) AS count FROM long
WHERE value IS NOT NULL AND feature IN (SELECT feature FROM kinds WHERE kind <> 'continuous')
GROUP BY feature, value"""))
def value_counts(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=False)
    return P.value_counts(base.raw(spark, sf_dir), feats)


_LONG_T = f", long AS {_unpivot(FEATURES_RAW, keep=('Response',))}"


@register("value_counts_by_target", with_raw(KINDS.replace(LONG, _LONG_T) + """
SELECT feature, value, Response, count(*) AS count FROM long
WHERE value IS NOT NULL AND feature IN (SELECT feature FROM kinds WHERE kind <> 'continuous')
GROUP BY feature, value, Response"""))
def value_counts_by_target(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=False)
    return P.value_counts(base.raw(spark, sf_dir), feats, by=TARGET)


_INT_FEATURES = [f.name for f in RAW_SCHEMA.fields
                 if isinstance(f.dataType, (T.IntegerType, T.LongType)) and f.name in FEATURES_RAW]


@register("value_labels", with_raw(KINDS + f"""
, vc AS (SELECT feature, value FROM long
         WHERE value IS NOT NULL AND feature IN (SELECT feature FROM kinds WHERE kind <> 'continuous')
         GROUP BY feature, value),
fl AS (SELECT feature, min(value) = 0 AND max(value) = 1 AND count(*) = 2 AS is01
       FROM vc GROUP BY feature)
SELECT feature, value,
       CASE WHEN is01 AND value = 0 THEN 'No (0)'
            WHEN is01 AND value = 1 THEN 'Yes (1)'
            WHEN feature IN ({", ".join(f"'{c}'" for c in _INT_FEATURES)})
              THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
            ELSE CAST(value AS VARCHAR) END AS label
FROM vc JOIN fl USING (feature)"""))
def value_labels(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=False)
    return P.value_labels(base.raw(spark, sf_dir), feats)


# C11 - C13 ------------------------------------------------------------------------
def _hist_sql(bins, by=None):
    keep = f"{by}, " if by else ""
    return f"""
, rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long
          WHERE value IS NOT NULL GROUP BY feature),
binned AS (
  SELECT feature, {keep}lo, hi,
         CAST(CASE WHEN hi - lo = 0 THEN 0
                   ELSE least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) END AS INTEGER) AS bin
  FROM long JOIN rng USING (feature)
  WHERE value IS NOT NULL AND feature IN (SELECT feature FROM kinds WHERE kind = 'continuous'))
SELECT feature, {keep}bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS lower,
       round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS upper, count(*) AS count
FROM binned GROUP BY feature, {keep}bin, lo, hi"""


@register("histogram", with_raw(KINDS + _hist_sql(P.DEFAULT_BINS)))
def histogram(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.histogram(base.raw(spark, sf_dir), feats)


@register("histogram_by_target", with_raw(KINDS.replace(LONG, _LONG_T)
                                          + _hist_sql(P.DEFAULT_BINS, by="Response")))
def histogram_by_target(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.histogram(base.raw(spark, sf_dir), feats, by=TARGET)


def _box_sql(by=None):
    keys = f"feature, {by} AS level" if by else "feature"
    grp = "feature, level" if by else "feature"
    return f"""
, sub AS (SELECT {keys}, value FROM long WHERE value IS NOT NULL
          AND feature IN (SELECT feature FROM kinds WHERE kind = 'continuous')),
q AS (SELECT {grp}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM sub GROUP BY {grp}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT {grp}, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3,
       round(min(CASE WHEN value >= lo_fence THEN value END), 6) AS whisker_low,
       round(max(CASE WHEN value <= hi_fence THEN value END), 6) AS whisker_high,
       count(CASE WHEN value < lo_fence OR value > hi_fence THEN 1 END) AS n_outliers
FROM sub JOIN f USING ({grp}) GROUP BY {grp}"""


@register("box_summary", with_raw(KINDS + _box_sql()))
def box_summary(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.box_summary(base.raw(spark, sf_dir), feats)


@register("box_summary_by_target", with_raw(KINDS.replace(LONG, _LONG_T) + _box_sql("Response")))
def box_summary_by_target(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.box_summary(base.raw(spark, sf_dir), feats, by=TARGET)


def _points_sql(by=None):
    grp = "feature, level" if by else "feature"
    return f"""
, sub AS (SELECT ID, feature, {f"{by} AS level, " if by else ""}value FROM long WHERE value IS NOT NULL
          AND feature IN (SELECT feature FROM kinds WHERE kind = 'continuous')),
f AS (SELECT {grp}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM sub GROUP BY {grp})
SELECT ID, {grp}, round(value, 6) AS value, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END AS side
FROM sub JOIN f USING ({grp}) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


@register("box_outliers", with_raw(KINDS.replace(LONG, f", long AS {_unpivot(FEATURES_RAW, keep=('ID',))}") + _points_sql()))
def box_outliers(spark, sf_dir):
    """The points that the box plots show beyond their whiskers."""
    return P.box_outliers(base.raw(spark, sf_dir), _kind_features(spark, sf_dir, continuous=True), "ID")


@register("box_outliers_by_target", with_raw(
    KINDS.replace(LONG, f", long AS {_unpivot(FEATURES_RAW, keep=('ID', 'Response'))}") + _points_sql("Response")))
def box_outliers_by_target(spark, sf_dir):
    return P.box_outliers(base.raw(spark, sf_dir), _kind_features(spark, sf_dir, continuous=True), "ID", by=TARGET)


_GRID, _DBINS = 50, 200


def _density_sql(by=None):
    grp = "feature, level" if by else "feature"
    return f"""
, sub AS (SELECT feature, {f"{by} AS level, " if by else ""}value FROM long WHERE value IS NOT NULL
          AND feature IN (SELECT feature FROM kinds WHERE kind = 'continuous')),
st AS (SELECT {grp}, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
              quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
       FROM sub GROUP BY {grp}),
bw AS (SELECT {grp}, n, lo, hi,
              1.059 * (CASE WHEN (q3 - q1) / 1.349 > 0 THEN least(sd, (q3 - q1) / 1.349) ELSE sd END)
                * pow(CAST(n AS DOUBLE), -0.2) AS bw
       FROM st),
bins AS (
  SELECT {grp}, CAST(CASE WHEN hi - lo = 0 THEN 0
                  ELSE least(floor((value - lo) / (hi - lo) * {_DBINS}), {_DBINS - 1}) END AS INTEGER) AS bin,
         count(*) AS cnt
  FROM sub JOIN st USING ({grp}) GROUP BY {grp}, bin),
centres AS (SELECT {grp}, lo + (bin + 0.5) * ((hi - lo) / {_DBINS}) AS c, cnt
            FROM bins JOIN st USING ({grp})),
grid AS (SELECT {grp}, g, n, bw, lo, hi, lo + (hi - lo) * g / {_GRID - 1} AS x
         FROM bw, range({_GRID}) AS r(g) WHERE bw > 0),
dens AS (SELECT {grp}, g, x, n, bw, lo, hi,
                sum(cnt * exp(-0.5 * ((x - c) / bw) * ((x - c) / bw))) AS s
         FROM grid JOIN centres USING ({grp}) GROUP BY {grp}, g, x, n, bw, lo, hi)
SELECT {grp}, CAST(g AS INTEGER) AS g, round(x, 6) AS x,
       round(s / (n * bw * sqrt(2 * pi())), 6) AS density,
       round(s / (n * bw * sqrt(2 * pi())) * (hi - lo), 6) AS density_scaled
FROM dens"""


@register("density_summary", with_raw(KINDS + _density_sql()))
def density_summary(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.density_summary(base.raw(spark, sf_dir), feats, grid=_GRID, bins=_DBINS)


@register("density_by_target", with_raw(KINDS.replace(LONG, _LONG_T) + _density_sql("Response")))
def density_by_target(spark, sf_dir):
    """C13 split by the target: a violin per feature and class."""
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.density_summary(base.raw(spark, sf_dir), feats, grid=_GRID, bins=_DBINS, by=TARGET)


# C14 ------------------------------------------------------------------------------
@register("vif")
def vif(spark, sf_dir):
    """Rows-only: checked against a brute-force regression in tests."""
    df = base.prepared(spark, sf_dir)
    return P.vif(df, feature_list_names(df))


# C15 / C16 -------------------------------------------------------------------------
_CORR = f"""
, cl AS {_unpivot(CORR_COLS, keep=('ID',))},
sd AS (SELECT feature, stddev_pop(value) AS s FROM cl GROUP BY feature),
pairs AS (
  SELECT a.feature AS feature_a, b.feature AS feature_b, a.value AS va, b.value AS vb
  FROM cl a JOIN cl b ON a.ID = b.ID),
live AS (SELECT feature FROM sd WHERE s > 0),
corrs AS (
  SELECT feature_a, feature_b, corr(va, vb) AS r FROM pairs
  WHERE feature_a IN (SELECT feature FROM live) AND feature_b IN (SELECT feature FROM live)
  GROUP BY feature_a, feature_b),
matrix AS (
  SELECT n1.feature AS feature_a, n2.feature AS feature_b, round(r, 6) AS r
  FROM {_names(CORR_COLS).replace('names', 'n1')} CROSS JOIN {_names(CORR_COLS).replace('names', 'n2')}
  LEFT JOIN corrs ON corrs.feature_a = n1.feature AND corrs.feature_b = n2.feature)"""


@register("correlation_matrix", with_raw(_CORR + "\nSELECT * FROM matrix"))
def correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(base.raw(spark, sf_dir), CORR_COLS)


@register("top_target_correlations", with_raw(_CORR + f"""
SELECT feature_a AS feature, r, abs(r) AS abs_r, CASE WHEN r > 0 THEN '+' ELSE '{P.MINUS}' END AS direction
FROM matrix WHERE feature_b = 'Response' AND feature_a <> 'Response' AND r IS NOT NULL
ORDER BY abs(r) DESC, feature_a LIMIT 5"""))
def top_target_correlations(spark, sf_dir):
    corr = P.correlation_matrix(base.raw(spark, sf_dir), CORR_COLS)
    return P.top_target_correlations(corr, TARGET)


# C17 / C18 -------------------------------------------------------------------------
@register("variable_stats", with_raw(KINDS + """
, sub AS (SELECT feature, value FROM long
          WHERE feature IN (SELECT feature FROM kinds WHERE kind = 'continuous'))
SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       count(DISTINCT value) AS n_unique, count(*) - count(value) AS missing,
       round((count(*) - count(value)) / count(*) * 100.0, 6) AS missing_pct
FROM sub GROUP BY feature"""))
def variable_stats(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=True)
    return P.variable_stats(base.raw(spark, sf_dir), feats)


@register("categorical_stats", with_raw(KINDS + f"""
, sub AS (SELECT feature, value FROM long
          WHERE feature IN (SELECT feature FROM kinds WHERE kind <> 'continuous')),
pv AS (SELECT feature, value, count(*) AS c FROM sub GROUP BY feature, value),
agg AS (
  SELECT feature, sum(c) AS rows, coalesce(sum(CASE WHEN value IS NULL THEN c END), 0) AS missing,
         count(value) AS levels,
         arg_max(value, (c, -value)) FILTER (WHERE value IS NOT NULL) AS top,
         max(c) FILTER (WHERE value IS NOT NULL) AS top_c,
         sum(c) FILTER (WHERE value IS NOT NULL) AS nonnull,
         sum(value * c) FILTER (WHERE value IS NOT NULL) AS vsum,
         min(value) AS vmin, max(value) AS vmax
  FROM pv GROUP BY feature),
fl AS (SELECT *, levels = 2 AND vmin = 0 AND vmax = 1 AS is01 FROM agg)
SELECT feature, levels, round(top, 6) AS most_common,
       CASE WHEN is01 AND top = 0 THEN 'No (0)' WHEN is01 AND top = 1 THEN 'Yes (1)'
            WHEN feature IN ({", ".join(f"'{c}'" for c in _INT_FEATURES)})
              THEN CAST(CAST(top AS BIGINT) AS VARCHAR)
            ELSE CAST(top AS VARCHAR) END AS most_common_label,
       round(CASE WHEN nonnull = 0 THEN NULL ELSE top_c * 100.0 / nonnull END, 6) AS top_share_pct,
       round(CASE WHEN is01 THEN vsum / nonnull * 100.0 END, 6) AS pct_yes,
       CAST(missing AS BIGINT) AS missing, round(missing / rows * 100.0, 6) AS missing_pct
FROM fl"""))
def categorical_stats(spark, sf_dir):
    feats = _kind_features(spark, sf_dir, continuous=False)
    return P.categorical_stats(base.raw(spark, sf_dir), feats)


# C19 - C21 -------------------------------------------------------------------------
_IQR = LONG + """
, q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM long GROUP BY feature),
b AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
o AS (
  SELECT feature, count(CASE WHEN value < lower OR value > upper THEN 1 END) AS n_outliers,
         count(*) AS rows, any_value(lower) AS lower, any_value(upper) AS upper
  FROM long JOIN b USING (feature) GROUP BY feature),
iqr AS (SELECT feature, n_outliers, round(n_outliers / rows * 100.0, 6) AS pct,
               round(lower, 6) AS lower, round(upper, 6) AS upper FROM o)"""


@register("outliers_iqr", with_raw(_IQR + "\nSELECT * FROM iqr"))
def outliers_iqr(spark, sf_dir):
    return P.outliers_iqr(base.raw(spark, sf_dir), FEATURES_RAW)


@register("outliers_zscore", with_raw(LONG + """
, s AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM long GROUP BY feature),
o AS (
  SELECT feature, mu, sd,
         count(CASE WHEN value < mu - 3.0 * sd OR value > mu + 3.0 * sd THEN 1 END) AS n_outliers,
         count(*) AS rows
  FROM long JOIN s USING (feature) GROUP BY feature, mu, sd)
SELECT feature, n_outliers, round(n_outliers / rows * 100.0, 6) AS pct,
       round(mu - 3.0 * sd, 6) AS lower, round(mu + 3.0 * sd, 6) AS upper FROM o"""))
def outliers_zscore(spark, sf_dir):
    return P.outliers_zscore(base.raw(spark, sf_dir), FEATURES_RAW)


@register("outlier_severity", with_raw(_IQR + """
SELECT feature, n_outliers, pct,
       CASE WHEN pct < 1.0 THEN 'Low' WHEN pct < 5.0 THEN 'Medium' ELSE 'High' END AS severity,
       CAST(row_number() OVER (ORDER BY pct DESC, feature) AS INTEGER) AS rank
FROM iqr"""))
def outlier_severity(spark, sf_dir):
    return P.outlier_severity(P.outliers_iqr(base.raw(spark, sf_dir), FEATURES_RAW))


# C22 -------------------------------------------------------------------------------
@register("target_summary", with_raw("""
, per AS (SELECT CAST(Response AS DOUBLE) AS y, count(*) AS c FROM campaign_raw
          WHERE Response IS NOT NULL GROUP BY 1),
agg AS (SELECT sum(c) AS rows, count(*) AS levels, arg_max(y, (c, -y)) AS top, max(c) AS top_c,
               sum(y * c) AS ysum, min(y) AS ymin, max(y) AS ymax FROM per),
fl AS (SELECT *, levels = 2 AND ymin = 0 AND ymax = 1 AS is01 FROM agg)
SELECT CAST(rows AS BIGINT) AS rows, levels,
       CASE WHEN is01 AND top = 0 THEN 'No (0)' WHEN is01 AND top = 1 THEN 'Yes (1)'
            ELSE CAST(CAST(top AS BIGINT) AS VARCHAR) END AS most_common,
       round(CASE WHEN is01 THEN ysum / rows END, 6) AS positive_rate,
       round(top_c / rows * 100.0, 6) AS top_share_pct
FROM fl"""))
def target_summary(spark, sf_dir):
    return P.target_summary(base.raw(spark, sf_dir), TARGET)

