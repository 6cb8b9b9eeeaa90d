"""Split, scaling and class weights (D1-D5) and cross-validation folds.

Randomness is always a hash of (seed, id): the same rows land in the same
split on every run, on every engine, and after any executor loss.

The exact stratified split and the folds need a per-label row order. A
``row_number() OVER (PARTITION BY label ...)`` would put each class -- half
the table or more -- in one task, so the rank comes from
``functions.ordered.rank_within`` instead. ``hash_split`` is the shuffle-free
alternative for very large tables: each row decides on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlab.functions.columns import hash_order, hash_unit, r6
from reachlab.functions.ordered import rank_within

# --- fixed values of the reference's split settings ------------------------------
SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5
EXPLAIN_MAX_TRAIN = 5000
EXPLAIN_MAX_TEST = 500
# -----------------------------------------------------------------------------------


def _hash_key(seed: int) -> Column:
    """60-bit integer from md5(seed|id): a total pseudo-random order key."""
    return F.conv(F.substring(hash_order(seed, "id"), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str = "label", frac: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """D1 exact: per class, the round(n_class x frac) rows first in md5(seed|id)
    order go to 'test', the rest to 'train'. Adds column ``split``. Rows without
    a label are a class of their own and are split like any other."""
    keyed = df.withColumn("__h", _hash_key(seed))
    ranked = rank_within(keyed, [label], "__h", "id", out="__r")
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    j = ranked.join(F.broadcast(sizes), ranked[label].eqNullSafe(sizes["__label"]))  # one row per class
    n_test = F.floor(F.col("__n") * frac + 0.5)
    return j.withColumn("split", F.when(F.col("__r") <= n_test, "test").otherwise("train")) \
        .drop("__h", "__r", "__n", "__label")


def hash_split(df: DataFrame, frac: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """D1 at scale: 'test' when hash_unit(seed, id) < frac. No shuffle; the
    class balance holds in expectation."""
    return df.withColumn("split", F.when(hash_unit(seed, "id") < frac, "test").otherwise("train"))


def explain_sample(df: DataFrame, label: str = "label", seed: int = SEED,
                   max_train: int = EXPLAIN_MAX_TRAIN, max_test: int = EXPLAIN_MAX_TEST) -> DataFrame:
    """The attribution path's capped sample. At most max_train + max_test
    rows, chosen first in md5(seed|id) order (the cap is the feature: a
    reproducible sample), then split with test share min(max_test / n, 0.2)."""
    cap = max_train + max_test
    n = df.count()
    sample = df.orderBy(hash_order(seed, "id"), "id").limit(cap) if n > cap else df
    m = min(n, cap)
    frac = min(max_test / m, TEST_FRACTION) if m else TEST_FRACTION
    return stratified_split(sample, label=label, frac=frac, seed=seed)


def split_report(df: DataFrame, label: str = "label") -> DataFrame:
    """D3: rows and positive rate per side."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                   r6(F.avg(F.col(label).cast("double")) * 100.0).alias("positive_pct"))


class PopulationStandardScaler(Estimator, HasInputCols):
    """(x - mean) / population std, fitted on the rows it is given.

    MLlib's StandardScaler divides by the sample std; the reference's scaler
    uses the population std and leaves a zero-variance column unscaled
    (divides by 1). One aggregate pass fits it; the model is plain column
    arithmetic, so it stays inside whole-stage codegen.
    """

    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))

    def _fit(self, dataset: DataFrame) -> "PopulationStandardScalerModel":
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")
                            for i, c in enumerate(cols)]).first()
        means = [row[f"m{i}"] or 0.0 for i in range(len(cols))]
        sds = [row[f"s{i}"] or 0.0 for i in range(len(cols))]
        return PopulationStandardScalerModel(cols, means, [s if s > 0 else 1.0 for s in sds])


class PopulationStandardScalerModel(Model, HasInputCols):
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted scales", TypeConverters.toListFloat)

    def __init__(self, inputCols=None, means=None, scales=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols), means=list(means), scales=list(scales))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        means, scales = self.getOrDefault(self.means), self.getOrDefault(self.scales)
        repl = {c: ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c)
                for c, m, s in zip(cols, means, scales)}
        return dataset.select(*[repl.get(c, F.col(c)) for c in dataset.columns])


def standardize(df: DataFrame, features: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """D4 as a table transform: fit on the rows where ``fit_on`` holds
    (default: split == 'train'), apply to every row."""
    cond = fit_on if fit_on is not None else (F.col("split") == "train")
    model = PopulationStandardScaler(inputCols=list(features)).fit(df.where(cond))
    return model.transform(df)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (2 n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(tot)).select(          # two rows x one row
        label, "n_class", r6(F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(F.col(label).alias("__label"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), df[label].eqNullSafe(w["__label"])).drop("__label")  # one row per class


def cv_folds(df: DataFrame, label: str = "label", k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """D13 folds: (rank within class by md5(seed|id) - 1) mod k, so every fold
    gets the same share of each class (stratified)."""
    keyed = df.withColumn("__h", _hash_key(seed))
    ranked = rank_within(keyed, [label], "__h", "id", out="__r")
    return ranked.withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__h", "__r")
