"""SMOTE (D6): exact neighbours, balance and segment invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlab.operators import resample as RS


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(4, 0.5, (100, 3)),
                   np.repeat([[9.0, 9.0, 9.0]], 40, axis=0)])         # a hot duplicate group
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>"), x


def test_knn_matches_brute_force(points, monkeypatch):
    df, x = points
    monkeypatch.setattr(RS, "ROWS_PER_CELL", 20)           # many small cells: pruning path
    got = RS.exact_knn(df, k=5).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        expect = np.sort(d[i])[:5]
        mine = got[got["id"] == i].sort_values("rank")
        assert np.allclose(np.sort(mine["dist"].to_numpy()), expect, atol=1e-9), i
        if i >= 250:                                          # duplicates: smallest other ids
            assert mine["nbr"].tolist() == [j for j in range(250, 290) if j != i][:5]


def test_most_cells_are_left_out(spark, monkeypatch):
    """Rows of many yes/no components: a row meets few of the cells, and the neighbours are the exact ones."""
    rng = np.random.default_rng(5)
    x = np.hstack([4.0 * rng.integers(0, 2, (900, 5)), rng.normal(0, 1, (900, 5))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    met, meet = [], RS._meet

    def counted(probes, members, k):
        met.append(probes.count())
        return meet(probes, members, k)

    monkeypatch.setattr(RS, "ROWS_PER_CELL", 30)
    monkeypatch.setattr(RS, "_meet", counted)
    got = RS.exact_knn(df, k=3).toPandas()
    assert sum(met) < 0.35 * len(x) * len(x) / 30
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.sort_values(["id", "rank"])["dist"].to_numpy().reshape(-1, 3), np.sort(d, axis=1)[:, :3], atol=1e-9)


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(2)
    n0, n1 = 120, 30
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(0, 1, (n0, 2)))]
    rows += [(n0 + i, float(a), float(b), 1) for i, (a, b) in enumerate(rng.normal(2, 1, (n1, 2)))]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, label int")
    out = RS.smote(df, ["f1", "f2"])
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: n0, 1: n0}
    syn = out.where("synthetic").alias("s")
    src = df.select(F.col("id").alias("bid"), F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    nbr = df.select(F.col("id").alias("nid"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    j = syn.join(src, syn.base_id == src.bid).join(nbr, syn.nbr_id == nbr.nid).collect()
    assert len(j) == n0 - n1
    for r in j:
        t1 = (r["f1"] - r["b1"]) / (r["n1"] - r["b1"]) if r["n1"] != r["b1"] else 0.0
        assert 0.0 <= t1 <= 1.0
        assert r["f2"] == pytest.approx(r["b2"] + t1 * (r["n2"] - r["b2"]), abs=1e-9)
    again = RS.smote(df, ["f1", "f2"]).where("synthetic").orderBy("id").collect()
    assert again == out.where("synthetic").orderBy("id").collect()


def test_one_minority_row_is_refused(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.1, 0), (3, 0.2, 0)], "id long, f1 double, label int")
    with pytest.raises(ValueError):
        RS.smote(df, ["f1"])


def test_neighbours_without_a_fold_match_brute_force(points, monkeypatch):
    """One graph for all folds equals a search per fold, also where whole neighbourhoods are held out."""
    df, x = points
    monkeypatch.setattr(RS, "ROWS_PER_CELL", 40)
    # neighbours of the first cluster mostly share a fold; the hot duplicates' first members do, too
    fold = np.where(np.arange(len(x)) < 30, 0, np.where((np.arange(len(x)) >= 250) & (np.arange(len(x)) < 270), 1,
                                                        np.arange(len(x)) % 3))
    folds = df.sparkSession.createDataFrame([(i, int(f)) for i, f in enumerate(fold)], "id long, fold int")
    got = RS.fold_neighbours(df.join(folds, "id"), 3, k=5, margin=1).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for held in range(3):
        mine = got[got["held"] == held].sort_values(["id", "rank"])
        ids = np.flatnonzero(fold != held)
        assert sorted(mine["id"].unique()) == ids.tolist() and len(mine) == 5 * len(ids)
        assert (fold[mine["nbr"]] != held).all()
        for i, rows in mine.groupby("id"):
            order = ids[np.lexsort((ids, np.round(d[i][ids], 12)))][:5]
            assert rows["rank"].tolist() == [1, 2, 3, 4, 5]
            assert np.allclose(rows["dist"], d[i][order], atol=1e-9), (held, i)


def test_oversampled_folds_have_no_held_out_parent(spark):
    """The table's folds: the shared graph gives each fold the rows that a search of its own gives."""
    from reachlab.operators import models as M
    from reachlab.operators import split as S
    from reachlab.operators.catalog import feature_list_names
    from reachlab.plans import base

    from .conftest import SF_SMALL
    sp = base.split(spark, SF_SMALL)
    feats = feature_list_names(sp, "label")
    train = S.cv_folds(sp.where(F.col("split") == "train")).select(
        "id", "fold", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in feats])
    data = M.MedianImputer(inputCols=feats).fit(train).transform(train)
    data = S.PopulationStandardScaler(inputCols=feats).fit(data).transform(data).cache()
    fold_of = {r["id"]: r["fold"] for r in data.select("id", "fold").collect()}
    shared = M.minority_neighbours(data, feats, 5)
    for held in (0, 3):
        fit = data.where(F.col("fold") != held)
        key = lambda df: sorted((r["id"], r["base_id"], r["nbr_id"]) for r in df.where("synthetic").collect())
        mine = key(RS.smote(fit, feats, neighbours=shared.where(F.col("held") == held)))
        assert mine == key(RS.smote(fit, feats)) and mine
        assert all(fold_of[b] != held and fold_of[n] != held for _, b, n in mine)


def test_cross_validation_with_oversampling(spark):
    from reachlab.operators import models as M
    from reachlab.operators import split as S
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(0, 1, (150, 2)))]
    rows += [(150 + i, float(a), float(b), 1) for i, (a, b) in enumerate(rng.normal(1.5, 1, (30, 2)))]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, label int")
    got = M.cross_validate(S.cv_folds(df, k=3), ["f1", "f2"], ["logistic", "tree"], k=3, smote=True).collect()
    assert len(got) == 6 and all(0.5 < r["roc_auc"] <= 1 and r["cv_std"] >= 0 for r in got)
