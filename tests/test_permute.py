"""Keyed permutations, bottom-k samples, and permutation importance on top of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlab.functions.permute import bottom_k, permuted, permuted_places, round_tables, sides
from reachlab.operators import explain as X


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 100, 101, 1499])
def test_places_are_a_permutation_for_each_key(spark, n):
    keys = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "f string, r int")
    df = spark.range(n).crossJoin(F.broadcast(keys)).withColumn("at", permuted(F.col("id"), n, 42, F.col("f"), F.col("r")))
    by = {}
    for r in df.collect():
        by.setdefault((r["f"], r["r"]), {})[r["id"]] = r["at"]
    for places in by.values():
        assert sorted(places.values()) == list(range(n))
    if n >= 100:
        assert len({tuple(p[i] for i in range(n)) for p in by.values()}) == 3
        a = np.array([by["a", 0][i] for i in range(n)])
        assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.35 and (a == np.arange(n)).mean() < 0.1


def test_the_rectangle_is_tight():
    for n in [*range(1, 300), 10**6 + 3, 10**9 + 7]:
        a, b = sides(n)
        assert a * b >= n and a * b - n < a


@pytest.mark.parametrize("k", [3, 2000])
def test_bottom_k(spark, k):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"),
                                  F.pmod(F.xxhash64("id"), F.lit(50)).alias("key"))
    got = sorted((r["g"], r["key"], r["id"]) for r in bottom_k(df, ["g"], ["key", "id"], k).collect())
    rows = sorted((r["g"], r["key"], r["id"]) for r in df.collect())
    want = [r for g in ("cold", "hot") for r in [x for x in rows if x[0] == g][:k]]
    assert got == want


def test_partitions_keep_k_rows_before_the_shuffle(spark):
    ids = spark.range(1000).select((F.col("id") % 2).cast("string").alias("model"), "id")
    plan = X.ranked_sample(ids, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_importance_equals_a_loop_over_the_permutations(spark):
    rng = np.random.default_rng(9)
    n = 157
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.4).astype(int)
    df = spark.createDataFrame([(int(5 * i), int(y[i]), float(x[i, 0]), None if i % 9 == 0 else float(x[i, 1]))
                                for i in range(n)], "id long, label int, u double, v double").repartition(5)
    weights = {"u": 1.0, "v": -0.4}
    got = {r["feature"]: r for r in X.permutation_importance(df, X.linear_score(weights), ["u", "v"], repeats=4).collect()}

    def auc(p):
        pos, neg = p[y == 1][:, None], p[y == 0][None, :]
        return ((pos > neg) + 0.5 * (pos == neg)).mean()

    filled = np.where(np.arange(n) % 9 == 0, 0.0, x[:, 1])
    values = {"u": x[:, 0], "v": filled}
    score = lambda u, v: u - 0.4 * v
    for f in weights:
        drops = []
        for rep in range(4):
            places = [r["at"] for r in spark.range(n).orderBy("id").withColumn(
                "at", permuted(F.col("id"), n, 42, F.lit(f), F.lit(rep))).orderBy("id").collect()]
            moved = np.empty(n)
            moved[places] = values[f]
            now = {**values, f: moved}
            drops.append(auc(score(**values)) - auc(score(now["u"], now["v"])))
        assert got[f]["importance_mean"] == pytest.approx(np.mean(drops), abs=1e-6)
        assert got[f]["importance_std"] == pytest.approx(np.std(drops), abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 101, 1499])
def test_looked_up_places_are_those_of_the_expression(spark, n):
    for f, rep in (("a", 0), ("b", 3)):
        want = [r["at"] for r in spark.range(n).select("id", permuted(F.col("id"), n, 42, F.lit(f), F.lit(rep)).alias("at"))
                .orderBy("id").collect()]
        tables = round_tables(n, 42, f, rep)
        assert permuted_places(np.arange(n), n, tables).tolist() == want
        assert sum(len(t) for t in (*tables[0], tables[1])) <= 5 * sum(sides(n))  # not one hash per row


def test_looked_up_walks_end_for_every_size():
    for n in range(1, 120):  # some rectangles have cells outside that only lead to each other
        places = permuted_places(np.arange(n), n, round_tables(n, 42, "a", n % 5))
        assert sorted(places.tolist()) == list(range(n))


def test_missing_values_move_as_missing(spark):
    rows = spark.createDataFrame([(i, i + 1, None if i % 3 else float(i)) for i in range(30)], "id long, __i long, x double")
    moved = X._moved_values(rows, ["x"], 2, 30, 42).collect()
    assert X._moved_values(rows.limit(0), ["x"], 2, 0, 42).count() == 0
    assert len(moved) == 60 and {r["__to"] for r in moved if r["rep"] == 1} == set(range(1, 31))
    assert sorted(r["__v"] for r in moved if r["__v"] is not None) == sorted([float(i) for i in range(0, 30, 3)] * 2)
