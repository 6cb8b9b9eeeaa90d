"""Connected components of a large link table by alternating star contraction.

Every round is joins and aggregates over the links alone; nothing is collected
but two counters. Each round ends in a table in the shared folder, so that a
lost executor never restarts the iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    up = both.where("b > a").join(least, F.col("a") == F.col("node"))
    return up.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    down = links.join(least, F.col("a") == F.col("node")).where("b <> m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long, undirected).

    ``component`` is the smallest node that can be reached. Nulls, links of a
    node to itself and repeated links say nothing and are left out; no links
    give no rows. Each node's links go through joins that Spark can split, so
    one node may hold any share of the links.
    """
    a, b = links.columns[:2]
    now = materialise(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(f"`{a}` is not null and `{b}` is not null and a <> b").distinct(), label)
    state = _state(now)
    while state[0]:
        nxt = materialise(_small_star(_large_star(now).distinct()).distinct(), label)
        discard(now)
        now, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    least = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(least)
