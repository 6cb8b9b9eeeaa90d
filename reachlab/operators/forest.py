"""Random forest (D9) whose trees are grown where their rows are.

MLlib grows all trees level by level and keeps a dense histogram for each node, be it of
two rows, and the whole forest in the driver. Here the method stays (bootstrap weights,
features binned by quantiles, a random subset of the features per node, Gini gain, leaves
of one parent with the same class merged), but the work is dealt by (tree, node):

1. rows are binned once; how often a tree draws a row is Poisson(1) of a hash of (seed,
   row, tree), so that no drawn copy is stored;
2. nodes of more than LOCAL_ROWS rows are split by histograms added up over all partitions,
   a level of all trees per pass; only these few splits come to the driver;
3. the rows of every smaller node go to one group, which grows the rest of its subtree.

The model is a table of nodes in the shared folder, in blocks of trees. Scoring reads
the blocks one after the other, so that a task holds a few of them.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlab.session import ensure_checkpoint_dir

MAX_BINS = 32
LOCAL_ROWS = 100_000       # a node of at most so many rows is grown in one group
NODES_AT_ONCE = 1024       # nodes whose histograms a group holds at a time
HISTOGRAMS_SENT = 256      # of a task, at a time
TREES_PER_FILE = 8
BLOCKS_HELD = 8            # blocks of trees that a scoring task keeps
LEAST_GAIN = 1e-12
NODES = ("tree int, node long, left long, right long, feature int, threshold double, cover double, value double, "
          "gain double")
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often ``tree`` draws each row: Poisson(1) of a hash of (seed, row, tree)."""
    salt = _mix(np.array([seed * 1_000_003 + tree + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = _mix(_mix(rows.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ salt)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(float) / 2.0**53, side="right")


def _edges(x: DataFrame, p: int) -> list[np.ndarray]:
    """Per feature the values that a split may have: all but the last, or quantiles if there are many."""
    names = [f"f{j}" for j in range(p)]
    cols = x.select(*[F.col("x")[j].alias(c) for j, c in enumerate(names)])
    about = cols.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = [c for c in names if about[c] <= 1.5 * MAX_BINS]
    many = [c for c in names if c not in few]
    found = {}
    if few:
        found |= cols.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict()   # about MAX_BINS values each
    if many:
        shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
        found |= {c: [*q, math.inf] for c, q in zip(many, cols.approxQuantile(many, shares, 0.001))}
    out = []
    for c in names:
        v = np.unique(np.array(found[c], dtype=float))[:-1]
        out.append(v if len(v) < MAX_BINS else v[np.linspace(0, len(v) - 1, MAX_BINS - 1).astype(int)])
    return out


def _best(hist: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """hist (nodes, features, bins, 3: weight, weight of class 1, rows) -> per node the place
    of its best split, the gain, and the left side's (weight, class 1, rows)."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    total = hist[:, :1].sum(axis=2, keepdims=True)
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gini = lambda s: 2.0 * s[..., 1] * (s[..., 0] - s[..., 1]) / s[..., 0]  # noqa: E731 (times the weight)
        gain = (gini(total) - gini(left) - gini(right)) / total[..., 0]
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -1.0)
    flat = np.nan_to_num(gain, nan=-1.0).reshape(len(hist), -1)
    at = flat.argmax(axis=1)
    each = np.arange(len(hist))
    return at, flat[each, at], left.reshape(len(hist), -1, 3)[each, at]


def _subsets(rng: np.random.Generator, nodes: int, p: int, m: int) -> np.ndarray:
    return np.argsort(rng.random((nodes, p)), axis=1)[:, :m]


def _histograms(bins, feats, node, y, w, k: int) -> np.ndarray:
    """(k, m, MAX_BINS, 3) of rows at nodes 0..k-1, each over its node's features."""
    m = feats.shape[1]
    chosen = np.take_along_axis(bins, feats[node], axis=1).astype(np.int64)
    key = ((node[:, None] * m + np.arange(m)) * MAX_BINS + chosen).ravel()
    sums = [np.bincount(key, np.repeat(v, m), k * m * MAX_BINS) for v in (w, w * y, np.ones(len(w)))]
    return np.stack(sums, axis=1).reshape(k, m, MAX_BINS, 3)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, m: int, depth: int, least: int,
         rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The subtree under ``root``, a level at a time. Node i has the children 2i and 2i + 1."""
    names = np.array([root], dtype=np.int64)
    at = np.zeros(len(y), dtype=np.int64)            # each row's node among ``names``
    levels = []
    while len(names):
        k = len(names)
        cover, positive = np.bincount(at, w, k), np.bincount(at, w * y, k)
        feature, cut, gain = np.full(k, -1), np.zeros(k, dtype=np.int64), np.zeros(k)
        ends = (positive <= 0) | (positive >= cover)
        if int(names[0]).bit_length() - 1 < depth:
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(0, k + NODES_AT_ONCE, NODES_AT_ONCE))
            for c, first in enumerate(range(0, k, NODES_AT_ONCE)):
                rows, size = order[starts[c]:starts[c + 1]], min(NODES_AT_ONCE, k - first)
                feats = _subsets(rng, size, bins.shape[1], m)
                rows = rows[~ends[at[rows]]]
                if not len(rows):
                    continue
                place, won, _ = _best(_histograms(bins[rows], feats, at[rows] - first, y[rows], w[rows], size), least)
                here = slice(first, first + size)
                good = (won > LEAST_GAIN) & ~ends[here]
                feature[here] = np.where(good, feats[np.arange(size), place // (MAX_BINS - 1)], -1)
                cut[here], gain[here] = place % (MAX_BINS - 1), np.where(good, won, 0.0)
        levels.append(dict(node=names, feature=feature, cut=cut, gain=gain, cover=cover, positive=positive))
        splits = np.flatnonzero(feature >= 0)
        on = feature[at] >= 0
        bins, y, w, at = bins[on], y[on], w[on], at[on]
        right = bins[np.arange(len(at)), feature[at]] > cut[at]
        rank = np.full(k, -1)
        rank[splits] = np.arange(len(splits))
        at = 2 * rank[at] + right
        names = np.stack([2 * names[splits], 2 * names[splits] + 1], axis=1).ravel()
    kept = _merged(levels)
    return {c: np.concatenate([lv[c][ok] for lv, ok in zip(levels, kept)]) for c in levels[0]}


def _merged(levels: list[dict]) -> list[np.ndarray]:
    """Per level the nodes that stay: two leaves of one parent with the same class go into it (as in MLlib)."""
    kept = [np.ones(len(lv["node"]), dtype=bool) for lv in levels]
    for d in range(len(levels) - 2, -1, -1):
        lv, below = levels[d], levels[d + 1]
        splits = np.flatnonzero(lv["feature"] >= 0)
        leaf = (below["feature"] < 0).reshape(-1, 2).all(axis=1)
        said = (2 * below["positive"] > below["cover"]).reshape(-1, 2)
        gone = leaf & (said[:, 0] == said[:, 1])
        lv["feature"][splits[gone]] = -1
        lv["gain"][splits[gone]] = 0.0
        kept[d + 1] &= ~np.repeat(gone, 2)
    return kept


class ForestClassifier(Estimator):
    """Random forest of two classes, 0 and 1, on ``features`` with optional row weights."""

    def __init__(self, num_trees: int, max_depth: int, min_instances: int = 1, weight_col: str | None = None, seed: int = 42):
        super().__init__()
        self.num_trees, self.max_depth, self.min_instances = num_trees, max_depth, min_instances
        self.weight_col, self.seed, self.label_col, self.features_col = weight_col, seed, "label", "features"

    def setLabelCol(self, name: str) -> "ForestClassifier":
        self.label_col = name
        return self

    def setFeaturesCol(self, name: str) -> "ForestClassifier":
        self.features_col = name
        return self

    def _fit(self, dataset: DataFrame) -> "ForestModel":
        spark = dataset.sparkSession
        folder = ensure_checkpoint_dir(spark)
        trees, seed, depth, least, local = self.num_trees, self.seed, self.max_depth, self.min_instances, LOCAL_ROWS
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        # numbered and kept, so that every pass draws the same rows
        rows = dataset.select(F.monotonically_increasing_id().alias("r"), vector_to_array(self.features_col).alias("x"),
                              F.col(self.label_col).cast("double").alias("y"), weight.alias("w")).checkpoint()
        n = rows.count()
        p = len(rows.select("x").first()["x"])
        m = min(p, math.ceil(math.sqrt(p)))
        edges = _edges(rows, p)

        def drawn(batch: pa.RecordBatch, splits: dict) -> Iterator[tuple]:
            """(tree, drawn rows' bins, y, weight, node) of each tree."""
            r = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(r), p)
            y, w = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
            for t in range(trees):
                times = draws(r, t, seed)
                on = np.flatnonzero(times)
                node, b = np.ones(len(on), dtype=np.int64), bins[on]
                for name, (f, cut) in splits.get(t, {}).items():    # parents first
                    here = np.flatnonzero(node == name)
                    node[here] = 2 * name + (b[here, f] > cut)
                yield t, b, y[on], w[on] * times[on], node

        # nodes too large for one group: n * trees / LOCAL_ROWS of them at the most in a level
        splits, top, large = {}, [], [(t, 1) for t in range(trees)] if n > local else []
        while large:
            wanted = {}
            for t, name in large:
                wanted.setdefault(t, []).append(name)

            def histograms(batches, wanted=wanted, splits=splits):
                sums: dict = {}
                for batch in batches:
                    for t, b, y, w, node in drawn(batch, splits):
                        for name in wanted.get(t, []):
                            on = node == name
                            feats = _subsets(np.random.default_rng([seed, t, name]), 1, p, m)
                            h = _histograms(b[on], feats, np.zeros(int(on.sum()), dtype=np.int64), y[on], w[on], 1)
                            sums[t, name] = sums.get((t, name), 0.0) + h
                found = list(sums)
                for at in range(0, len(found), HISTOGRAMS_SENT):
                    part = found[at:at + HISTOGRAMS_SENT]
                    flat = np.stack([sums.pop(k).ravel() for k in part])
                    starts = pa.array(np.arange(len(part) + 1, dtype=np.int32) * flat.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t for t, _ in part], pa.int32()), pa.array([i for _, i in part], pa.int64()),
                         pa.ListArray.from_arrays(starts, pa.array(flat.ravel()))], names=["tree", "node", "h"])

            def best(pdf: pd.DataFrame) -> pd.DataFrame:
                t, name = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
                h = np.sum(np.stack(pdf["h"].to_numpy()), axis=0).reshape(1, m, MAX_BINS, 3)
                feats = _subsets(np.random.default_rng([seed, t, name]), 1, p, m)
                place, gain, left = _best(h, least)
                total = h[0, 0].sum(axis=0)
                good = gain[0] > LEAST_GAIN
                return pd.DataFrame([{"tree": t, "node": name, "gain": gain[0] if good else 0.0,
                                      "feature": int(feats[0, place[0] // (MAX_BINS - 1)]) if good else -1,
                                      "cut": int(place[0] % (MAX_BINS - 1)), "cover": total[0], "positive": total[1],
                                      "n": int(total[2]), "n_left": int(left[0, 2])}])

            found = rows.mapInArrow(histograms, "tree int, node long, h array<double>").groupBy("tree", "node").applyInPandas(
                best, "tree int, node long, gain double, feature int, cut int, cover double, positive double, n long, "
                "n_left long").collect()
            large = []
            for s in sorted(found, key=lambda s: (s["tree"], s["node"])):
                top.append(s)
                if s["feature"] < 0:
                    continue
                splits = {**splits, s["tree"]: {**splits.get(s["tree"], {}), s["node"]: (s["feature"], s["cut"])}}
                if s["node"].bit_length() < depth:
                    large += [(s["tree"], child) for child, size in ((2 * s["node"], s["n_left"]),
                                                                      (2 * s["node"] + 1, s["n"] - s["n_left"])) if size > local]
        done = {(s["tree"], s["node"]) for s in top if s["feature"] < 0}

        def deal(batches):
            for batch in batches:
                for t, b, y, w, node in drawn(batch, splits):
                    if done:
                        on = ~np.isin(node, [i for t2, i in done if t2 == t])
                        b, y, w, node = b[on], y[on], w[on], node[on]
                    # the rows of a node go as one record: per row its bins, label and weight
                    order = np.argsort(node, kind="stable")
                    names, starts = np.unique(node[order], return_index=True)
                    packed = lambda v: [v[o].tobytes() for o in np.split(order, starts[1:])]
                    if len(names):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(names), t, dtype=np.int32)), pa.array(names),
                             *[pa.array(packed(v), pa.binary()) for v in (b, y, w)]], names=["tree", "node", "b", "y", "w"])

        def subtree(table: pa.Table) -> pa.Table:
            t, root = table["tree"][0].as_py(), table["node"][0].as_py()
            b, y, w = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=d) for c, d in (("b", np.uint8), ("y", float), ("w", float)))
            b = b.reshape(len(y), p)
            got = grow(b, y, w, root, m, depth, least, np.random.default_rng([seed, t, root, 1]))
            inner = got["feature"] >= 0
            cuts = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(got["feature"], got["cut"])])
            return pa.table({"tree": np.full(len(inner), t, dtype=np.int32), "node": got["node"],
                             "left": np.where(inner, 2 * got["node"], -1), "right": np.where(inner, 2 * got["node"] + 1, -1),
                             "feature": got["feature"].astype(np.int32), "threshold": cuts, "cover": got["cover"],
                             "value": got["positive"] / got["cover"], "gain": got["gain"]})

        # a group each; AQE must not put many into one task
        groups = max(1, min(4 * trees, trees * -(-n // local)))
        nodes = rows.mapInArrow(deal, "tree int, node long, b binary, y binary, w binary") \
            .repartition(groups, "tree", "node").groupBy("tree", "node").applyInArrow(subtree, NODES)
        if top:
            nodes = nodes.unionByName(spark.createDataFrame(
                [(s["tree"], s["node"], 2 * s["node"] if s["feature"] >= 0 else -1,
                  2 * s["node"] + 1 if s["feature"] >= 0 else -1, s["feature"],
                  float(edges[s["feature"]][s["cut"]]) if s["feature"] >= 0 else 0.0, s["cover"],
                  s["positive"] / s["cover"], s["gain"]) for s in top], NODES))
        path = f"{folder}/forest-{uuid.uuid4().hex}"
        nodes.withColumn("tb", F.floor(F.col("tree") / TREES_PER_FILE).cast("int")) \
            .repartition(-(-trees // TREES_PER_FILE), "tb").write.partitionBy("tb").parquet(path)
        return ForestModel(spark, path, trees, p, self.features_col)


class ForestModel(Model):
    """A forest as a table of nodes in the shared folder."""

    def __init__(self, spark, path: str, num_trees: int, n_features: int, features_col: str):
        super().__init__()
        self.path, self.getNumTrees, self.n_features, self.features_col = path, num_trees, n_features, features_col
        self._spark, self._importances, self.treeWeights = spark, None, [1.0] * num_trees

    @staticmethod
    def _probability(total: np.ndarray, trees: int) -> np.ndarray:
        """Of class 1, from the weighted sum of the trees' values."""
        return total / trees

    def nodes(self) -> DataFrame:
        """(tree, node, left, right, feature, threshold, cover, value, gain); the root is node 1."""
        return self._spark.read.schema(NODES).parquet(self.path)

    @property
    def featureImportances(self):
        """Gain times cover per feature, as shares within each tree, averaged over the trees (as in MLlib)."""
        if self._importances is None:
            per = self.nodes().where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("v"))
            tree = per.groupBy("tree").agg(F.sum("v").alias("all"))
            rows = per.join(tree, "tree").groupBy("feature").agg(F.sum(F.col("v") / F.col("all")).alias("v")).collect()  # one per feature
            total = sum(r["v"] for r in rows) or 1.0
            out = np.zeros(self.n_features)
            for r in rows:
                out[r["feature"]] = r["v"] / total
            self._importances = Vectors.dense(out)
        return self._importances

    def _transform(self, dataset: DataFrame) -> DataFrame:
        path, trees, weights, probability = self.path, self.getNumTrees, self.treeWeights, self._probability
        blocks = -(-trees // TREES_PER_FILE)
        held: OrderedDict = OrderedDict()

        def block(i: int) -> list:
            if i not in held:
                held[i] = _read_block(f"{path}/tb={i}")
                if len(held) > BLOCKS_HELD:
                    held.popitem(last=False)
            return held[i]

        @F.pandas_udf("double")
        def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                if not len(xs):
                    yield pd.Series([], dtype="float64")
                    continue
                x, total = np.stack(xs.to_numpy()), np.zeros(len(xs))
                for i in [*held, *[i for i in range(blocks) if i not in held]]:
                    for weight, tree in zip(weights[i * TREES_PER_FILE:], block(i)):
                        total += weight * _score(tree, x)
                yield pd.Series(probability(total, trees))

        p1 = F.col("__p1")
        return dataset.withColumn("__p1", share(vector_to_array(self.features_col))) \
            .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p1, p1))) \
            .withColumn("prediction", (p1 > 0.5).cast("double")).drop("__p1")


def parquet_table(folder: str) -> pa.Table:
    """The rows of a folder of Parquet files in the shared folder, read by a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    files = [f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(where.open_input_file(f)).read() for f in files])


def _read_block(folder: str) -> list[tuple]:
    return [compact(g) for _, g in parquet_table(folder).to_pandas().groupby("tree")]


def compact(nodes: pd.DataFrame) -> tuple:
    """(feature, threshold, left, right, value) by place among the tree's sorted nodes; a leaf leads to itself."""
    g = nodes.sort_values("node")
    names, here = g["node"].to_numpy(), np.arange(len(g))
    inner = g["left"].to_numpy() >= 0
    to = lambda c: np.where(inner, np.searchsorted(names, g[c].to_numpy()), here)
    return (np.where(inner, g["feature"].to_numpy(), 0), g["threshold"].to_numpy(), to("left"), to("right"), g["value"].to_numpy())


def _score(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    node, on = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(on):
        at = node[on]
        to = np.where(x[on, feature[at]] <= threshold[at], left[at], right[at])
        node[on] = to
        on = on[to != at]
    return value[node]
