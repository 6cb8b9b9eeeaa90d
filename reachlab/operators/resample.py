"""SMOTE oversampling (D6) with exact k-nearest neighbours at scale.

Neighbours are searched among the minority rows only, in feature space,
without forming all pairs:

1. cells: a sample of the rows (md5(seed|id) order, SAMPLE_PER_CELL for each
   cell) is halved at the median of the component that varies most, until a part
   stands for about ROWS_PER_CELL rows; these cuts send every row to its cell;
2. each cell's box is the least and largest value of all its rows per component,
   the box of an inner node that of its two children;
3. within each cell, neighbours are found by brute force, a block of rows
   against a block of members per task;
4. a row whose k-th neighbour distance is r must also look at another cell only
   if the cell's box is no farther than r. It goes down the tree and leaves out
   whatever lies under a box beyond r; those (row, cell) pairs meet the cell's
   members in the same blocks, each of which gives at most k rows within r. The
   final k are the smallest distances, ties by id.

The answer is exact: cells only prune pairs that provably cannot be among the
k nearest. Identical vectors are a hot-group risk (one cell would hold them
all): rows are first ranked by id within each group of identical vectors
(range-partitioned ranks), only the first k + 1 of a group take part in the
search, and every later member's neighbours are the group's first k members
at distance 0 -- what the search would return, since ties break by id.

Synthetic rows: class balance needs n_major - n_minor rows; each
minority row gets an equal share (the remainder goes to the first rows in
md5 order); sample s of row i interpolates towards the neighbour picked by
hash(seed, i, s) with a gap hash_unit(seed, i, s, 'gap'), so the output is
deterministic and every synthetic row lies on a segment between two
minority rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reachlab.functions.columns import hash_order, hash_unit
from reachlab.session import ensure_checkpoint_dir

# --- fixed values of the resampler (library defaults of the reference) -----------------
K_NEIGHBORS = 5
SEED = 42
# -----------------------------------------------------------------------------------------
ROWS_PER_CELL = 2000
SAMPLE_PER_CELL = 16
# Cells that a task compares a row with; cells larger than ROWS_PER_CELL are
# searched in blocks, so this bounds memory, not the data.
MAX_CELLS = 4096
BLOCK_ROWS = 256  # rows of one distance matrix
PROBES_PER_BLOCK = 8  # times ROWS_PER_CELL


@dataclass
class _Tree:
    """Nested cuts: node i sends rows with component[i] <= cut[i] to left[i], others to left[i] + 1; leaves have left -1."""

    component: np.ndarray
    cut: np.ndarray
    left: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, on = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(on):
            on = on[self.left[node[on]] >= 0]
            at = node[on]
            node[on] = self.left[at] + (x[on, self.component[at]] > self.cut[at])
        return node

    def boxes(self, found: Mapping[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest values under each node, from those of the leaves (an empty one is nowhere)."""
        p = len(next(iter(found.values()))[0])
        low, high = np.full((len(self.left), p), np.inf), np.full((len(self.left), p), -np.inf)
        for i in range(len(self.left) - 1, -1, -1):     # children come after their parent
            if self.left[i] < 0:
                if i in found:
                    low[i], high[i] = found[i]
            else:
                pair = slice(self.left[i], self.left[i] + 2)
                low[i], high[i] = np.fmin.reduce(low[pair]), np.fmax.reduce(high[pair])
        return low, high

    def reach(self, x: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves whose box is within ``r`` of the row; never too strict by rounding."""
        rows, leaves = [], []
        q, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        while len(q):
            away = np.maximum(np.maximum(low[node] - x[q], x[q] - high[node]), 0.0)
            near = np.sqrt((away * away).sum(1)) <= r[q] * (1.0 + 1e-9) + 1e-9
            q, node = q[near], node[near]
            end = self.left[node] < 0
            rows.append(q[end])
            leaves.append(node[end])
            q, node = np.repeat(q[~end], 2), (self.left[node[~end]][:, None] + np.arange(2)).ravel()
        return np.concatenate(rows), np.concatenate(leaves)


def _cut_sample(sample: np.ndarray, cells: int) -> _Tree:
    """Cuts of the sample at medians of the component that varies most, down to its share of a cell."""
    sample = sample[np.isfinite(sample).all(1)]
    least = len(sample) / cells
    component, cut, left = [0], [0.0], [-1]
    parts = [(0, sample)]
    for node, part in parts:                            # grows while it is read
        if len(part) <= least or len(part) < 2:
            continue
        j = int(part.var(0).argmax())
        values = np.sort(part[:, j])
        at = values[(len(part) - 1) // 2]
        if at == values[-1]:                            # nothing beyond the median: cut below it
            at = values[max(0, int(np.searchsorted(values, at)) - 1)]
        if at == values[-1]:
            continue
        component[node], cut[node], left[node] = j, float(at), len(left)
        on = part[:, j] <= at
        parts += [(len(left), part[on]), (len(left) + 1, part[~on])]
        component += [0, 0]
        cut += [0.0, 0.0]
        left += [-1, -1]
    return _Tree(np.array(component), np.array(cut), np.array(left))


def _cells(points: DataFrame, n: int, seed: int) -> _Tree:
    cells = max(1, min(MAX_CELLS, math.ceil(n / ROWS_PER_CELL)))
    share = 1.0 if cells == 1 else min(1.0, cells * SAMPLE_PER_CELL / n)
    if cells == 1:
        return _Tree(np.array([0]), np.array([0.0]), np.array([-1]))
    rows = points.where(hash_unit(seed, "id", F.lit("cell")) < share).select("x").collect()  # about 65,536 at most
    return _cut_sample(np.array([r["x"] for r in rows], dtype=float), cells)


def exact_knn(points: DataFrame, k: int = K_NEIGHBORS, seed: int = SEED,
              wanted: DataFrame | None = None) -> DataFrame:
    """(id, nbr, dist, rank) for the k nearest other rows of ``points(id, x
    array<double>)``; Euclidean distance, ties by neighbour id. With
    ``wanted(id)`` only these rows' neighbours are searched, among all points."""
    from reachlab.functions.ordered import rank_within

    only = lambda df: df if wanted is None else df.join(wanted, "id", "left_semi")
    dup = rank_within(points.select("id", "x"), ["x"], "id", "id", out="__d")
    dup = dup.persist(StorageLevel.MEMORY_AND_DISK)
    head = dup.where(F.col("__d") <= k + 1).select("id", "x")
    near = _search(head, k, seed, only)
    firsts = dup.where(F.col("__d") <= k).select("x", F.col("id").alias("nbr"), F.col("__d").alias("rank"))
    tail = only(dup.where(F.col("__d") > k + 1).select("id", "x")).join(firsts, "x").select(
        "id", "nbr", F.lit(0.0).alias("dist"), F.col("rank").cast("int").alias("rank"))
    out = near.unionByName(tail).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    dup.unpersist()
    return out


def _top_k(ids_x: np.ndarray, x: np.ndarray, within: np.ndarray, ids_y: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of ``y`` for each row of ``x`` (never itself) among those ``within`` its
    distance, ties by id.

    A block of rows at a time: dot products give all squared distances of the
    block in one matrix, whose rounding error bounds who can be among the k;
    those few get their exact distance.
    """
    query, nbr, dist = [], [], []
    yy = (y * y).sum(1)
    for at in range(0, len(x), BLOCK_ROWS):
        block, ids, last = x[at:at + BLOCK_ROWS], ids_x[at:at + BLOCK_ROWS], within[at:at + BLOCK_ROWS] ** 2
        xx = (block * block).sum(1)
        d2 = xx[:, None] + yy[None, :] - 2.0 * (block @ y.T)
        d2[ids[:, None] == ids_y[None, :]] = np.inf
        if np.isinf(last).any():
            last = np.minimum(last, np.partition(d2, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1])
        slack = 1e-9 * (xx + np.nanmax(yy, initial=0.0) + 1.0)
        r, c = np.nonzero((d2 <= (last + slack)[:, None]) & np.isfinite(d2))
        exact = np.sqrt(((y[c] - block[r]) ** 2).sum(1))
        order = np.lexsort((ids_y[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        query.append(ids[r[best]])
        nbr.append(ids_y[c[best]])
        dist.append(exact[best])
    return pd.DataFrame({"id": np.concatenate(query), "nbr": np.concatenate(nbr), "dist": np.concatenate(dist)}).astype(
        {"id": "int64", "nbr": "int64", "dist": "float64"})


def _search(points: DataFrame, k: int, seed: int, only: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pivot-cell search over rows whose identical-vector groups are at most k + 1,
    for those that ``only`` leaves."""
    spark = points.sparkSession
    pts = points.select("id", "x").persist(StorageLevel.MEMORY_AND_DISK)
    n = pts.count()
    tree = _cells(pts, n, seed)
    btree = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "x": pdf["x"], "cell": btree.value.leaf(np.stack(pdf["x"].to_numpy()))})

    def bounds(batches):
        found: dict = {}                                # of the cells that come in this task
        for pdf in batches:
            for c, part in pdf.groupby("cell"):
                x = np.stack(part["x"].to_numpy())
                low, high = found.get(c, (x[0], x[0]))
                found[c] = np.fmin(low, np.fmin.reduce(x)), np.fmax(high, np.fmax.reduce(x))
        if found:
            yield pd.DataFrame({"cell": list(found), "low": [a for a, _ in found.values()], "high": [b for _, b in found.values()]})

    def widest(pdf):
        return pd.DataFrame({"cell": pdf["cell"][:1], "low": [np.fmin.reduce(np.stack(pdf["low"].to_numpy()))],
                             "high": [np.fmax.reduce(np.stack(pdf["high"].to_numpy()))]})

    cells = pts.mapInPandas(assign, "id long, x array<double>, cell long").persist(StorageLevel.MEMORY_AND_DISK)
    box = "cell long, low array<double>, high array<double>"
    found = cells.mapInPandas(bounds, box).groupBy("cell").applyInPandas(widest, box).collect()   # <= MAX_CELLS rows
    bbox = spark.sparkContext.broadcast(tree.boxes({r["cell"]: (r["low"], r["high"]) for r in found}) if found else None)
    members = cells.select("cell", F.col("id").alias("nbr"), F.col("x").alias("y"))
    asked = only(cells)
    everything = F.lit(math.inf).alias("r")
    local = _meet(asked.select("id", "x", "cell", everything), members, k).persist(StorageLevel.MEMORY_AND_DISK)
    kth = local.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("r"))
    probe = asked.join(kth, "id", "left").select(
        "id", "x", "cell", F.when(F.col("c") >= k, F.col("r")).otherwise(F.lit(math.inf)).alias("r"))

    def other_cells(batches):
        low, high = bbox.value
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at:at + BLOCK_ROWS]
                x, r = np.stack(part["x"].to_numpy()), part["r"].to_numpy()
                qi, ci = btree.value.reach(x, r, low, high)
                other = ci != part["cell"].to_numpy()[qi]
                qi, ci = qi[other], ci[other]
                if len(qi):
                    yield pd.DataFrame({"id": part["id"].to_numpy()[qi], "x": part["x"].to_numpy()[qi],
                                        "cell": ci, "r": r[qi]})

    probes = probe.mapInPandas(other_cells, "id long, x array<double>, cell long, r double")
    cand = local.unionByName(_meet(probes, members, k))
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    out = cand.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    out = out.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    local.unpersist()
    cells.unpersist()
    pts.unpersist()
    return out


def _meet(probes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, nbr, dist): each probe's k nearest members of its cell within ``r``, at most k rows per probe.

    A cell's members are dealt into blocks of about ROWS_PER_CELL rows, its probes
    into blocks of PROBES_PER_BLOCK times as many; each block of probes meets each block of members in a task of its own.
    """
    sizes = lambda df, name, rows: df.groupBy(F.col("cell").alias(f"{name}_cell")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("long").alias(name))
    counts = sizes(probes, "p_blocks", PROBES_PER_BLOCK * ROWS_PER_CELL).join(sizes(members, "m_blocks", ROWS_PER_CELL), F.col("p_blocks_cell") == F.col("m_blocks_cell"))
    counts = counts.select(F.col("p_blocks_cell").alias("c"), "p_blocks", "m_blocks").persist()
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    # new names on both sides: the two derive from the same cells
    p = probes.join(counts, F.col("cell") == F.col("c")).select(
        F.col("cell").alias("pc"), F.pmod(F.xxhash64("id"), "p_blocks").alias("pb"), each("m_blocks").alias("pm"),
        F.col("id").alias("pid"), F.col("x").alias("px"), F.col("r").alias("pr"))
    m = members.join(counts, F.col("cell") == F.col("c")).select(
        F.col("cell").alias("mc"), each("p_blocks").alias("mp"), F.pmod(F.xxhash64("nbr"), "m_blocks").alias("mb"),
        F.col("nbr").alias("mid"), F.col("y").alias("my"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "nbr": [], "dist": []}).astype({"id": "int64", "nbr": "int64"})
        return _top_k(a["pid"].to_numpy(), np.stack(a["px"].to_numpy()), a["pr"].to_numpy(dtype=float), b["mid"].to_numpy(),
                      np.stack(b["my"].to_numpy()), k)

    return p.groupBy("pc", "pb", "pm").cogroup(m.groupBy("mc", "mp", "mb")).applyInPandas(
        nearest, "id long, nbr long, dist double")


def fold_neighbours(points: DataFrame, folds: int, k: int = K_NEIGHBORS, margin: int | None = None,
                    seed: int = SEED) -> DataFrame:
    """(held, id, nbr, dist, rank): each row's k nearest rows when fold ``held`` is left out.

    ``points(id, x, fold)`` lie in one space for all folds. Their neighbours are
    searched once, ``margin`` (default: k) more than needed. Leaving a fold out only
    takes neighbours away, so who still has k of them has the right ones; only the
    rows left with fewer search again, among the rows of the other folds. A row has
    no neighbours for its own fold.
    """
    ensure_checkpoint_dir(points.sparkSession)  # each step's plan is long: lineage is cut between them
    margin = k if margin is None else margin
    points = points.checkpoint()
    fold_of = points.select(F.col("id").alias("nbr"), F.col("fold").alias("nbr_fold"))
    graph = _cut(exact_knn(points, k + margin, seed))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: (f != F.col("fold")) & (f != F.col("nbr_fold")))
    left = graph.join(points.select("id", "fold"), "id").join(fold_of, "nbr").select(
        "id", "nbr", "dist", F.explode(others).alias("held"))
    w = Window.partitionBy("held", "id").orderBy("dist", "nbr")  # k + margin rows at most
    left = left.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    left = left.select("held", "id", "nbr", "dist", "rank").checkpoint()
    sizes = {r["fold"]: r["count"] for r in points.groupBy("fold").count().collect()}  # one row per fold
    out = None
    for held in range(folds):
        need = min(k, sum(n for f, n in sizes.items() if f != held) - 1)
        rest = points.where(F.col("fold") != held)
        found = left.where(F.col("held") == held)
        enough = found.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= need).select("id")
        short = rest.join(enough, "id", "left_anti").select("id").checkpoint()
        if need > 0 and short.take(1):
            new = _cut(exact_knn(rest, k, seed, wanted=short)).withColumn("held", F.lit(held))
            found = found.join(short, "id", "left_anti").unionByName(new)
        out = found if out is None else out.unionByName(found)
    return out.checkpoint()


def _cut(persisted: DataFrame) -> DataFrame:
    """The rows of a persisted result in the shared folder, without its lineage."""
    out = persisted.checkpoint()
    persisted.unpersist()
    return out


def smote(train: DataFrame, features: Sequence[str], label: str = "label", k: int = K_NEIGHBORS,
          seed: int = SEED, neighbours: DataFrame | None = None) -> DataFrame:
    """Return ``train`` plus synthetic minority rows (``synthetic`` flag,
    ``base_id`` and ``nbr_id`` for traceability) so both classes are equal.

    ``neighbours(id, nbr, rank)``: the minority rows' k nearest minority rows, if
    they are known already (``fold_neighbours``)."""
    feats = list(features)
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}   # 2 rows
    if len(counts) < 2:
        return train.withColumn("synthetic", F.lit(False))
    minority = min(counts, key=lambda c: (counts[c], c))
    m, need = counts[minority], max(counts.values()) - counts[minority]
    if need and m < 2:
        raise ValueError("oversampling needs at least two minority rows to interpolate between")
    base = train.withColumn("synthetic", F.lit(False)).withColumn(
        "base_id", F.lit(None).cast("long")).withColumn("nbr_id", F.lit(None).cast("long"))
    if need == 0:
        return base
    vec = F.array(*[F.col(c).cast("double") for c in feats])
    mino = train.where(F.col(label) == minority).select("id", vec.alias("x"))
    knn = exact_knn(mino, k, seed) if neighbours is None else neighbours
    kk = min(k, m - 1)
    share, extra = divmod(need, m)
    ranked = mino.withColumn("__h", F.conv(F.substring(hash_order(seed, "id"), 1, 15), 16, 10)
                             .cast("long"))
    from reachlab.functions.ordered import rank_within
    ranked = rank_within(ranked.withColumn("__g", F.lit(0)), ["__g"], "__h", "id", out="__r")
    reps = ranked.select("id", "x", (F.lit(share) + F.when(F.col("__r") <= extra, 1).otherwise(0))
                         .alias("c")).where(F.col("c") > 0)
    samples = reps.select("id", "x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("s"))
    pick = (F.conv(F.substring(hash_order(seed, "id", "s"), 1, 8), 16, 10).cast("long") % kk) + 1
    samples = samples.withColumn("rank", pick.cast("int")).withColumn(
        "gap", hash_unit(seed, F.col("id"), F.col("s"), F.lit("gap")))
    with_nbr = samples.join(knn.select("id", "rank", "nbr"), ["id", "rank"])
    nbr_x = mino.select(F.col("id").alias("nbr"), F.col("x").alias("y"))
    j = with_nbr.join(nbr_x, "nbr")
    new_x = F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a))
    # one number per (row, sample): a row has at most share + 1 samples
    synth = j.select((-(F.col("id") * F.lit(share + 1) + F.col("s") + 1)).alias("id"), new_x.alias("z"),
                     F.col("id").alias("base_id"), F.col("nbr").alias("nbr_id"))
    synth = synth.select("id", *[F.col("z")[i].alias(c) for i, c in enumerate(feats)],
                         F.lit(minority).cast(train.schema[label].dataType).alias(label),
                         F.lit(True).alias("synthetic"), "base_id", "nbr_id")
    keep = ["id", *feats, label, "synthetic", "base_id", "nbr_id"]
    return base.select(*keep).unionByName(synth.select(*keep))
