"""Multilayer perceptron (D11): MLlib's network, objective and start, with gradients by matrix products in NumPy.

MLlib asks for a gradient by a job of its own and multiplies matrices of 128 rows. Here the
method stays (cross-entropy of a softmax over sigmoid layers, L-BFGS from MLlib's seeded
weights, its rules for the end), and the model is MLlib's. Up to LOCAL_ROWS rows the whole fit is one
task, without a job per step, so that fits of folds run side by side; more rows are held as one
array per partition and every step is one job that sums gradients. Up to MLLIB_ROWS rows MLlib fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlab.operators.lbfgs import minimise

MLLIB_ROWS = 5_000
LOCAL_ROWS = 100_000
ROWS_AT_MOST = 200_000   # of a partition
BLOCK_ROWS = 512         # rows whose layers are held at a time


def loss_and_gradient(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of the cross-entropy and of its gradient; weights lie as MLlib's do."""
    gradient, at, affine = np.zeros_like(weights), 0, []
    for n_in, n_out in zip(layers, layers[1:]):
        w, b = slice(at, at + n_in * n_out), slice(at + n_in * n_out, at + (n_in + 1) * n_out)
        affine.append((weights[w].reshape(n_in, n_out), weights[b], gradient[w].reshape(n_in, n_out), gradient[b]))
        at = b.stop
    loss, classes = 0.0, np.arange(layers[-1])
    with np.errstate(over="ignore"):
        for start in range(0, len(x), BLOCK_ROWS):
            outs = [x[start:start + BLOCK_ROWS]]
            for w, b, _, _ in affine[:-1]:
                z = outs[-1] @ w
                z += b
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1.0
                outs.append(np.reciprocal(z, out=z))
            w, b, _, _ = affine[-1]
            z = outs[-1] @ w + b
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e.sum(axis=1, keepdims=True)
            is_class = y[start:start + BLOCK_ROWS, None] == classes
            loss += float(np.log(total).sum() - z[is_class].sum())
            delta = e / total - is_class
            for i in range(len(affine) - 1, -1, -1):
                w, _, gw, gb = affine[i]
                gw += outs[i].T @ delta
                gb += delta.sum(axis=0)
                if i:
                    delta = delta @ w.T
                    delta *= outs[i]
                    delta *= 1.0 - outs[i]
    return loss, gradient


class NetworkClassifier(Estimator):
    """``layers`` from the number of features to that of classes."""

    def __init__(self, layers: Sequence[int], max_iter: int, seed: int = 42):
        super().__init__()
        self.layers, self.max_iter, self.seed, self.label_col, self.features_col = list(layers), max_iter, seed, "label", "features"

    def setLabelCol(self, name: str) -> "NetworkClassifier":
        self.label_col = name
        return self

    def setFeaturesCol(self, name: str) -> "NetworkClassifier":
        self.features_col = name
        return self

    def _mllib(self, **params):
        return MultilayerPerceptronClassifier(layers=self.layers, seed=self.seed, blockSize=128, labelCol=self.label_col,
                                              featuresCol=self.features_col, **params)

    def _fit(self, dataset: DataFrame):
        n = dataset.count()
        if n <= MLLIB_ROWS:
            return self._mllib(maxIter=self.max_iter).fit(dataset)
        spark = dataset.sparkSession
        # no step of MLlib's own: it gives the start, and takes the weights found
        one = spark.createDataFrame([(0.0, Vectors.dense([0.0] * self.layers[0]))], [self.label_col, self.features_col])
        start = self._mllib(maxIter=0).fit(one).weights.toArray()
        rows = dataset.select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y"))
        found = self._in_one_task(rows, start, n) if n <= LOCAL_ROWS else self._by_jobs(rows, start, n)
        return self._mllib(maxIter=0, initialWeights=Vectors.dense(found)).fit(one)

    def _in_one_task(self, rows: DataFrame, start: np.ndarray, n: int) -> np.ndarray:
        layers, most = self.layers, self.max_iter

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = arrays(batches, layers[0])
            if len(x):
                def mean(w):
                    loss, gradient = loss_and_gradient(w, layers, x, y)
                    return loss / n, gradient / n
                w, _ = minimise(mean, start, most)
                yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

        return np.array(rows.repartition(1).mapInArrow(fit, "w array<double>").first()["w"])   # the weights

    def _by_jobs(self, rows: DataFrame, start: np.ndarray, n: int) -> np.ndarray:
        layers = self.layers
        tasks = max(-(-n // ROWS_AT_MOST), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (LOCAL_ROWS // 2))))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, y = arrays(batches, layers[0])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

        held = rows.repartition(tasks).mapInArrow(packed, "x binary, y binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

        def mean(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(blocks):
                for x, y in blocks:
                    yield loss_and_gradient(w, layers, np.frombuffer(x).reshape(-1, layers[0]), np.frombuffer(y))

            parts = held.mapPartitions(part).collect()     # a number and a gradient per task
            return sum(f for f, _ in parts) / n, np.sum([g for _, g in parts], axis=0) / n

        try:
            return minimise(mean, start, self.max_iter)[0]
        finally:
            held.unpersist()


def arrays(batches: Iterator[pa.RecordBatch], p: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the batches (x, y) of a task."""
    xs, ys = [np.empty((0, p))], [np.empty(0)]
    for batch in batches:
        xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p))
        ys.append(batch.column(1).to_numpy(zero_copy_only=False))
    return np.concatenate(xs), np.concatenate(ys)
