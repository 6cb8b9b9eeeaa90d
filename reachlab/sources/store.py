"""Attribution store (A5, A6): versioned Parquet folders behind a commit log.

Layout: ``<root>/<dataset>/<model>/<kind>/`` holds ``data-<uuid>/`` folders and
``commits/``. A write goes to a data folder of its own; only when all its files are
there is a commit created, a file named by its number and the data folder it stands
for. Readers take the last commit: they see a whole version or the one before, never
half a write, and a writer that fails leaves nothing that anyone reads. Storing one
model never touches another; a read opens the folder of one (dataset, model, kind).

No commit is the only miss: ``compute`` runs then, and its result is stored.
Anything else that goes wrong with a read (permissions, disk, a file that is no
Parquet) is raised, so that what cannot be read is never overwritten. The default
location is under the cluster's shared checkpoint folder (``spark.checkpoint.dir``),
never a machine-local path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlab.session import ensure_checkpoint_dir

SHAP = "shap"
_DIGITS = 12


def default_store(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/attribution_store"


def dataset_key(address: str) -> str:
    """A folder name for a dataset: its whole address, so that like-named folders differ."""
    return quote(address.rstrip("/"), safe="")


def _folder(root: str, dataset: str, model: str, kind: str) -> str:
    return "/".join([root.rstrip("/"), *(quote(x, safe="") for x in (dataset, model, kind))])


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as Hadoop names them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _commits(spark: SparkSession, folder: str) -> list[str]:
    """Names of the commits, first to last."""
    store, target = hadoop_path(spark, f"{folder}/commits")
    if not store.exists(target):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(target) if not f.getPath().getName().startswith((".", "_")))


def write(df: DataFrame, root: str, dataset: str, model: str, kind: str = SHAP) -> None:
    """Store ``df`` as the next version of (dataset, model, kind)."""
    spark = df.sparkSession
    folder = _folder(root, dataset, model, kind)
    version = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    number = int(([*_commits(spark, folder)] or ["0"])[-1].split("-")[0]) + 1
    store, target = hadoop_path(spark, f"{folder}/commits/{number:0{_DIGITS}d}-{version}")
    store.create(target, False).close()  # refuses to replace a commit


def read(spark: SparkSession, root: str, dataset: str, model: str, kind: str = SHAP) -> DataFrame | None:
    """The last version of (dataset, model, kind); None if there is no commit."""
    folder = _folder(root, dataset, model, kind)
    commits = _commits(spark, folder)
    if not commits:
        return None
    return spark.read.parquet(f"{folder}/{commits[-1].split('-', 1)[1]}")


def load(spark: SparkSession, root: str, dataset: str, model: str, kind: str = SHAP,
         compute: Callable[[], DataFrame] | None = None) -> DataFrame | None:
    """The stored rows; on a miss they are computed, stored and read back."""
    hit = read(spark, root, dataset, model, kind)
    if hit is None and compute is not None:
        write(compute(), root, dataset, model, kind)
        hit = read(spark, root, dataset, model, kind)
    return hit


def store_attributions(attr: DataFrame, root: str, dataset: str) -> None:
    """Store the attributions of each model in ``attr`` as its next version."""
    for row in attr.select("model").distinct().collect():  # one row per model
        write(attr.where(F.col("model") == row["model"]), root, dataset, row["model"])


def load_attributions(spark: SparkSession, root: str, dataset: str, model: str,
                      compute: Callable[[], DataFrame] | None = None) -> DataFrame | None:
    """Stored attributions of (dataset, model); ``compute`` may give those of several models."""
    of_model = None if compute is None else lambda: compute().where(F.col("model") == model)
    return load(spark, root, dataset, model, compute=of_model)


def vacuum(spark: SparkSession, root: str, dataset: str, model: str, kind: str = SHAP) -> int:
    """Delete the data folders of all versions but the last; how many there were."""
    folder = _folder(root, dataset, model, kind)
    old = _commits(spark, folder)[:-1]
    for name in old:
        for path in (f"{folder}/commits/{name}", f"{folder}/{name.split('-', 1)[1]}"):
            store, target = hadoop_path(spark, path)
            store.delete(target, True)
    return len(old)
