"""Memoised base tables for the query registry.

The reference caches its loaded and preprocessed frames; here the derived
customer table, the prepared table and the other shared inputs are
written once per application and state of the data directory (names, lengths and
times of its files, and the session's settings that change values) as Parquet into the cluster's
shared ``spark.checkpoint.dir`` and read back. That cuts their lineage (every
later query plans against a scan, with column pruning, pushdown and statistics)
and survives executor loss. ``scores`` and ``attributions`` are projections of
such a table and stay lazy. ``clear`` deletes what was written.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlab.operators.prep import prep_full
from reachlab.sources.campaign import campaign_raw
from reachlab.sources.fixtures import attributions_table, scores_table
from reachlab.sources.store import hadoop_path

_MEMO: dict[tuple, DataFrame] = {}
_PATHS: dict[tuple, str] = {}


# Settings that change what the same files give.
_SETTINGS = ["spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive"]


def _files(spark: SparkSession, folder: str) -> list:
    """What names the present files of ``folder``: names, lengths and times of those in it,
    and one sum over all files of its sub-folders (tables of many files), which Spark lists."""
    store, target = hadoop_path(spark, folder)
    found, folders = [], []
    if not store.exists(target):   # what reads it says so; what is made without it has no files
        return found
    for f in store.listStatus(target):   # one entry per table
        if f.isDirectory():
            folders.append(f.getPath().toString())
        else:
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    if folders:
        below = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        found.append(tuple(below.agg(F.count(F.lit(1)), F.bit_xor(each), F.sum("length")).first()))
    return sorted(found, key=repr)


def state_key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Equal as long as the files of ``sf_dir`` and the settings stay as they are."""
    said = repr((_files(spark, sf_dir), [spark.conf.get(s, None) for s in _SETTINGS]))
    return (spark.sparkContext.applicationId, sf_dir, hashlib.sha256(said.encode()).hexdigest(), name)


def _memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    k = state_key(spark, sf_dir, name)
    df = _MEMO.get(k)
    if df is None:
        from reachlab.session import ensure_checkpoint_dir
        built = build()
        path = f"{ensure_checkpoint_dir(spark)}/base-{name}-{uuid.uuid4().hex}"
        built.write.parquet(path)
        df = _MEMO[k] = spark.read.schema(built.schema).parquet(path)
        _PATHS[k] = path
    return df


def memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write ``build()`` once per application, name and state of the data directory."""
    return _memo(spark, sf_dir, name, build)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "raw", lambda: campaign_raw(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "prepared", lambda: prep_full(raw(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_table(raw(spark, sf_dir))


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributions_table(raw(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared table keyed by ``id`` with the target as ``label``."""
    return prepared(spark, sf_dir).withColumnRenamed("ID", "id").withColumnRenamed("Response", "label")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reachlab.operators.split import stratified_split
    return _memo(spark, sf_dir, "split", lambda: stratified_split(labelled(spark, sf_dir)))


_FITTED: dict[tuple, object] = {}


def fitted(spark: SparkSession, sf_dir: str, name: str, profile: str = "compare"):
    """A fitted pipeline per application, state of the data, model and profile."""
    from reachlab.operators.catalog import feature_list_names
    from reachlab.operators.models import fit_model
    k = state_key(spark, sf_dir, f"model:{name}:{profile}")
    if k not in _FITTED:
        sp = split(spark, sf_dir)
        feats = feature_list_names(sp, "label")
        _FITTED[k] = fit_model(name, sp.where(F.col("split") == "train"), feats, profile=profile)
    return _FITTED[k]


def fitted_all(spark: SparkSession, sf_dir: str, names: Sequence[str], profile: str = "compare") -> dict:
    """``fitted`` of each name. Fits are independent: a fit whose jobs leave slots free does not hold up the others."""
    split(spark, sf_dir)
    with ThreadPoolExecutor(max_workers=max(1, len(names))) as pool:
        return dict(zip(names, pool.map(lambda n: fitted(spark, sf_dir, n, profile), names)))


def clear(spark: SparkSession) -> None:
    """Forget this application's tables and models and delete the tables' files."""
    mine = [k for k in _MEMO if k[0] == spark.sparkContext.applicationId]
    for k in mine:
        del _MEMO[k]
        target = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(k))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    for k in [k for k in _FITTED if k[0] == spark.sparkContext.applicationId]:
        del _FITTED[k]
