"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlab.session import ensure_checkpoint_dir

# White space of every word rule in this package: U+0020 and U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is the session's ``spark.checkpoint.dir``; without that setting, the folder
    of the context (the session helper makes one for local masters).
    """
    folder = ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or folder).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/reachlab-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and with column
    pruning for later readers; a lost executor loses none of it.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._reachlab_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_reachlab_path", None)
    if path:
        delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def with_new_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns whose names (any letter case) an operator is about to add."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns, in that order; extra input columns play no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for work on Python copies of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
