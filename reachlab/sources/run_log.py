"""Run log sink (I1): appends that may be retried, and compaction.

Layout: ``<root>/data/<uuid>/`` holds the rows of one write, ``<root>/log/`` the
commits, empty files whose names say everything:

* ``batch.<batch id>.<uuid>``: the rows of a batch are in that data folder;
* ``compact.<number>.<uuid>``: that folder holds the rows of all batches that the
  table ``<root>/merged/<uuid>`` lists.

A commit is created only when its rows are written, so a reader never sees half a
batch. A batch that is committed already is not written again; should two writers
append the same batch at once, readers take the commit of the least name. Readers
take the last compaction and the batches that it does not list. ``vacuum`` deletes
what the last compaction has replaced. One compaction runs at a time.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reachlab.sources.store import hadoop_path

_DIGITS = 12


def _names(spark: SparkSession, folder: str) -> list[str]:
    store, target = hadoop_path(spark, folder)
    if not store.exists(target):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(target))


def _commit(spark: SparkSession, root: str, name: str) -> None:
    store, target = hadoop_path(spark, f"{root}/log/{name}")
    store.create(target, False).close()


class _State:
    """What the commits say: the last compaction, the batches in it, and those after it."""

    def __init__(self, spark: SparkSession, root: str):
        names = _names(spark, f"{root}/log")
        compactions = [n.split(".") for n in names if n.startswith("compact.")]
        self.number = int(compactions[-1][1]) if compactions else 0
        self.compacted = compactions[-1][2] if compactions else None
        # one row per batch: metadata of the log, like its list of files
        self.merged = {r["batch"] for r in spark.read.schema("batch string").parquet(
            f"{root}/merged/{self.compacted}").collect()} if self.compacted else set()
        self.batches: dict[str, str] = {}
        for n in names:
            if n.startswith("batch."):
                _, batch, folder = n.split(".")
                if unquote(batch) not in self.merged:
                    self.batches.setdefault(unquote(batch), folder)
        self.old = [n for n in names if n.split(".")[2] not in {self.compacted, *self.batches.values()}]

    def folders(self) -> list[str]:
        return ([self.compacted] if self.compacted else []) + list(self.batches.values())


def append(rows: DataFrame, root: str, batch: str) -> bool:
    """Append ``rows`` as ``batch``; a batch that is in the log already is left as it is (False)."""
    spark, root = rows.sparkSession, root.rstrip("/")
    state = _State(spark, root)
    if batch in state.merged or batch in state.batches:
        return False
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{root}/data/{folder}")
    _commit(spark, root, f"batch.{quote(batch, safe='').replace('.', '%2E')}.{folder}")
    return True


def read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows of the committed batches, each batch once; none if there is no log."""
    root = root.rstrip("/")
    folders = _State(spark, root).folders()
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{f}" for f in folders])


def compact(spark: SparkSession, root: str, schema: StructType, rows_per_file: int = 1_000_000) -> int:
    """Write the rows of all batches into few files; the number of folders this replaces."""
    root = root.rstrip("/")
    state = _State(spark, root)
    if len(state.folders()) < 2:
        return 0
    rows = spark.read.schema(schema).parquet(*[f"{root}/data/{f}" for f in state.folders()])
    folder = uuid.uuid4().hex
    rows.repartition(max(1, -(-rows.count() // rows_per_file))).write.parquet(f"{root}/data/{folder}")
    spark.createDataFrame([(b,) for b in sorted(state.merged | set(state.batches))], "batch string") \
        .coalesce(1).write.parquet(f"{root}/merged/{folder}")
    _commit(spark, root, f"compact.{state.number + 1:0{_DIGITS}d}.{folder}")
    return len(state.folders())


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete commits and rows that no reader takes any more; how many there were.

    A reader that began before the last compaction may still need them.
    """
    root = root.rstrip("/")
    old = _State(spark, root).old
    for name in old:
        for path in (f"log/{name}", f"data/{name.split('.')[2]}", f"merged/{name.split('.')[2]}"):
            store, target = hadoop_path(spark, f"{root}/{path}")
            store.delete(target, True)
    return len(old)

