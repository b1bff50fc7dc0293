"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker, whatever the number of its rows.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """From now on batches to Python workers are cut at BATCH_BYTES, or at less if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader (any file system)."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; where that is unset, a temporary one if there is one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/riskweave-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that lost executors cost no recomputation.

    ``keep`` writes a frame as Parquet and returns it reread; ``drop`` removes a table that nothing reads any more.
    """

    #: Folders of the runs so far that have not been removed.
    live: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        Scratch.live.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(df._scratch_path)

    def drop_since(self, mark: int) -> None:
        """Remove the tables of all runs that began after mark runs were live, but for this one's."""
        for root in [r for r in Scratch.live[mark:] if r != self.root]:
            self._remove(root)
            Scratch.live.remove(root)

    def _remove(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the edges a-b held in memory: every non-root node and its root (the smallest node)."""
    if not len(a):
        return a[:0], a[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pa, pb = parent[ia], parent[ib]
        apart = pa != pb
        if not apart.any():
            break
        ia, ib, pa, pb = ia[apart], ib[apart], pa[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    child = parent != np.arange(len(nodes))
    return nodes[child], nodes[parent[child]]
