"""Shared scratch space: tables that cut lineage survive lost executors.

The folder is ``spark.checkpoint.dir`` of the session, which every executor can reach. Only in local
mode a folder of our own is made and set where that is unset; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import swept


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not among those taken, whatever their case."""
    taken = {c.lower() for c in taken}
    while name in taken:
        name = f"_{name}"
    return name


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that is not to be sent through the driver, however small its estimate.

    Tables that grow with the input, and above all rows that a Python step makes several of, are estimated far too small.
    """
    return df.hint("merge")


_scopes: list[list[Scratch]] = []


@contextmanager
def cleaned():
    """Delete the tables that are made inside, but for those of scratch spaces that were there before."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for s in made:
            s.close()


class Scratch:
    """Tables of one run, under a folder with a fresh name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/cairn-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if _scopes:
            _scopes[-1].append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = self.path(name)
        with swept(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.cairn_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.cairn_path)

    def close(self) -> None:
        """Delete all tables of this run."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
