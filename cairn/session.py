"""Session defaults: UTC, adaptive execution."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, name: str = "cairn", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder.

    Only in local mode one of our own is made where none is set; on a cluster its absence is an error.
    """
    made = spark.sparkContext.getCheckpointDir()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if made is None and named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="cairn-")
    if made is None:
        spark.sparkContext.setCheckpointDir(named)
    return (named or made).rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    checkpoint_root(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input has fewer splits than there are cores, as a file of one row group has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: rows of a task, about
DEALT = 250_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to tasks of about DEALT rows, of any size of table: partitions that are asked for are not joined into larger ones."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT)), key)


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is written, not when the driver next collects its garbage.

    For writes only: each plans its rows anew, so nothing that is deleted is asked for again.
    """
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SWEEP)
        else:
            spark.conf.set(_SWEEP, before)


class Tables:
    """Written tables of one run in the shared folder: they cut the lineage of rounds and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        import uuid

        self.spark, self.root, self._n, self._paths = spark, f"{checkpoint_root(spark)}/cairn-{label}-{uuid.uuid4().hex[:12]}", 0, {}

    def keep(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """Write rows once and return the written table; ``instead_of`` is a kept table that is deleted then."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        with swept(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path, out
        if instead_of is not None:
            self.drop(instead_of)
        return out

    def drop(self, df: DataFrame) -> None:
        from .sources import files

        files.delete(self.spark, self._paths.pop(id(df))[0])
