"""Small files through Spark's own file systems, so that paths of any store work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the engine names it, with its scheme."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Full paths of a folder's entries in order of their names; none of a folder that is not there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if another writer was first."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(getattr(e, "java_exception", e)) or fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def state(spark: SparkSession, path: str) -> str:
    """Changes when the files of a table do."""
    fs, p = _fs(spark, path)
    status = fs.getFileStatus(p)
    size = fs.getContentSummary(p).getLength()
    return f"{size}-{status.getModificationTime()}"
