"""Small files in any store that Spark reaches, through its file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files in a folder; none if it is not there."""
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> bool:
    """A new file that appears whole; False if there is one of this name already."""
    p, fs = _at(spark, path)
    part, _ = _at(spark, f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        return False
    return True


def move(spark: SparkSession, path: str, to: str) -> None:
    p, fs = _at(spark, path)
    fs.rename(p, _at(spark, to)[0])


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.getFileStatus(p).isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.exists(p))
