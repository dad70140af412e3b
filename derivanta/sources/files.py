"""Small files and folders of the driver's, through Hadoop, so that any store will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def is_dir(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether anything has a name of this pattern."""
    at, fs = _at(spark, pattern)
    return bool(fs.globStatus(at))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the store itself names it."""
    at, fs = _at(spark, path)
    return fs.makeQualified(at).toString()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def as_folder(spark: SparkSession, path: str) -> None:
    """Makes a file the first part of a folder of its name, so that Spark can append to it."""
    at, fs = _at(spark, path)
    if fs.exists(at) and not fs.getFileStatus(at).isDirectory():
        aside = _at(spark, f"{path}.aside")[0]
        fs.rename(at, aside)
        fs.mkdirs(at)
        fs.rename(aside, _at(spark, f"{path}/earlier.jsonl")[0])
