"""Small files and folders on whatever store a path names, by the file system that Spark itself uses."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(Exception):
    """A file that had to be new exists already."""


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, where = _open(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file that must not exist yet; of two writers one gets :class:`Taken`."""
    fs, where = _open(spark, path)
    try:
        stream = fs.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            raise Taken(path) from None
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, target: str, otherwise: str) -> bool:
    """Moves a file to ``target``, or to ``otherwise`` if that is taken; false if there is no such file (any more)."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return False
    there = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(there.getParent())
    if fs.exists(there):
        there = spark._jvm.org.apache.hadoop.fs.Path(otherwise)
    if not fs.rename(where, there):
        raise OSError(f"cannot move {path} to {there}")
    return True
