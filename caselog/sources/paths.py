"""Paths on any file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Moves the data files below a folder to the same places below another one of its file system,
    which is marked as finished before: a reader of a move that broke off takes what was moved."""
    fs, top = file_system(spark, source)
    start, files, moves = len(fs.makeQualified(top).toString()), fs.listFiles(top, True), []
    while files.hasNext():
        moves.append(files.next().getPath())
    fs.create(file_system(spark, f"{target}/_SUCCESS")[1], True).close()
    for file in (f for f in moves if not f.getName().startswith("_")):
        to = file_system(spark, target + file.toString()[start:])[1]
        fs.mkdirs(to.getParent())
        if not fs.rename(file, to):
            raise OSError(f"{file.toString()} could not be moved to {to.toString()}")


def directories(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the directories below a path that start with a prefix, sorted."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(prefix))
