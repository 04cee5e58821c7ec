"""Files by Hadoop's file system API, so that any store that Spark reads will do: listing, beginnings, small files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import SparkSession

#: Bytes of a file's beginning that are looked at.
HEAD = 2048
_THREADS = 16


class Found(NamedTuple):
    path: str
    name: str
    length: int


def path_of(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def store_of(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return store_of(spark, path).exists(path_of(spark, path))


def listed(spark: SparkSession, folder: str) -> list[Found]:
    """The files right below a folder, or below the folders that a pattern matches, by path; hidden ones are left out."""
    found = store_of(spark, folder).globStatus(path_of(spark, folder)) or []
    out = []
    for top in found:
        for s in store_of(spark, folder).listStatus(top.getPath()) if top.isDirectory() else [top]:
            name = s.getPath().getName()
            if s.isFile() and not name.startswith(("_", ".")):
                out.append(Found(s.getPath().toString(), name, s.getLen()))
    return sorted(out)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """The folders right below a folder, if it is there."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().toString() for s in store_of(spark, folder).listStatus(path_of(spark, folder)) if s.isDirectory())


def head(spark: SparkSession, path: str, n: int = HEAD) -> str:
    """The first n bytes of a file as Latin-1. A folder, such as Spark writes, begins as its first filled file."""
    store, at = store_of(spark, path), path_of(spark, path)
    if store.getFileStatus(at).isDirectory():
        inside = [f for f in listed(spark, path) if f.length]
        return head(spark, inside[0].path, n) if inside else ""
    io = spark.sparkContext._jvm.org.apache.commons.io
    stream = store.open(at)
    try:
        return io.IOUtils.toString(io.input.BoundedInputStream(stream, n), "ISO-8859-1")
    finally:
        stream.close()


def heads(spark: SparkSession, paths: list[str], n: int = HEAD) -> dict[str, str]:
    """The beginnings of many files at once: n bytes each, whatever their size, and no job."""
    with ThreadPoolExecutor(_THREADS) as pool:
        return dict(zip(paths, pool.map(lambda p: head(spark, p, n), paths), strict=True))


def read_small(spark: SparkSession, path: str) -> str | None:
    return head(spark, path, 1 << 16) if exists(spark, path) else None


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file put in place by one rename, so that a reader sees the old or the new one."""
    jvm = spark.sparkContext._jvm
    new = path_of(spark, f"{path}.new")
    stream = store_of(spark, path).create(new, True)
    stream.write(bytearray(text.encode("ISO-8859-1")))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else jvm.org.apache.hadoop.fs.Path("file:///").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, path_of(spark, path), options)


def remove(spark: SparkSession, path: str) -> None:
    store_of(spark, path).delete(path_of(spark, path), True)
