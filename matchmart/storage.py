"""Small files and folders on the shared file system, through Hadoop's API.

Markers, pointers and clean-up around tables that Spark writes; nothing here reads
or writes rows.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it names it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file (overwrite)."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text (Spark's readers skip ``_``-prefixed files), None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, unless it is there; False if it is.

    The file is written aside and renamed without overwriting, the way streaming
    checkpoints commit: on a file system whose rename is atomic one of several
    writers gets the name, and no reader sees half a file.
    """
    sc = spark.sparkContext
    fs, p = _at(spark, path)
    p = fs.makeQualified(p)
    aside = sc._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    write_text(spark, aside.toString(), text)
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(aside, p, options)
        return True
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def names(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since its last change) of a folder's files and folders, hidden ones left out."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    now = time.time()
    found = [(f.getPath().getName(), now - f.getModificationTime() / 1000) for f in fs.listStatus(p)]
    return [(n, age) for n, age in found if not n.startswith(".")]


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this library wrote."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
