"""Path checks through the session's Hadoop FileSystem, so the same code works for
local folders, HDFS and object stores (a cluster has no shared local disk)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries directly under ``path`` (empty when it does not exist)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)]


def empty_files(spark: SparkSession, path: str, glob: str = "*") -> list[str]:
    """Full paths of the files of no bytes that ``path`` is or holds (Spark's file readers leave them out)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    if fs.getFileStatus(p).isDirectory():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, glob)
    return [str(st.getPath()) for st in fs.globStatus(p) or [] if st.isFile() and st.getLen() == 0
            and st.getPath().getName()[0] not in "._"]


def qualified(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path`` (scheme and authority), for comparing locations."""
    fs, p = _fs_path(spark, path)
    return str(fs.makeQualified(p))


def join(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/")] + [x.strip("/") for x in parts])


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    """First line of a file (no Spark job; a UTF-8 byte-order mark is dropped)."""
    fs, p = _fs_path(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding)).readLine()
    finally:
        stream.close()
    return None if line is None else line.lstrip("\ufeff")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as UTF-8 text (no Spark job)."""
    fs, p = _fs_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet (an error if it does)."""
    fs, p = _fs_path(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own making, with all it holds."""
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)
