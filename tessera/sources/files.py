"""Files by path, wherever Spark's paths point: local paths, and URIs of the file systems that pyarrow opens."""

from __future__ import annotations

import functools
import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Schemes that Spark's file systems have of their own.
SAME = {"s3a": "s3", "s3n": "s3"}


@functools.cache
def _system(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), ""
    return fs.FileSystem.from_uri(f"{SAME.get(scheme, scheme)}://{authority}")


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. Nothing in a path is decoded: names may hold any character."""
    scheme, authority, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?)?(.*)", path, re.S).groups()
    system, base = _system(scheme or "", authority or "")
    return system, f"{base.rstrip('/')}/{rest.lstrip('/')}" if base or path.startswith("/") or scheme else rest


def read(path: str, most: int | None = None) -> bytes:
    """A file's content, or its first `most` bytes."""
    system, at = place(path)
    with system.open_input_stream(at) as f:
        return f.read(most) if most else f.read()


def is_file(path: str) -> bool:
    system, at = place(path)
    return system.get_file_info(at).type == fs.FileType.File


def literal(path: str) -> str:
    """A path as Spark's readers take it, which would read some characters as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


class Folder:
    """A folder: its full path as Spark lists it, and the same without scheme."""

    def __init__(self, spark: SparkSession, root: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path) or not system.getFileStatus(path).isDirectory():
            raise FileNotFoundError(root)
        self.spark, self.uri = spark, system.resolvePath(path).toString().rstrip("/")
        self.top = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:/+", "", self.uri).strip("/")

    def listing(self, pattern: str | None = None) -> DataFrame:
        """(path): files below the folder, relative to it; nothing is read."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        return self.relative(reader.load(literal(self.uri)).select("path"))

    def relative(self, files: DataFrame) -> DataFrame:
        """Cuts the folder off the column path, which holds paths as Spark lists them."""
        bare = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]+:/+", "/")
        return files.withColumn("path", F.substring(bare, len(self.top) + 2, 1 << 20))
