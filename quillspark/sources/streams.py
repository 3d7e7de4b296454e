"""One row a file, read by a task from an open stream: digests and headers of files of any size."""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Opener = Callable[[str], BinaryIO]


def file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """Hadoop's path and the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def local_name(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def open_local(path: str) -> BinaryIO:
    """A file of a file: path, as every executor sees it where Spark can read it."""
    return open(local_name(path), "rb")


def opener_of(spark: SparkSession, path: str) -> Opener | None:
    """How tasks open files below path by themselves; None where only Spark's readers reach them."""
    return open_local if file_system(spark, path)[1].getUri().getScheme() == "file" else None


def sha256_of(stream: BinaryIO) -> tuple[str]:
    return (hashlib.file_digest(stream, "sha256").hexdigest(),)


def read_each(spark: SparkSession, path: str, read: Callable[[BinaryIO], tuple], columns: str, opener: Opener | None = None, **options: str) -> DataFrame:
    """(path, file, columns): what read finds in each file of path; file is the path as an encoded address.

    Spark lists the files and deals them to tasks by size.  A task opens one after the other, by opener (file: paths
    need none), and holds what read does, so a file may have any size.  Elsewhere, without an opener, files come whole
    through Spark's binaryFile source, up to 2 GB each.
    """
    opener = opener or opener_of(spark, path)
    listed = spark.read.format("binaryFile").options(**options).load(path)
    rows = listed.selectExpr("path", "_metadata.file_path AS file", *([] if opener else ["content"]))
    names = ["path", "file", *(x.split()[0] for x in columns.split(","))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                with opener(row.path) if opener else io.BytesIO(row.content) as stream:
                    try:
                        found.append((row.path, row.file, *read(stream)))
                    except Exception as e:
                        raise ValueError(f"{row.path} cannot be read: {e}") from e
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, f"path string, file string, {columns}")


def plain_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(path, place below root) of every file of a model's folder, hidden and empty ones too, in order of the places.

    A folder with linked folders, or with what is neither file nor folder, is an error, as is one without files.
    """
    place, system = file_system(spark, root)
    if not system.exists(place):
        raise ValueError(f"{root} is no folder")
    if system.getUri().getScheme() == "file":
        for folder, folders, leaves in os.walk(local_name(root)):
            linked = [x for x in folders if os.path.islink(os.path.join(folder, x))]
            broken = [x for x in leaves if not os.path.isfile(os.path.join(folder, x))]
            if linked or broken:
                raise ValueError(f"{folder}: linked folders {sorted(linked)}, unreadable files {sorted(broken)}")
    top = system.makeQualified(place).toUri().getPath().rstrip("/") + "/"
    found, listing = [], system.listFiles(place, True)
    while listing.hasNext():
        one = listing.next().getPath()
        found.append((one.toString(), one.toUri().getPath().removeprefix(top)))
    if not found:
        raise ValueError(f"no files below {root}")
    return sorted(found, key=lambda x: x[1])
