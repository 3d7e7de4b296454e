"""Cutting lineage through tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session whose executors are threads of the driver (tests); on a
    cluster it is an error, as a machine-local folder is not shared.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.split("-")[0].startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back.

    Everything computed so far survives the loss of any executor, and later uses do not recompute it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def store_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As store, dealt to buckets by a column: a join or group by it needs no shuffle of this side.

    There are as many buckets as spark.sql.shuffle.partitions says, so that the other side is dealt alike.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quillspark_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
    return spark.table(table)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted as stored tables are."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def publish(spark: SparkSession, source: str | None, target: str) -> None:
    """Move a folder as a whole, as a file stream asks for; without a source make an empty one, without its folder do nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if source is None:
        system.mkdirs(place)
        return
    own = spark._jvm.org.apache.hadoop.fs.Path(source)
    if system.exists(own) and not system.rename(own, place):
        raise OSError(f"{source} could not be moved to {target}")


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(df: DataFrame) -> None:
    """Delete a stored table that nothing lazy refers to any more."""
    _delete(df.sparkSession, df.stored_path)
    if df.stored_path in _stored:
        _stored.remove(df.stored_path)


def stored_tables() -> int:
    """How many tables are stored now; what release takes to keep those of earlier results."""
    return len(_stored)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables stored since then, once the results that were made of them are written or no longer needed.

    Results are lazy, so no query can do this by itself; what is left is deleted when the driver ends.
    """
    while len(_stored) > since:
        _delete(spark, _stored.pop())


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _stored:
        release(spark)
