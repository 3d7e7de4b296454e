"""Training checkpoints: restart candidates of a run, and the digests of a model's files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.files import strict_object
from quillspark.sources.streams import Opener, file_system, opener_of, plain_files, sha256_of

#: A step's folder and the file that tells its step.
FOLDER, STATE = r"/checkpoint-([0-9]+)/trainer_state\.json$", "checkpoint-*/trainer_state.json"


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, step): the steps saved in a run's folder, in ascending order; none where there is no such folder.

    A step counts if its folder's number is the global_step of its state.  States that are missing, broken or tell another
    step, or none in whole numbers, are left out.
    """
    place, system = file_system(spark, f"{folder.rstrip('/')}/{STATE}")
    if not system.globStatus(place):
        return spark.createDataFrame([], "path string, step long")

    @F.udf("long")
    def told(content):
        try:
            step = strict_object(bytes(content).decode()).get("global_step")
        except (ValueError, RecursionError):
            return None
        return step if type(step) is int and 0 <= step < 1 << 63 else None

    states = spark.read.format("binaryFile").load(place.toString())
    number = F.regexp_extract("path", FOLDER, 1).try_cast("long")
    rows = states.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), number.alias("step"), told("content").alias("told"))
    return rows.where("step = told").select("path", "step").orderBy("step", "path")


@dataclass(frozen=True)
class Resume:
    """Where a run starts: at a checkpoint, or afresh."""

    checkpoint: str | None = None
    step: int = 0

    @property
    def resumes(self) -> bool:
        return self.checkpoint is not None

    def __str__(self) -> str:
        return f"from step {self.step}, {self.checkpoint}" if self.resumes else "from the start"


def latest(spark: SparkSession, folder: str, enabled: bool = True) -> Resume:
    """The last saved step of a run's folder, unless resuming is not wanted."""
    if not enabled:
        return Resume()
    best = checkpoints(spark, folder).agg(F.max(F.struct("step", "path")).alias("m")).first()["m"]
    return Resume(best["path"], best["step"]) if best else Resume()


def checkpoint_hashes(spark: SparkSession, root: str, opener: Opener | None = None) -> DataFrame:
    """(path, sha256) of every file of a model's folder, also hidden and empty ones, by streams; paths below root."""
    open_file = opener or opener_of(spark, root)
    if open_file is None:
        raise ValueError(f"{root}: files of this store need an opener")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for address, path in frame.itertuples(index=False):
                with open_file(address) as stream:
                    found.append((path, *sha256_of(stream)))
            yield pd.DataFrame(found, columns=["path", "sha256"])

    listed = plain_files(spark, root)
    rows = spark.createDataFrame(listed, "address string, path string").repartition(min(len(listed), 1000), "path")
    return rows.mapInPandas(run, "path string, sha256 string")


def checkpoint_identity(spark: SparkSession, root: str, opener: Opener | None = None) -> dict:
    """What a report says about a local model: its place and the digests of its files, by their paths."""
    place, system = file_system(spark, root)
    pairs = checkpoint_hashes(spark, root, opener).agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("files")).first()["files"]
    return {"source": "local", "path": system.makeQualified(place).toUri().getPath(), "files_sha256": {r["path"]: r["sha256"] for r in pairs}}
