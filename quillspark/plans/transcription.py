"""A run of a model over a manifest: every input is checked before the first segment is transcribed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.leakage import with_file_hashes
from quillspark.operators.manifests import check_manifest, clamped_windows
from quillspark.operators.scoring import require_empty
from quillspark.provenance import redact
from quillspark.sources.files import below_root, wav_durations
from quillspark.sources.streams import Opener
from quillspark.storage import store


class Transcriber(Protocol):
    """What makes text of a window of a file; it may tell what it ran on by observed_runtime_context() -> dict."""

    def transcribe(self, audio_path: str, start_s: float | None = None, duration_s: float | None = None) -> str: ...


def audio_files(spark: SparkSession, root: str, opener: Opener | None = None) -> DataFrame:
    """(audio, file_key, sha256, actual_s) of the WAV files below root; audio is the path from there, file_key the whole one."""
    found = wav_durations(spark, f"{root.rstrip('/')}/", recursive=True, opener=opener)
    return found.select(below_root(spark, root).alias("audio"), F.col("path").alias("file_key"), "sha256", F.col("duration_s").alias("actual_s"))


def checked_segments(segments: DataFrame, files: DataFrame) -> DataFrame:
    """segments with file_key and actual_s, stored once all keep the contract: files are there, with the declared digests,
    and windows lie inside them; ValueError, or Spark's error of a window, otherwise."""
    require_empty(segments.groupBy("manifest").count().groupBy().count().where("count <> 1"), "a run takes one manifest", "count")
    check_manifest(segments)
    known = with_file_hashes(segments, files).join(files.select("audio", "actual_s"), "audio")
    return store(clamped_windows(known), "checked-segments")


def run_over_manifest(
    segments: DataFrame, files: DataFrame, build: Callable[[], Transcriber], system: str, tasks: int | None = None, profile: ResourceProfile | None = None
) -> DataFrame:
    """(system, manifest, pos, id, hypothesis, observed_runtime) of one manifest's segments, stored.

    build makes the transcriber, once a task that has segments, on the executor; profile names what such a task needs (a
    GPU, memory).  The segments are dealt to tasks by id, as many as Spark's setting says unless tasks is given, so a long
    recording's windows spread.  A window goes to the model as the segment states it.  Outputs that are no text stop the
    run.  observed_runtime is what the transcriber told after the batch, without credentials, as JSON; null if it tells nothing.
    """
    if not isinstance(system, str) or not system.strip():
        raise ValueError("a run needs the name of its system")
    ready = checked_segments(segments, files)
    dealt = ready.repartition(*([tasks] if tasks else []), "id")
    rows = dealt.select("manifest", "pos", "id", "file_key", "start_s", "duration_s")
    schema = "manifest string, pos long, id string, hypothesis string, observed_runtime string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if not batch.num_rows:
                continue
            model = build() if model is None else model
            given = batch.to_pylist()
            texts = [model.transcribe(r["file_key"].removeprefix("file:"), r["start_s"], r["duration_s"]) for r in given]
            for r, text in zip(given, texts, strict=True):
                if not isinstance(text, str):
                    raise ValueError(f"no text for segment {r['id']!r}")
            observe = getattr(model, "observed_runtime_context", None)
            seen = json.dumps(redact(observe()), ensure_ascii=False, sort_keys=True) if callable(observe) else None
            yield pa.RecordBatch.from_arrays(
                [batch.column("manifest"), batch.column("pos"), batch.column("id"), pa.array(texts, pa.string()), pa.array([seen] * len(texts), pa.string())],
                names=["manifest", "pos", "id", "hypothesis", "observed_runtime"],
            )

    told = store(rows.mapInArrow(run, schema, profile=profile), "hypotheses")
    return told.select(F.lit(system).alias("system"), *told.columns)


def predictions_header(hypotheses: DataFrame, context: dict | None = None) -> dict:
    """The header record of a run's prediction file: system, manifest, and the context with what its tasks observed."""
    head = hypotheses.select("system", "manifest").first()
    seen = [json.loads(r[0]) for r in hypotheses.select("observed_runtime").where("observed_runtime is not null").distinct().orderBy("observed_runtime").collect()]
    if seen:
        context = (context or {}) | {"observed_runtime": seen[0] if len(seen) == 1 else seen}
    return {"system": head["system"], "manifest": head["manifest"]} | ({"run_context": context} if context else {})
