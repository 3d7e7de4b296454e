"""Writers of manifests, predictions and reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.provenance import redact
from quillspark.sources.files import SEGMENT_FIELDS


def write_atomic(files: dict[str, str], inputs: tuple[str, ...] = ()) -> None:
    """Write all texts or none: each goes to a temporary neighbour, then all are renamed, with backups meanwhile.

    No output may be one of the inputs, also not by a link or another name.
    """
    read = {os.path.realpath(p).casefold() for p in inputs}
    for p in files:
        if os.path.realpath(p).casefold() in read or any(os.path.exists(i) and os.path.exists(p) and os.path.samefile(i, p) for i in inputs):
            raise ValueError(f"{p} is an input")
    if len({os.path.realpath(p).casefold() for p in files}) != len(files):
        raise ValueError("two outputs are the same file")
    for p in files:
        if any(part.casefold() == ".git" for part in Path(p).parts) or os.path.islink(p):
            raise ValueError(f"{p} is no place for an output")
    made: list[tuple[str, str]] = []
    kept: list[tuple[str, str]] = []
    try:
        for p, text in files.items():
            handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(p)))
            made.append((name, p))
            with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
                f.write(text)
        for name, p in made:
            if os.path.exists(p):
                os.replace(p, f"{name}.old")
                kept.append((f"{name}.old", p))
            os.replace(name, p)
    except BaseException:
        for name, p in made:
            if os.path.exists(name):
                os.remove(name)
            elif os.path.exists(p):
                os.remove(p)
        for old, p in kept:
            os.replace(old, p)
        raise
    for old, _ in kept:
        os.remove(old)


def manifest_lines(segments: DataFrame, header: dict) -> DataFrame:
    """(pos, value): the header record, then a record for each segment in order, nulls left out."""
    spark = segments.sparkSession
    head = spark.createDataFrame([(-1, json.dumps({"manifest": header}, ensure_ascii=False))], "pos long, value string")
    return head.unionByName(segments.select("pos", F.to_json(F.struct(*SEGMENT_FIELDS)).alias("value")))


def transcription_json(merged: DataFrame, recording: str, context: dict) -> str:
    """One recording's merged segments and warnings, with the redacted context of the run, as JSON text."""
    rows = merged.where(F.col("recording") == recording).orderBy("pos").collect()
    segments = [{k: r[k] for k in ("start_s", "end_s", "text", "timing_precision")} for r in rows]
    warnings = list(dict.fromkeys(w for r in rows for w in r["warnings"]))
    told = {"recording": recording, "text": " ".join(s["text"] for s in segments if s["text"]), "segments": segments, "warnings": warnings, "run_context": redact(context)}
    return json.dumps(told, ensure_ascii=False, indent=2, allow_nan=False)


def prediction_lines(hypotheses: DataFrame, header: dict) -> DataFrame:
    """(pos, value): the header record without credentials, then a record for each hypothesis."""
    spark = hypotheses.sparkSession
    head = spark.createDataFrame([(-1, json.dumps({"predictions": redact(header)}, ensure_ascii=False))], "pos long, value string")
    return head.unionByName(hypotheses.select("pos", F.to_json(F.struct("id", "hypothesis")).alias("value")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (pos, value) as text in order, through Spark's commit protocol; path becomes a folder.

    Ranges of pos are written by tasks of their own, as parts whose names sort as the ranges do; the readers take the
    parts of a folder as one text.  A job that fails leaves no parts.
    """
    ranged = lines.repartitionByRange("pos").sortWithinPartitions("pos")
    ranged.select("value").write.mode("overwrite").text(path, lineSep="\n")
