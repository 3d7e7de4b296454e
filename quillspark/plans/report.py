"""The report matrix: systems by slices, scored, pending or excluded, and its renderings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The domains' transcription modes.
LONG_FORM, SHORT = "long-form-vad", "bounded-short"


def matrix(systems: DataFrame, slices: DataFrame, licenses: DataFrame, predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """One cell for each system (system) and slice (slice, source, domain, manifest_ready, declared_pending).

    predictions (system, slice) tells what is there, scores (system, slice, ...) the figures.  The reason of a
    cell that is not scored is, in this order: declared pending, the license, a missing manifest, missing
    predictions.  Systems and slices are short lists of a report's specification, and so is their product.
    """
    cells = systems.crossJoin(slices)
    told = licenses.select(F.col("id").alias("source"), "status")
    there = predictions.select("system", "slice").distinct().withColumn("__there", F.lit(True))
    cells = cells.join(told, "source", "left").join(there, ["system", "slice"], "left")
    reason = (
        F.when(F.col("declared_pending").isNotNull(), F.col("declared_pending"))
        .when(F.col("status").isNull(), "source is not registered")
        .when(F.col("status") == "excluded", "source is excluded")
        .when(~F.col("manifest_ready"), "manifest unavailable")
        .when(F.col("__there").isNull(), "predictions unavailable")
    )
    mode = F.when(F.col("domain") == "long-form", LONG_FORM).otherwise(SHORT)
    return cells.withColumns({"pending": reason, "mode": mode}).drop("__there", "status").join(scores, ["system", "slice"], "left")


def cell_problems(cells: DataFrame) -> DataFrame:
    """(system, slice, problem): pending cells with figures, scored cells without, values that contradict each other."""
    scored = F.col("pending").isNull()
    problem = (
        F.when(~scored & F.col("wer").isNotNull(), "figures for a pending cell")
        .when(scored & (F.col("wer").isNull() | F.isnan("wer")), "no figures")
        .when(scored & (F.abs(F.col("wer") - F.col("word_errors") / F.col("words")) > 1e-12), "rate and sums differ")
    )
    repeated = cells.groupBy("system", "slice").count().where("count > 1").select("system", "slice", F.lit("repeated cell").alias("problem"))
    return cells.select("system", "slice", problem.alias("problem")).where("problem is not null").unionByName(repeated)


def cell_text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def render_markdown(title: str, cells: list[dict]) -> str:
    """A table for each slice, a line for each system; rates to a tenth of a per cent."""
    out = [f"# {cell_text(title)}", ""]
    for name in dict.fromkeys(c["slice"] for c in cells):
        out += [f"## {cell_text(name)}", "", "| System | WER | CER | Segments |", "|---|---|---|---|"]
        for c in (c for c in cells if c["slice"] == name):
            if c["pending"]:
                out.append(f"| {cell_text(c['system'])} | pending: {cell_text(c['pending'])} | | |")
            else:
                out.append(f"| {cell_text(c['system'])} | {c['wer']:.1%} | {c['cer']:.1%} | {c['segments']} |")
        out.append("")
    return "\n".join(out)


def render_json(title: str, cells: list[dict]) -> str:
    return json.dumps({"title": title, "cells": cells}, ensure_ascii=False, sort_keys=True, allow_nan=False, indent=2)


def render_licenses(rows: list[dict]) -> str:
    """The registry as a Markdown table, unknown where a field is null."""
    told = lambda x: "unknown" if x is None else ("yes" if x else "no") if isinstance(x, bool) else cell_text(str(x))
    names = ["id", "license", "status", "redistributable_audio", "attribution_required", "share_alike", "hours"]
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(told(r[n]) for n in names) + " |" for r in rows])
