"""Evaluation: the scores of systems on slices with their intervals, and the report that is made of them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import CODE_SWITCH_VERSION, NORMALIZER_VERSION, normalize_for
from quillspark.operators import leakage, scoring
from quillspark.operators.bootstrap import Settings, draws, ranks
from quillspark.plans.report import LONG_FORM, SHORT, cell_text, matrix, render_licenses
from quillspark.sources.files import read_manifests, read_predictions, strict_object
from quillspark.sources.prepare import exists
from quillspark.sources.sinks import write_atomic

CELL = ["system", "slice"]
SUMS = ("norm_word_errors", "norm_words", "norm_char_errors", "norm_chars")
KINDS = ("fine_tuned", "pretrained", "provider", "unknown")
AUDITS = ("required", "unknown", "not_applicable")


def intervals(blocks: DataFrame, settings: Settings) -> DataFrame:
    """blocks (system, slice, recording_id, SUMS) -> (system, slice, recordings, wer_lower .. cer_upper).

    Each cell draws its own recordings, in order of id, from a generator of the seed; both metrics see the same
    draws.  A cell of one recording has no interval.  Cells are spread over the cluster; what one draws from is a row
    a recording.
    """
    low, high = ranks(settings.resamples, settings.confidence)
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in CELL)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("recording_id", kind="stable")
        limits = [None] * 4
        if len(frame) > 1:
            sums = frame[list(SUMS)].to_numpy(np.float64)
            drawn = np.array([sums[d].sum(axis=0) for d in map(np.array, draws(len(frame), settings.resamples, settings.seed))])
            for k in (0, 2):
                rates = np.sort(drawn[:, k] / drawn[:, k + 1])
                limits[k : k + 2] = float(rates[low - 1]), float(rates[high - 1])
        return pd.DataFrame([(*key, len(frame), *limits)], columns=[*CELL, "recordings", "wer_lower", "wer_upper", "cer_lower", "cer_upper"])

    return blocks.groupBy(*CELL).applyInPandas(run, f"{kinds}, recordings long, wer_lower double, wer_upper double, cer_lower double, cer_upper double")


def score_cells(pairs: DataFrame, settings: Settings = Settings(), long_texts: bool = False) -> DataFrame:
    """pairs (system, slice, domain, recording_id, reference, hypothesis) -> a row for each system and slice.

    Raw and normalised rates are ratios of sums over the cell; each text is normalised by its domain's rules once, and
    sums by recording serve both the rates and the intervals, so pairs are aggregated in one pass.
    """
    texts = {"__nref": normalize_for(F.col("domain"), F.col("reference")), "__nhyp": normalize_for(F.col("domain"), F.coalesce("hypothesis", F.lit("")))}
    counted = scoring.pair_counts(pairs.withColumns(texts), long_texts=long_texts)
    counted = scoring.pair_counts(counted, "norm_", F.col("__nref"), F.col("__nhyp"), long_texts)
    names = [f"{p}{c}" for p in ("", "norm_") for c in ("word_errors", "words", "char_errors", "chars")]
    blocks = counted.groupBy(*CELL, "recording_id").agg(F.count("*").alias("segments"), *(F.sum(n).alias(n) for n in names))
    sums = blocks.groupBy(*CELL).agg(*(F.sum(n).alias(n) for n in ("segments", *names)))
    rates = {f"{p}{r}": F.col(f"{p}{e}_errors") / F.col(f"{p}{e}s") for p in ("", "norm_") for r, e in (("wer", "word"), ("cer", "char"))}
    return sums.withColumns(rates).join(intervals(blocks, settings), CELL)


def pair_up(segments: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """segments (slice, id, ...) joined to predictions (system, slice, id, hypothesis).

    Each system that has predictions for a slice must have one for every segment of it and none beside them.
    """
    if check:
        scoring.require_empty(predictions.groupBy(*CELL, "id").count().where("count > 1"), "repeated predictions")
        scoring.require_empty(predictions.join(segments, ["slice", "id"], "left_anti"), "predictions without a segment")
        wanted = predictions.select(*CELL).distinct().join(segments.select("slice", "id"), "slice")
        scoring.require_empty(wanted.join(predictions, [*CELL, "id"], "left_anti"), "segments without a prediction")
    return segments.withColumnRenamed("text", "reference").join(predictions, ["slice", "id"])


def _relative(path: str) -> bool:
    return bool(path) and not re.search(r"^/|\\|(^|/)\.\.(/|$)", path)


@dataclass(frozen=True)
class Slice:
    name: str
    manifest: str
    domain: str = ""


@dataclass(frozen=True)
class System:
    name: str
    predictions: dict = field(default_factory=dict)
    model_id: str = "unknown"
    inference_modes: dict = field(default_factory=dict)
    training_audit: str = "unknown"
    train_manifests: tuple = ()
    text_decisions: dict = field(default_factory=dict)
    pending_slices: dict = field(default_factory=dict)
    model_kind: str = "unknown"


@dataclass(frozen=True)
class Spec:
    """What a report holds: systems by slices, with the bootstrap's settings."""

    name: str
    title: str
    slices: tuple[Slice, ...]
    systems: tuple[System, ...]
    seed: int = 0
    n_resamples: int = 1000
    train_manifests: tuple = ()
    audio_root: str | None = None

    def __post_init__(self) -> None:
        names = [s.name for s in self.slices]
        told = lambda x: isinstance(x, str) and bool(x.strip())
        paths = [*(s.manifest for s in self.slices), *self.train_manifests, *(p for y in self.systems for p in (*y.predictions.values(), *y.train_manifests))]
        problems = {
            "a name of letters, digits, underscores and hyphens": not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", str(self.name)),
            "a title": not told(self.title),
            "slices and systems of different names": not names or not self.systems or len({*names}) < len(names) or len({y.name for y in self.systems}) < len(self.systems),
            "named slices and systems": not all(told(x.name) for x in (*self.slices, *self.systems)),
            "relative paths": not all(isinstance(p, str) and _relative(p) for p in paths),
            "known slices": any({*y.predictions, *y.inference_modes, *y.text_decisions, *y.pending_slices} - {*names} for y in self.systems),
            f"audits of {AUDITS}": any(y.training_audit not in AUDITS for y in self.systems),
            f"kinds of {KINDS}": any(y.model_kind not in KINDS for y in self.systems),
            "an audit of every fine-tuned system": any(y.model_kind == "fine_tuned" and y.training_audit != "required" for y in self.systems),
            "reasons": not all(told(r) for y in self.systems for r in (*y.pending_slices.values(), *(x for d in y.text_decisions.values() for x in d.values()))),
        }
        if wrong := [need for need, bad in problems.items() if bad]:
            raise ValueError(f"a report needs {'; '.join(wrong)}")
        Settings(self.n_resamples, 0.95, self.seed)

    @classmethod
    def parse(cls, text: str) -> Spec:
        """From JSON text; unknown fields are errors."""
        given = strict_object(text)
        parts = {}
        for key, kind in (("slices", Slice), ("systems", System)):
            items = given.get(key)
            known = {f.name for f in fields(kind)}
            if not isinstance(items, list) or not all(isinstance(x, dict) and {"name"} <= set(x) <= known for x in items):
                raise ValueError(f"{key} must be a list of objects with a name and fields of {sorted(known)}")
            parts[key] = tuple(kind(**{"manifest": "", **x} if kind is Slice else x) for x in items)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        return cls(**{"name": "", "title": "", **given, **parts})


def audits(spec: Spec, segments: DataFrame, training: dict[str, DataFrame]) -> DataFrame:
    """(system, slice, leakage): the state of each system's audit, unknown where none is due.

    training: the training segments of each system that has some.  A fine-tuned system without them is INCOMPLETE.
    """
    spark = segments.sparkSession
    out = []
    every = leakage.KeyIndex(segments, group="slice") if any(y.name in training for y in spec.systems) else None
    for y in spec.systems:
        own = leakage.KeyIndex(training[y.name]) if y.name in training else None
        for s in spec.slices:
            state = {"required": "INCOMPLETE"}.get(y.training_audit, y.training_audit)
            if y.name in training:
                reviews = [(k, r) for k, r in y.text_decisions.get(s.name, {}).items()]
                reviewed = spark.createDataFrame(reviews, "key string, reason string") if reviews else None
                state = leakage.verdict(training[y.name], segments.where(F.col("slice") == s.name), reviewed=reviewed, keys=(own, every.of(s.name))).first()["state"]
            out.append((y.name, s.name, state))
    return spark.createDataFrame(out, "system string, slice string, leakage string")


def build_report(spec: Spec, segments: DataFrame, predictions: DataFrame, licenses: DataFrame, context: dict, training: dict[str, DataFrame] | None = None) -> dict:
    """The report of a specification as JSON data: a cell for each system and slice, scored or with its pending reason.

    segments (slice, manifest, manifest_pos, pos, id, source, domain, recording_id, text, audio_sha256, manifest_sha256)
    and predictions (system, slice, id, hypothesis, predictions_sha256) hold what is there; cells, a few rows, are all
    that reaches the driver.  Fine-tuned systems are scored only if their audit is CLEAN or REVIEWED; a cell that is
    declared pending or excluded by its license must have no predictions.
    """
    if (context.get("seed"), context.get("config", {}).get("n_resamples")) != (spec.seed, spec.n_resamples):
        raise ValueError("the run's context differs from the declared bootstrap settings")
    spark = segments.sparkSession
    order = {s.name: k for k, s in enumerate(spec.slices)}
    declared = [(y.name, s.name, y.pending_slices.get(s.name), y.model_id, y.model_kind, y.inference_modes.get(s.name)) for y in spec.systems for s in spec.slices]
    table = spark.createDataFrame(declared, "system string, slice string, declared_pending string, model_id string, model_kind string, told_mode string")
    known = segments.groupBy("slice").agg(F.first("source").alias("source"), F.first("domain").alias("domain"), F.first("manifest_sha256").alias("manifest_sha256"))
    domains = {r["slice"]: r["domain"] for r in known.select("slice", "domain").collect()}
    if clash := [s.name for s in spec.slices if s.domain and domains.get(s.name, s.domain) != s.domain]:
        raise ValueError(f"slices of another domain than their manifest: {clash}")
    slices = spark.createDataFrame([(s.name, s.domain) for s in spec.slices], "slice string, told_domain string").join(known, "slice", "left")
    slices = slices.select("slice", "source", F.coalesce("domain", "told_domain").alias("domain"), F.col("source").isNotNull().alias("manifest_ready"), F.lit(None).cast("string").alias("declared_pending"), "manifest_sha256")
    scores = score_cells(pair_up(segments, predictions), Settings(spec.n_resamples, 0.95, spec.seed))
    hashes = predictions.groupBy(*CELL).agg(F.first("predictions_sha256").alias("predictions_sha256"))
    audit = audits(spec, segments, training or {})
    cells = matrix(table.select("system").distinct(), slices, licenses, predictions, scores)
    cells = cells.drop("declared_pending").join(table, CELL).join(hashes, CELL, "left").join(audit, CELL)
    cells = cells.withColumn("pending", F.coalesce("declared_pending", F.when(F.col("source").isNull(), "manifest unavailable").otherwise(F.col("pending"))))
    rows = [r.asDict() for r in cells.collect()]  # systems by slices
    for r in rows:
        r["policy"] = f"code-switch-script v{CODE_SWITCH_VERSION}" if r["domain"] == "code-switch" else f"bengali v{NORMALIZER_VERSION}"
        r["mode"] = r.pop("told_mode") or r["mode"]
        there = r.pop("predictions_sha256")
        r["input_hashes"] = {"manifest": r.pop("manifest_sha256") or "unknown", "predictions": there or "unknown"}
        if r["pending"] and there:
            raise ValueError(f"predictions for {r['system']} on {r['slice']}, which is pending: {r['pending']}")
        if not r["pending"] and r["model_kind"] == "unknown":
            raise ValueError(f"{r['system']} on {r['slice']} is scored, so its kind of model must be declared")
        if not r["pending"] and r["model_kind"] == "fine_tuned" and r["leakage"] not in ("CLEAN", "REVIEWED"):
            raise ValueError(f"{r['system']} on {r['slice']} needs an audit without overlaps, not {r['leakage']}")
    systems = {y.name: k for k, y in enumerate(spec.systems)}
    rows.sort(key=lambda r: (order[r["slice"]], systems[r["system"]]))
    check_cells(rows)
    return {"name": spec.name, "title": spec.title, "run_context": context, "cells": rows, "licenses": [r.asDict() for r in licenses.collect()]}


def check_cells(rows: list[dict]) -> None:
    """Raise ValueError unless scored cells have figures that agree and pending ones none."""
    for r in rows:
        where = f"{r['system']} on {r['slice']}"
        if r["pending"]:
            continue
        for metric in ("wer", "cer"):
            point, low, high = r[f"norm_{metric}"], r[f"{metric}_lower"], r[f"{metric}_upper"]
            if point is None or r[metric] is None or not 0 <= point < float("inf"):
                raise ValueError(f"{where} has no {metric}")
            if (low is None) != (r["recordings"] == 1) or (low is not None and not 0 <= low <= high):
                raise ValueError(f"{where}: an interval needs several recordings and ordered bounds")


def render(report: dict) -> str:
    """The report as Markdown."""
    context = report["run_context"]
    git = context["git"]
    tree = {None: " (working tree unknown)", True: " (dirty)", False: ""}[git["dirty"]]
    out = [f"# {cell_text(report['title'])}", "", f"- Generated: {context['timestamp']}", f"- Command: `{context['command'] or 'unknown'}`", f"- Git: {git['sha']}{tree}"]
    out += [f"- Seed {context['seed']}; block bootstrap over recordings, {context['config'].get('n_resamples')} resamples, 95 %.", ""]
    for name in dict.fromkeys(c["slice"] for c in report["cells"]):
        own = [c for c in report["cells"] if c["slice"] == name]
        out += [f"## {cell_text(name)} ({cell_text(own[0]['domain'])})", "", "| System | WER (norm, 95 % CI) | CER (norm, 95 % CI) | WER (raw) | CER (raw) | Policy |", "|---|---|---|---|---|---|"]
        notes = []
        for c in own:
            told = ["pending"] * 4
            if not c["pending"]:
                spans = [f"[{c[f'{m}_lower']:.1%}, {c[f'{m}_upper']:.1%}]" if c["recordings"] > 1 else "(1 block, no CI)" for m in ("wer", "cer")]
                told = [f"{c[f'norm_{m}']:.1%} {s}" for m, s in zip(("wer", "cer"), spans, strict=True)] + [f"{c[m]:.1%}" for m in ("wer", "cer")]
            out.append("| " + " | ".join(map(cell_text, [c["system"], *told, c["policy"]])) + " |")
            notes.append(f"- {cell_text(c['system'])}: model `{cell_text(c['model_id'])}`; mode {cell_text(c['mode'])}; leakage {c['leakage']}." + (f" Pending: {cell_text(c['pending'])}." if c["pending"] else ""))
        out += ["", *notes, ""]
    if any(c["domain"] == "code-switch" for c in report["cells"]):
        out += ["Code-switched texts are compared after case folding; the same word in another script is no match.", ""]
    return "\n".join([*out, "## Data licenses", "", render_licenses(report["licenses"]), ""])


def write_report(report: dict, folder: str, inputs: tuple[str, ...] = ()) -> tuple[str, str]:
    """Write name.md and name.json, both or neither, none of them over an input."""
    paths = tuple(f"{folder.rstrip('/')}/{report['name']}.{end}" for end in ("md", "json"))
    told = json.dumps(report, ensure_ascii=False, indent=2, allow_nan=False, default=str) + "\n"
    write_atomic(dict(zip(paths, (render(report), told), strict=True)), inputs)
    return paths


SEGMENTS = ["slice", "manifest", "manifest_pos", "pos", "id", "source", "split", "domain", "recording_id", "text", "audio_sha256", "manifest_sha256"]


def read_inputs(spark: SparkSession, spec: Spec, base: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], tuple[str, ...]]:
    """(segments, predictions, training segments by system, paths read) of what a specification names below base.

    Files that are missing leave their cells pending, but for training manifests, without which no audit is complete.
    Predictions must name their system and the manifest of their slice.
    """
    root = base.rstrip("/")
    empty = "manifest string, manifest_pos int, pos long, id string, source string, split string, domain string, recording_id string, text string, audio_sha256 string, manifest_sha256 string"
    segments = spark.createDataFrame([], f"slice string, {empty}").select(*SEGMENTS)
    predictions = spark.createDataFrame([], "system string, slice string, id string, hypothesis string, predictions_sha256 string")
    paths: list[str] = []

    def manifest(name: str, place: int, label: str) -> DataFrame | None:
        path = f"{root}/{name}"
        paths.append(path)
        if not exists(spark, path):
            return None
        return read_manifests(spark, path).withColumns({"slice": F.lit(label), "manifest_pos": F.lit(place)}).select(*SEGMENTS)

    for s in spec.slices:
        found = manifest(s.manifest, 0, s.name)
        segments = segments if found is None else segments.unionByName(found)
    names = {r["slice"]: r["manifest"] for r in segments.select("slice", "manifest").distinct().collect()}
    training: dict[str, DataFrame] = {}
    for y in spec.systems:
        for place, name in enumerate(y.train_manifests or (spec.train_manifests if y.training_audit == "required" else ())):
            found = manifest(name, place, "")
            if found is None:
                raise ValueError(f"training manifest {name} is missing")
            training[y.name] = found if y.name not in training else training[y.name].unionByName(found)
        for slice_, name in y.predictions.items():
            path = f"{root}/{name}"
            paths.append(path)
            if not exists(spark, path):
                continue
            read = read_predictions(spark, path)
            head = read.select("system", "manifest").distinct().collect()
            if [(h["system"], h["manifest"]) for h in head] != [(y.name, names.get(slice_))]:
                raise ValueError(f"{path} is not of {y.name} on {names.get(slice_)}")
            predictions = predictions.unionByName(read.select("system", F.lit(slice_).alias("slice"), "id", "hypothesis", "predictions_sha256"))
    return segments, predictions, training, tuple(paths)


def runs(spec: Spec) -> list[dict]:
    """What must be transcribed for a report: a run for each system and slice that is not declared pending, once each."""
    out = {}
    for y in spec.systems:
        for s in spec.slices:
            if s.name not in y.pending_slices:
                mode = y.inference_modes.get(s.name, LONG_FORM if s.domain == "long-form" else SHORT)
                out[y.name, s.name] = {"system": y.name, "slice": s.name, "manifest": s.manifest, "predictions": y.predictions.get(s.name), "model_id": y.model_id, "mode": mode}
    return list(out.values())
