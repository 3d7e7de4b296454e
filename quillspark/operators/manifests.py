"""Segments and manifests: contracts, collapsing to recordings, windows, licenses and selection for training."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.generator import sample_flags
from quillspark.functions.text import is_blank, normalize
from quillspark.operators.leakage import overlap_rows, require_no_leakage, with_file_hashes
from quillspark.operators.scoring import require_empty
from quillspark.storage import store

SEGMENT = (
    "id string, audio string, text string, duration_s double, recording_id string, start_s double, speaker string, "
    "language string, audio_sha256 string"
)
SPLITS = ("train", "dev", "test")
STATUSES = ("approved", "eval-only", "pending", "excluded")
TOLERANCE = 1e-3


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def relative_audio_path(path: Column) -> Column:
    """A relative POSIX path without empty, . and .. parts, backslashes, NUL or a drive."""
    return path.isNotNull() & ~path.rlike(r"^/|\\|\x00|^[A-Za-z]:|(^|/)\.{0,2}(/|$)")


def parse_number(text: Column) -> Column:
    """float(text) of Python for finite decimal notation, null otherwise."""
    fine = F.trim(text).rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    return F.when(fine, F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def violations(segments: DataFrame) -> DataFrame:
    """segments plus violations, the messages of the contract's rules that a row breaks."""
    start, length = F.col("start_s"), F.col("duration_s")
    rules = (
        (is_blank(F.col("id")), "id is blank"),
        (~F.coalesce(relative_audio_path(F.col("audio")), F.lit(False)), "audio is no relative path"),
        (is_blank(F.col("text")), "text is blank"),
        (~finite(length) | (length <= 0), "duration_s must be positive"),
        (is_blank(F.col("recording_id")), "recording_id is blank"),
        (start.isNotNull() & (~finite(start) | (start < 0)), "start_s must not be negative"),
        (start.isNotNull() & ~finite(start + length), "the window has no end"),
        (is_blank(F.col("language")), "language is blank"),
        (F.col("audio_sha256").isNotNull() & ~F.lower("audio_sha256").rlike("^[0-9a-f]{64}$"), "audio_sha256 is no digest"),
    )
    return segments.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules))))


def check_manifest(segments: DataFrame) -> None:
    """Raise ValueError unless the rows keep the contract, ids are unique and there is one row at least."""
    require_empty(violations(segments).where(F.size("violations") > 0), "invalid segments")
    require_empty(segments.groupBy("id").count().where("count > 1"), "duplicate segment ids")
    total = segments.agg(F.count("*"), F.sum("duration_s")).first()
    if not total[0] or not float("-inf") < total[1] < float("inf"):
        raise ValueError("a manifest needs segments of finite total duration")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, side): the key values that only one side has; none if the key sets are equal."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    return both.where("__a is null or __b is null").select(*keys, F.when(F.col("__b").isNull(), "left").otherwise("right").alias("side"))


def total_hours(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.groupBy(*keys).agg((F.sum("duration_s") / 3600).alias("hours"), F.count("*").alias("segments"))


def recording_ids(segments: DataFrame) -> DataFrame:
    return segments.select("recording_id").distinct().orderBy("recording_id")


def validate_window(
    path: str = "audio", start: str = "start_s", length: str = "duration_s", actual: str = "actual_s", tolerance: float = TOLERANCE
) -> Column:
    """The seconds of a window held against its file's: a whole file within the tolerance, a crop clamped to the file's end.

    Without a start the window is the whole file; without a length it goes to the file's end.  A window that is empty,
    begins at or behind the end, or reaches beyond it is an error.
    """
    if not 0 <= tolerance <= 0.01:
        raise ValueError("the tolerance must lie between 0 and 0.01 seconds")
    s, d, a = F.col(start), F.col(length), F.col(actual)
    wrong = F.raise_error(F.concat(F.lit("window does not fit "), F.col(path)))
    whole = d.isNull() | (F.abs(d - a) <= tolerance)
    selected = F.coalesce(d, a - s)
    crop = (s >= 0) & (s < a) & (selected <= a - s + tolerance)
    sane = finite(a) & (a > 0) & (d.isNull() | (finite(d) & (d > 0)))
    return (
        F.when(~F.coalesce(sane, F.lit(False)), wrong)
        .when(s.isNull(), F.when(whole, a).otherwise(wrong))
        .otherwise(F.when(F.coalesce(crop, F.lit(False)), F.least(selected, a - s)).otherwise(wrong))
    )


def collapse_to_recordings(segments: DataFrame, strict: bool = True) -> DataFrame:
    """One row a recording: texts in order of start, duration to the last end, or as the column measured_s tells.

    Errors (raised, or flagged false in the column consistent if not strict): several audios, languages or hashes,
    untimed segments among several, overlapping segments, a measured length that doesn't cover the segments.
    """
    begin = F.coalesce("start_s", F.lit(0.0))
    measured = "measured_s" in segments.columns
    own = F.struct(begin.alias("lo"), "id", "text", (begin + F.col("duration_s")).alias("hi"))

    def kinds(name: str) -> Column:
        return F.count_distinct(F.coalesce(F.col(name), F.lit("\x00")))

    grouped = segments.groupBy("recording_id").agg(
        F.array_sort(F.collect_list(own)).alias("spans"),
        F.count("*").alias("n"),
        F.count("start_s").alias("timed"),
        *(kinds(c).alias(f"{c}_kinds") for c in ("audio", "language", "audio_sha256", "speaker")),
        *(F.min(c).alias(c) for c in ("audio", "language", "audio_sha256", "speaker")),
        *([F.max("measured_s").alias("measured_s")] if measured else []),
    )
    earlier, later = F.expr("slice(spans, 1, size(spans) - 1)"), F.expr("slice(spans, 2, size(spans) - 1)")
    apart = F.forall(F.zip_with(earlier, later, lambda a, b: b.lo >= a.hi), lambda x: x)
    one = (F.col("audio_kinds") == 1) & (F.col("language_kinds") == 1) & (F.col("audio_sha256_kinds") == 1)
    consistent = one & ((F.col("n") == 1) | (F.col("timed") == F.col("n"))) & ((F.col("n") == 1) | apart)
    end = F.array_max(F.transform("spans", lambda s: s.hi))
    if measured:
        covered = F.coalesce(finite(F.col("measured_s")) & (F.col("measured_s") >= end), F.lit(False))
        consistent, end = consistent & covered, F.col("measured_s")
    if strict:
        end = F.when(consistent, end).otherwise(F.raise_error(F.concat(F.lit("inconsistent recording "), F.col("recording_id"))))
    return grouped.select(
        F.col("recording_id").alias("id"),
        "audio",
        F.array_join(F.transform("spans", lambda s: s.text), " ").alias("text"),
        end.alias("duration_s"),
        "recording_id",
        F.lit(None).cast("double").alias("start_s"),
        F.when(F.col("speaker_kinds") == 1, F.col("speaker")).alias("speaker"),
        "language",
        "audio_sha256",
        *([] if strict else [consistent.alias("consistent")]),
    )


def license_state(manifests: DataFrame, registry: DataFrame, training: bool = False) -> DataFrame:
    """manifests (source, split, ...) plus status and problem, null if the license allows the use.

    The registry has one row a dataset; it is joined by whatever strategy its size allows.
    """
    known = registry.select(F.col("id").alias("source"), "status")
    problem = (
        F.when(F.col("status").isNull(), "not registered")
        .when(F.col("status") == "excluded", "excluded")
        .when(F.lit(training) & (F.col("split") != "train"), "not a training split")
        .when((F.col("status") == "eval-only") & (F.lit(training) | (F.col("split") == "train")), "for evaluation only")
    )
    return manifests.join(known, "source", "left").withColumn("problem", problem)


def sources_of(registry: DataFrame, status: str | None = None) -> DataFrame:
    """The registry in order of status and id."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return (registry if status is None else registry.where(F.col("status") == status)).orderBy(rank, "id")


def sampled_places(spark: SparkSession, count: int, fraction: float, seed: int) -> DataFrame:
    """(place): a seeded sample of round(fraction * count) places out of count, those of random.Random(seed).sample.

    The seeded generator is one sequence, so one executor task reads its words in blocks and flags places, a byte each;
    it writes them in blocks, and the driver holds none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            flags = sample_flags(seed, count, round(fraction * count))
            for at in range(0, count, 1_000_000):
                yield pd.DataFrame({"place": np.flatnonzero(flags[at : at + 1_000_000]) + at})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "place long")


def select_examples(
    segments: DataFrame, min_s: float = 1.0, max_s: float = 30.0, fraction: float = 0.0, seed: int = 0, strict: bool = True
) -> DataFrame:
    """Segments of inclusive duration range in training order, a seeded sample of them flagged use_timestamps.

    Errors if strict: an empty normalised text, no rows, repeated (source, id) or (audio, start or 0, duration).
    """
    begin = F.coalesce("start_s", F.lit(0.0))
    chosen = segments.where(F.col("duration_s").between(min_s, max_s))
    if strict:
        require_empty(chosen.where(normalize(F.col("text")) == ""), "texts that normalise to nothing")
        require_empty(duplicates(chosen, "source", "id"), "repeated ids")
        require_empty(duplicates(chosen.withColumn("__begin", begin), "audio", "__begin", "duration_s"), "repeated windows", "audio")
    order = ["source", "recording_id", "audio", begin, "id"]
    count = chosen.count() if fraction or strict else 0
    if strict and not count:
        raise ValueError("no segment is within the duration range")
    if not fraction:
        return chosen.withColumn("use_timestamps", F.lit(False)).orderBy(*order)
    spark = segments.sparkSession
    places = sampled_places(spark, count, fraction, seed).withColumn("picked", F.lit(True))
    numbered = numbered_rows(chosen, order)
    return (
        numbered.join(places, "place", "left")
        .withColumn("use_timestamps", F.coalesce("picked", F.lit(False)))
        .drop("picked")
        .orderBy("place")
        .drop("place")
    )


def numbered_rows(df: DataFrame, order: list) -> DataFrame:
    """df plus place, its row number in order from 0: range partitions are numbered by their sizes, then inside.

    No task sees all rows; the windows run within a partition, and over one row a partition.  The ranges come from a
    sample, so they are stored: both uses, and any task that runs again, see the same ones.
    """
    ranged = store(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return inside.join(starts, "__part").withColumn("place", F.col("__start") + F.col("__row") - 1).drop("__part", "__row", "__start")


ROLES = {"train": ("train",), "eval": ("dev", "test")}


def role_problems(segments: DataFrame, registry: DataFrame, role: str) -> DataFrame:
    """(manifest, problem): why manifests must not be used for a role (train, eval); none if all may.

    segments (manifest, manifest_pos, source, split, ...): a name must belong to one manifest, the split to the role,
    and the license must allow it.
    """
    if role not in ROLES:
        raise ValueError(f"a role is one of {sorted(ROLES)}")
    heads = segments.select("manifest", "manifest_pos", "source", "split").distinct()
    twice = heads.groupBy("manifest").count().where("count > 1").select("manifest", F.lit("several manifests of one name").alias("problem"))
    split = heads.where(~F.col("split").isin(*ROLES[role])).select("manifest", F.concat(F.lit(f"not for {role}: "), "split").alias("problem"))
    license_ = license_state(heads, registry, training=role == "train").where("problem is not null").select("manifest", "problem")
    return twice.unionByName(split).unionByName(license_).distinct()


def clamped_windows(segments: DataFrame) -> DataFrame:
    """segments (audio, audio_sha256, start_s, duration_s, actual_s) plus begin_s and window_s: what a window takes of its file."""
    return segments.withColumns({"begin_s": F.coalesce("start_s", F.lit(0.0)), "window_s": validate_window()})


def repeated_windows(segments: DataFrame) -> DataFrame:
    """(audio_sha256, begin_s, window_s, n): windows that several segments take, also under other paths of a file's bytes.

    Windows are compared as they are clamped to the file's end, so lengths that differ within the tolerance are one.
    """
    return duplicates(clamped_windows(segments), "audio_sha256", "begin_s", "window_s")


def training_preflight(
    train: DataFrame,
    development: DataFrame,
    registry: DataFrame,
    files: DataFrame,
    held_out: DataFrame | None = None,
    language: str = "bn",
    reviewed: DataFrame | None = None,
    **selection,
) -> tuple[DataFrame, DataFrame]:
    """The examples of a training run and of its evaluation, once every gate is passed (ValueError otherwise).

    Gates: manifests fit their role and license, development ones are of split dev, names are distinct over all sides,
    rows are in the language; files (audio, file_key, sha256, actual_s) have every audio, with the declared digest, and
    windows fit them; among the examples of a side no window repeats; development and held-out rows share no id, audio or
    file; training shares nothing with either but texts that reviewed (key, reason) approves.
    """
    sides = {"train": train, "dev": development} | ({"held out": held_out} if held_out is not None else {})
    if development.limit(1).count() == 0:
        raise ValueError("training needs development manifests")
    require_empty(development.where("NOT split <=> 'dev'"), "development manifests must be of split dev", "manifest")
    for side, df in sides.items():
        role = "train" if side == "train" else "eval"
        require_empty(role_problems(df, registry, role).select(F.concat_ws(": ", "manifest", "problem").alias("p")), f"unusable manifests for {role}", "p")
        require_empty(df.where(~F.col("language").eqNullSafe(F.lit(language))), f"{side} rows in another language than {language}", "manifest")
    heads = reduce(DataFrame.unionByName, (df.select("manifest").distinct().withColumn("side", F.lit(k)) for k, df in sides.items()))
    require_empty(duplicates(heads, "manifest"), "manifests of one name on several sides", "manifest")
    lengths = files.select(F.col("audio"), "actual_s")
    known = {k: store(clamped_windows(with_file_hashes(df, files).join(lengths, "audio")), k.replace(" ", "-")) for k, df in sides.items()}
    examples = []
    for side in ("train", "dev"):
        own = {k: v for k, v in selection.items() if side == "train" or k not in ("fraction", "seed")}
        chosen = select_examples(known[side].drop("begin_s", "window_s", "file_key"), **own)
        require_empty(repeated_windows(chosen), f"repeated windows among the {side} examples, under any path", "audio_sha256")
        examples.append(chosen.drop("actual_s"))
    if held_out is not None:
        hard = overlap_rows(known["dev"], known["held out"], ("file", "id", "audio"))
        require_empty(hard, "development and held-out manifests overlap", "key")
    evaluation = reduce(DataFrame.unionByName, (df for k, df in known.items() if k != "train"))
    require_no_leakage(known["train"], evaluation, ("file", "id", "text", "audio"), reviewed)
    return examples[0], examples[1]


def experiment_table(runs: DataFrame, base: str) -> DataFrame:
    """runs (run, hours, steps, wer, cer) plus wer_delta and cer_delta against the run named base, in order of wer."""
    if runs.where(F.col("run") == base).limit(1).count() == 0:
        raise ValueError(f"no run is named {base}")
    own = runs.where(F.col("run") == base).select(F.col("wer").alias("__wer"), F.col("cer").alias("__cer"))
    require_empty(runs.groupBy("run").count().where("count > 1"), "repeated runs", "run")
    rows = runs.crossJoin(F.broadcast(own))  # one row
    deltas = {f"{m}_delta": F.col(m) - F.col(f"__{m}") for m in ("wer", "cer")}
    return rows.withColumns(deltas).drop("__wer", "__cer").orderBy(F.col("wer").asc_nulls_last(), "run")
