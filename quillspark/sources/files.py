"""Readers of transcript index files: strict delimited text, header-line JSONL, Kaldi tables, WAV lengths.

Index files come through Spark's text source (see lines), so any store that Spark reads will do, and a file is as many
tasks as it has splits.  Rows carry line, the physical line at which a record starts.
"""

from __future__ import annotations

import json
import re
import tomllib
import wave
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import collapse_spaces, is_blank, stem
from quillspark.operators.manifests import SEGMENT, key_differences, parse_number
from quillspark.operators.scoring import require_empty
from quillspark.sources.lines import PART, numbered_lines, quoted_records
from quillspark.sources.streams import Opener, read_each, sha256_of

SEGMENT_FIELDS = [x.strip().split(" ")[0] for x in SEGMENT.split(",")]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha): the SHA-256 of each file's bytes; of a folder of parts, that of its parts' digests in order."""
    found = read_each(spark, path, sha256_of, "sha string")
    parts = found.groupBy(F.regexp_replace("file", PART, "").alias("path")).agg(F.array_sort(F.collect_list(F.struct("file", "sha")))["sha"].alias("shas"))
    return parts.select("path", F.when(F.size("shas") == 1, F.col("shas")[0]).otherwise(F.sha2(F.array_join("shas", ""), 256)).alias("sha"))


def delimited_rows(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(path, line, fields): strict quoting, a byte-order mark skipped, quoted line breaks kept."""
    return quoted_records(spark, path, delimiter)


def named_rows(spark: SparkSession, path: str, required: list[str], delimiter: str = "\t", skip_blank: bool = False) -> DataFrame:
    """(path, line, row map) of a table with a header line: unique names, the required ones, exact widths."""
    records = quoted_records(spark, path, delimiter)
    heads = records.groupBy("path").agg(F.min_by("fields", "line").alias("header"), F.min("line").alias("head"))
    # Spark reads no empty files, but lists them
    names = [(re.sub("^file:/+", "file:/", x),) for x in spark.read.format("binaryFile").load(path).inputFiles()]
    listed = spark.createDataFrame(names, "path string").select(F.regexp_replace("path", PART, "").alias("path")).distinct()
    require_empty(listed.join(heads, "path", "left_anti"), "files without a header", "path")
    missing = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.col("header"))
    fine = (F.size(F.array_distinct("header")) == F.size("header")) & (F.size(missing) == 0)
    wrong = F.raise_error(F.concat("path", F.lit(f": the header must hold {required}, each name once")))
    checked = heads.select("path", F.when(fine, F.col("header")).otherwise(wrong).alias("header"), "head")
    rows = checked.join(records, "path").where("line > head")
    if skip_blank:
        rows = rows.where("size(fields) > 0")
    sizes = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.size("fields").cast("string"), F.lit(" fields, not "), F.size("header").cast("string"))
    fit = F.when(F.size("fields") == F.size("header"), F.map_from_arrays("header", "fields")).otherwise(F.raise_error(sizes))
    return rows.select("path", "line", fit.alias("row"))


def strict_object(text: str) -> dict:
    """A JSON object without repeated keys and without NaN."""

    def pairs(items: list) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name: str):
        raise ValueError(f"{name} is no JSON number")

    found = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def _object(name: str, line: int, text: str) -> dict:
    try:
        return strict_object(text)
    except ValueError as e:
        raise ValueError(f"{name}:{line}: {e}") from e


def headed_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, sha, head, line, pos, value) of JSONL texts whose first record holds only the key: head is its value as JSON text,
    value a record's line, pos its place from 0.

    Every file is read by as many tasks as it has splits; headers are a row a text.
    """
    lines = numbered_lines(spark, path)

    @F.udf("string")
    def head(name: str, text: str) -> str:
        found = _object(name, 1, text) if text is not None else {}
        if set(found) != {key}:
            raise ValueError(f"{name}: the first record must hold only {key}")
        return json.dumps(found[key], ensure_ascii=False)

    first = digests(spark, path).join(lines.where("nth = 1").select("path", "value"), "path", "left")
    heads = first.select("path", "sha", head("path", "value").alias("head"))
    return heads.join(lines.where("nth > 1"), "path").select("path", "sha", "head", "line", (F.col("nth") - 2).alias("pos"), "value")


MANIFEST = "manifest string, manifest_file string, manifest_sha256 string, source string, split string, domain string, version string, pos long, " + SEGMENT


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Segments of manifest files with their header's fields and their order; unknown fields are errors."""
    header = {"name", "source", "split", "domain", "version", "language", "checksum"}
    columns = [x.strip().split(" ")[0] for x in MANIFEST.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, sha, raw, line, pos, text in frame[["path", "sha", "head", "line", "pos", "value"]].itertuples(index=False):
                head = json.loads(raw)
                if not set(head) <= header or not {"name", "source", "split", "domain", "version"} <= set(head):
                    raise ValueError(f"{name}: wrong manifest fields")
                r = _object(name, line, text)
                if not set(r) <= set(SEGMENT_FIELDS):
                    raise ValueError(f"{name}:{line}: unknown fields {sorted(set(r) - set(SEGMENT_FIELDS))}")
                r.setdefault("language", head.get("language", "bn"))
                rows.append((head["name"], name, sha, head["source"], head["split"], head["domain"], head["version"], pos, *(r.get(c) for c in SEGMENT_FIELDS)))
            yield pd.DataFrame(rows, columns=columns)

    return headed_records(spark, path, "manifest").mapInPandas(run, MANIFEST)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(system, manifest, predictions_sha256, id, hypothesis) of prediction files; other record fields are ignored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, sha, raw, line, text in frame[["path", "sha", "head", "line", "value"]].itertuples(index=False):
                head, r = json.loads(raw), _object(name, line, text)
                if not isinstance(r.get("id"), str) or not isinstance(r.get("hypothesis"), str):
                    raise ValueError(f"{name}:{line}: id and hypothesis must be strings, ids unique")
                rows.append((name, line, head["system"], head["manifest"], sha, r["id"], r["hypothesis"]))
            yield pd.DataFrame(rows, columns=["path", "line", "system", "manifest", "predictions_sha256", "id", "hypothesis"])

    schema = "path string, line long, system string, manifest string, predictions_sha256 string, id string, hypothesis string"
    told = headed_records(spark, path, "predictions").mapInPandas(run, schema)
    nth = F.row_number().over(Window.partitionBy("path", "id").orderBy("line"))
    twice = F.raise_error(F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": ids must be unique")))
    return told.withColumn("__nth", nth).select("system", "manifest", "predictions_sha256", F.when(F.col("__nth") == 1, F.col("id")).otherwise(twice).alias("id"), "hypothesis")


LICENSE = (
    "id string, name string, url string, license string, redistributable_audio boolean, attribution_required boolean, share_alike boolean, "
    "access string, status string, hours double, domain string, version string, notes string, confidence string"
)
_LICENSE_FIELDS = [x.strip().split(" ")[0] for x in LICENSE.split(",")]
_NULLABLE = {"redistributable_audio", "attribution_required", "share_alike", "hours"}


def read_licenses(spark: SparkSession, text: str, kind: str = "toml") -> DataFrame:
    """The license registry from the text of a TOML or JSON file; TOML may leave out nullable fields."""
    rows = (tomllib.loads(text) if kind == "toml" else strict_object(text)).get("licenses")
    if not isinstance(rows, list):
        raise ValueError("a registry holds a list of licenses")
    for r in rows:
        missing = set(_LICENSE_FIELDS) - set(r) - (_NULLABLE if kind == "toml" else set())
        if missing or not set(r) <= set(_LICENSE_FIELDS):
            raise ValueError(f"license {r.get('id')}: wrong fields {sorted(missing | (set(r) - set(_LICENSE_FIELDS)))}")
        if r["status"] not in ("approved", "eval-only", "pending", "excluded"):
            raise ValueError(f"license {r['id']}: unknown status")
    if len({r["id"] for r in rows}) != len(rows):
        raise ValueError("license ids must be unique")
    data = [tuple(float(r[c]) if c == "hours" and r.get(c) is not None else r.get(c) for c in _LICENSE_FIELDS) for r in rows]
    return spark.createDataFrame(data, LICENSE)


def _segments(df: DataFrame, **columns: Column) -> DataFrame:
    """df as segment rows; columns that are not given are null, language bn."""
    kinds = dict(x.strip().split(" ") for x in SEGMENT.split(","))
    filled = {"language": F.lit("bn")} | columns
    return df.select(*(filled.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in SEGMENT_FIELDS))


def common_voice(spark: SparkSession, tsv: str, durations: str | None = None, root: str = "clips") -> DataFrame:
    """Common Voice index: blank sentences skipped, id the clip's stem, recording the client or else the id."""
    row = F.col("row")
    rows = named_rows(spark, tsv, ["path", "sentence"], skip_blank=True).where(~is_blank(row["sentence"]))
    rows = rows.select(row["path"].alias("clip"), row["sentence"].alias("text"), F.nullif(row["client_id"], F.lit("")).alias("client"))
    if durations:
        told = named_rows(spark, durations, [], skip_blank=True)
        value = F.coalesce(row["duration[ms]"], row["duration"])
        told = told.select(F.coalesce(row["clip"], row["path"]).alias("clip"), (parse_number(value) / 1000.0).alias("seconds"))
        require_empty(told.where("seconds is null or seconds <= 0"), "durations must be positive", "clip")
        require_empty(told.groupBy("clip").count().where("count > 1"), "repeated clips", "clip")
        rows = rows.join(told, "clip", "left")
    else:
        rows = rows.withColumn("seconds", F.lit(None).cast("double"))
    name = stem(F.col("clip"))
    return _segments(
        rows, id=name, audio=F.concat(F.lit(f"{root}/"), "clip"), text=F.col("text"), duration_s=F.col("seconds"),
        recording_id=F.coalesce("client", name), speaker=F.col("client"),
    )


def fleurs(spark: SparkSession, tsv: str, root: str = "audio") -> DataFrame:
    """FLEURS index without header: id, file, raw, transcription, samples at 16 kHz, gender."""
    f = F.col("fields")
    rows = delimited_rows(spark, tsv).where(F.size(f) > 0)
    require_empty(rows.where(F.size(f) != 6), "rows need six fields", "line")
    rows = rows.where(~is_blank(f[3]))
    require_empty(rows.where(~f[4].rlike(r"^0*[1-9][0-9]*$")), "samples must be a positive whole number", "line")
    name = stem(f[1])
    return _segments(rows, id=name, audio=F.concat(F.lit(f"{root}/"), f[1]), text=f[3], duration_s=f[4].cast("double") / 16000.0, recording_id=name)


def slr53(spark: SparkSession, tsv: str, wavs: DataFrame) -> DataFrame:
    """SLR53 index without header: file id, speaker, text; wavs (stem, audio, duration_s) must have every file once."""
    f = F.col("fields")
    rows = delimited_rows(spark, tsv).where(F.size(f) > 0)
    require_empty(rows.where(F.size(f) != 3), "rows need three fields", "line")
    rows = rows.where(~is_blank(f[2])).select(f[0].alias("stem"), f[1].alias("speaker"), f[2].alias("text"))
    require_empty(wavs.groupBy("stem").count().where("count > 1"), "repeated file stems", "stem")
    require_empty(rows.join(wavs, "stem", "left_anti"), "missing audio files", "stem")
    joined = rows.join(wavs, "stem")
    return _segments(joined, id=F.col("stem"), audio=F.col("audio"), text=F.col("text"), duration_s=F.col("duration_s"), recording_id=F.col("speaker"), speaker=F.col("speaker"))


def loop_jsonl(spark: SparkSession, path: str, root: str = "", split: str = "test") -> DataFrame:
    """JSONL index with id, audio_filepath, duration and text; absolute paths below root become relative.

    Its rows are whole recordings, so they are for evaluation only.
    """
    if split == "train":
        raise ValueError("whole recordings are for evaluation only; training needs aligned segments")
    base = root.rstrip("/") + "/" if root else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, line, text in frame[["path", "line", "value"]].itertuples(index=False):
                r = _object(name, line, text)
                if not {"id", "audio_filepath", "duration", "text"} <= set(r):
                    raise ValueError(f"{name}:{line}: missing fields")
                audio = r["audio_filepath"]
                if audio.startswith("/"):
                    if not base or not audio.startswith(base):
                        raise ValueError(f"{name}:{line}: audio outside the root")
                    audio = audio.removeprefix(base)
                rows.append((r["id"], audio, r["text"], float(r["duration"]), r["id"], None, None, r.get("language", "bn"), r.get("audio_sha256")))
            yield pd.DataFrame(rows, columns=SEGMENT_FIELDS)

    return numbered_lines(spark, path).mapInPandas(run, SEGMENT)


def kaldi_pairs(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of lines of an id, white space and a non-empty value; ids unique."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line")).where(~is_blank(F.col("line")))
    pairs = lines.select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias(key), F.trim(F.regexp_extract("line", r"^\s*\S+\s+(.*)$", 1)).alias(value))
    require_empty(pairs.where(is_blank(F.col(value))), f"{path}: ids without a value", key)
    require_empty(pairs.groupBy(key).count().where("count > 1"), f"{path}: repeated ids", key)
    return pairs


def kaldi(spark: SparkSession, text: str, wav_scp: str, segments: str | None = None, utt2spk: str | None = None) -> DataFrame:
    """Kaldi directory: text joined to utt2spk, segments and wav.scp, whose id sets must agree."""
    rows = kaldi_pairs(spark, text, "id", "text")
    wavs = kaldi_pairs(spark, wav_scp, "rec", "audio")
    if utt2spk:
        speakers = kaldi_pairs(spark, utt2spk, "id", "speaker")
        require_empty(key_differences(rows, speakers, "id"), "text and utt2spk differ")
        rows = rows.join(speakers, "id")
    else:
        rows = rows.withColumn("speaker", F.lit(None).cast("string"))
    if not segments:
        require_empty(key_differences(rows, wavs.withColumnRenamed("rec", "id"), "id"), "text and wav.scp differ")
        joined = rows.join(wavs, rows.id == wavs.rec)
        return _segments(joined, id=F.col("id"), audio=F.col("audio"), text=F.col("text"), recording_id=F.coalesce("speaker", "id"), speaker=F.col("speaker"))
    parts = kaldi_pairs(spark, segments, "id", "rest")
    parts = parts.select("id", F.split(collapse_spaces(F.col("rest")), " ").alias("p"))
    require_empty(parts.where("size(p) <> 3"), "segments need four fields")
    parts = parts.select("id", F.col("p")[0].alias("rec"), parse_number(F.col("p")[1]).alias("lo"), parse_number(F.col("p")[2]).alias("hi"))
    require_empty(parts.where("lo is null or hi is null or lo < 0 or hi <= lo"), "segments need a time interval")
    require_empty(key_differences(rows, parts, "id"), "text and segments differ")
    require_empty(parts.join(wavs, "rec", "left_anti"), "recordings missing from wav.scp", "rec")
    joined = rows.join(parts, "id").join(wavs, "rec")
    return _segments(
        joined, id=F.col("id"), audio=F.col("audio"), text=F.col("text"), duration_s=F.col("hi") - F.col("lo"),
        recording_id=F.col("rec"), start_s=F.col("lo"), speaker=F.col("speaker"),
    )


def _wav(stream: BinaryIO) -> tuple[float, str]:
    """Length and digest of a WAV file: the header is read, then the bytes in turn."""
    with wave.open(stream) as w:
        seconds = w.getnframes() / w.getframerate()
    stream.seek(0)
    return seconds, *sha256_of(stream)


def _wav_header(stream: BinaryIO) -> tuple[float, None]:
    with wave.open(stream) as w:
        return w.getnframes() / w.getframerate(), None


def wav_durations(spark: SparkSession, path: str, recursive: bool = False, hashed: bool = True, opener: Opener | None = None) -> DataFrame:
    """(path, stem, duration_s, sha256) of WAV files, in all folders below path if recursive.

    If not hashed only headers are read, and sha256 is null.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.[wW][aA][vV]"} if recursive else {}
    rows = read_each(spark, path, _wav if hashed else _wav_header, "duration_s double, sha256 string", opener, **options)
    return rows.select("path", "sha256", "duration_s", stem(F.col("path")).alias("stem"))


def below_root(spark: SparkSession, root: str) -> Column:
    """A file's path relative to root, whatever form the store gives it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "")
    return F.when(F.startswith(path, F.lit(full)), F.substring(path, len(full) + 1, 1 << 20)).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)))


def file_hashes(spark: SparkSession, root: str, opener: Opener | None = None) -> DataFrame:
    """(path, sha256) of all files below root that Spark lists, paths relative to it; a root without files is an error."""
    found = read_each(spark, root, sha256_of, "sha256 string", opener, recursiveFileLookup="true")
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").limit(1).count():
        raise ValueError(f"no files below {root}")
    return found.select(below_root(spark, root).alias("path"), "sha256")


def wav_index(spark: SparkSession, root: str) -> DataFrame:
    """(stem, audio, duration_s, sha256) of the WAV files below root, as slr53 asks for; a stem must be there once."""
    lengths = wav_durations(spark, f"{root.rstrip('/')}/", recursive=True)
    found = lengths.select("stem", below_root(spark, root).alias("audio"), "duration_s", "sha256")
    require_empty(found.groupBy("stem").count().where("count > 1"), "repeated file stems", "stem")
    return found
