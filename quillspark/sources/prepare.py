"""Manifests from index files: columns filled and checked, audio held against its files, splits gathered and audited."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import collapse_spaces, strip
from quillspark.operators import leakage, manifests
from quillspark.operators.scoring import require_empty
from quillspark.sources import files, sinks
from quillspark.sources.files import SEGMENT_FIELDS


@dataclass(frozen=True)
class Header:
    """What a manifest says about all its segments."""

    name: str
    source: str
    split: str
    domain: str
    version: str
    language: str = "bn"

    def __post_init__(self) -> None:
        if not all(isinstance(x, str) and x.strip() for x in vars(self).values()) or self.split not in manifests.SPLITS:
            raise ValueError(f"a manifest needs a name, source, domain, version and a split of {manifests.SPLITS}")


def build_manifest(rows: DataFrame, header: Header, durations: DataFrame | None = None, files_: DataFrame | None = None) -> DataFrame:
    """Segments of a manifest from rows (id, audio, text and any other fields of a segment), in the rows' order of id.

    Rows without text are left out.  A row without a length takes its file's (durations: audio, seconds), but an
    aligned one, which has a start, must tell its own.  recording_id is the id where it is missing, the language the
    manifest's.  files_ (audio, file_key, sha256) fills in the digests and checks declared ones.
    """
    kinds = dict(x.strip().split(" ") for x in manifests.SEGMENT.split(","))
    known = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in SEGMENT_FIELDS))
    known = known.withColumn("text", strip(F.col("text"))).where(F.coalesce(collapse_spaces(F.col("text")), F.lit("")) != "")
    require_empty(known.where("start_s is not null and duration_s is null"), "aligned segments need a length")
    require_empty(known.where(~F.coalesce(manifests.relative_audio_path(F.col("audio")), F.lit(False))), "audio outside the root")
    if durations is not None:
        known = known.join(durations.select("audio", F.col("seconds").alias("__seconds")), "audio", "left")
        known = known.withColumn("duration_s", F.coalesce("duration_s", "__seconds")).drop("__seconds")
    known = known.withColumns({"recording_id": F.coalesce("recording_id", "id"), "language": F.coalesce("language", F.lit(header.language))})
    if files_ is not None:
        known = leakage.with_file_hashes(known, files_).drop("file_key")
    told = {"manifest": header.name, "source": header.source, "split": header.split, "domain": header.domain, "version": header.version}
    placed = manifests.numbered_rows(known.select(*SEGMENT_FIELDS), [F.col("id")]).withColumnRenamed("place", "pos")
    out = placed.withColumns({k: F.lit(v) for k, v in told.items()} | {"manifest_pos": F.lit(0)})
    manifests.check_manifest(out)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class Index:
    """One split of a dataset: its header, the files it is read from (the first must be there, others may) and how."""

    header: Header
    paths: tuple[str, ...]
    read: object
    missing: str


def known_indexes(root: str, loops: dict[str, str] | None = None) -> list[Index]:
    """The indexes of the datasets that are known, below a root with a folder each."""
    out = []
    for split in manifests.SPLITS:
        read = partial(files.common_voice, root="common_voice/clips")
        paths = (f"{root}/common_voice/{split}.tsv", f"{root}/common_voice/clip_durations.tsv")
        out.append(Index(Header(f"cv-bn-{split}", "common_voice_bn", split, "read", "cv-corpus-26.0"), paths, read, f"Common Voice {split}"))
    out.append(Index(Header("fleurs-bn-test", "fleurs_bn", "test", "read", "fleurs"), (f"{root}/fleurs/test.tsv",), partial(files.fleurs, root="fleurs/audio"), "FLEURS test"))
    for split in ("train", "test"):
        paths = tuple(f"{root}/mucs/{split}/{n}" for n in ("text", "wav.scp", "segments", "utt2spk"))
        out.append(Index(Header(f"mucs-cs-{split}", "mucs_slr104", split, "code-switch", "SLR104"), paths, files.kaldi, f"MUCS {split}"))
    for name, path in (loops or {}).items():
        out.append(Index(Header(name, "bengali_loop", "test", "long-form", "operator-recorded-release"), (path,), files.loop_jsonl, name))
    return out


@dataclass(frozen=True)
class Prepared:
    manifests: dict[str, DataFrame]
    audits: dict[str, DataFrame]
    pending: tuple[str, ...]


def prepare(spark: SparkSession, indexes: list[Index], licenses: DataFrame, folder: str | None = None, durations: DataFrame | None = None, files_: DataFrame | None = None) -> Prepared:
    """Read the splits that are there, check each and its license, audit evaluation against training, then write.

    What is missing or excluded is pending.  Nothing is written unless every input is valid.
    """
    made: dict[str, DataFrame] = {}
    pending = []
    splits = {}
    states = {r["id"]: r["status"] for r in licenses.select("id", "status").collect()}  # a registry's few rows
    for index in indexes:
        header = index.header
        if states.get(header.source) == "excluded":
            pending.append(f"{index.missing}: permissions are unconfirmed")
        elif not exists(spark, index.paths[0]):
            pending.append(f"{index.missing}: local index missing")
        else:
            if header.source not in states or (states[header.source] == "eval-only" and header.split == "train"):
                raise ValueError(f"the license of {header.source} does not allow {header.split}")
            rows = index.read(spark, *(p if exists(spark, p) else None for p in index.paths))
            made[header.name] = build_manifest(rows, header, durations, files_)
            splits[header.name] = header
    trains = [df for name, df in made.items() if splits[name].split == "train"]
    audits = {}
    if trains:
        train = trains[0]
        for more in trains[1:]:
            train = train.unionByName(more)
        audits = {name: leakage.verdict(train, df) for name, df in made.items() if splits[name].split != "train"}
    for name, df in made.items() if folder else ():
        sinks.write_lines(sinks.manifest_lines(df, vars(splits[name])), f"{folder}/{name}.manifest.jsonl")
    return Prepared(made, audits, tuple(pending))
