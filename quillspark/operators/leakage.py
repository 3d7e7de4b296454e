"""Overlap of training and evaluation segments by id, normalised text, content hash and file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalize
from quillspark.operators.scoring import first_values, require_empty
from quillspark.storage import store

KINDS = ("id", "text", "audio")
#: Rank in results.
ORDER = {"file": 0, "id": 1, "text": 2, "audio": 3}


def with_file_hashes(segments: DataFrame, files: DataFrame, check: bool = True) -> DataFrame:
    """segments plus file_key, with the digest of their file's bytes as audio_sha256.

    files (audio, file_key, sha256) has one row a path; file_key names the file itself, so two paths to one file
    share it.  A declared digest that differs from the bytes is an error, as is a path without a file.
    """
    known = files.select(F.col("audio"), F.col("file_key"), F.lower("sha256").alias("__sha"))
    joined = segments.drop("file_key").join(known, "audio", "left")
    if check:
        require_empty(known.groupBy("audio").count().where("count > 1"), "repeated paths", "audio")
        require_empty(joined.where("__sha is null"), "missing audio files", "audio")
        wrong = F.col("audio_sha256").isNotNull() & (F.lower("audio_sha256") != F.col("__sha"))
        require_empty(joined.where(wrong), "audio_sha256 does not match file bytes")
    return joined.withColumn("audio_sha256", F.coalesce("__sha", F.lower("audio_sha256"))).drop("__sha")


def keyed(segments: DataFrame, kinds: tuple[str, ...] = KINDS, group: str | None = None) -> DataFrame:
    """(kind, mark, key, place, label; group if asked for): segments (manifest, manifest_pos, pos, id, source, text, audio_sha256) by each key.

    One pass over the rows gives all kinds; texts are normalised only if asked for.  mark is a digest of the key, so
    that shuffles carry no texts.  Digests are compared without regard to letter case.
    """
    if not kinds or len(set(kinds)) != len(kinds) or not set(kinds) <= {*KINDS, "file"}:
        raise ValueError("kinds must be a non-empty subset without repeats")
    keys = {
        "id": lambda: F.concat_ws(":", "source", "id"),
        "text": lambda: F.nullif(normalize(F.col("text")), F.lit("")),
        "audio": lambda: F.lower("audio_sha256"),
        "file": lambda: F.col("file_key").cast("string"),
    }
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), keys[kind]().alias("key")) for kind in kinds))
    own = [] if group is None else [F.col(group).alias("group")]
    rows = segments.select(*own, F.explode(pairs).alias("k"), F.struct("manifest_pos", "pos").alias("place"), F.concat_ws(":", "manifest", "id").alias("label"))
    return rows.where("k.key is not null").select(*(["group"] if own else []), "k.kind", F.sha2("k.key", 256).alias("mark"), "k.key", "place", "label")


class KeyIndex:
    """Segments by key, stored once: whatever audits use them, a row's text is normalised one time.

    An index of several groups, say the slices of a report, keeps the group of each row.
    """

    def __init__(self, segments: DataFrame, kinds: tuple[str, ...] = KINDS, group: str | None = None):
        self.kinds, self.group = kinds, group
        self.rows = store(keyed(segments, kinds, group), "keys")

    def of(self, value: object) -> KeyIndex:
        """The index of one group."""
        one = object.__new__(KeyIndex)
        one.kinds, one.group, one.rows = self.kinds, None, self.rows.where(F.col("group").eqNullSafe(F.lit(value))).drop("group")
        return one


def indexed(segments: DataFrame | KeyIndex, kinds: tuple[str, ...]) -> KeyIndex:
    """An index of the kinds; one that was made before must hold them."""
    if not isinstance(segments, KeyIndex):
        return KeyIndex(segments, kinds)
    if set(segments.kinds) != set(kinds):
        raise ValueError(f"the index holds {segments.kinds}, not {kinds}")
    return segments


def shared_keys(train: DataFrame | KeyIndex, evaluation: DataFrame | KeyIndex, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, mark) of the keys that both sides have: flags with map-side combine, so a hot key is one row a task."""
    sides = [indexed(df, kinds).rows.select("kind", "mark", F.lit(own).alias("own")) for df, own in ((train, 1), (evaluation, 2))]
    flags = sides[0].unionByName(sides[1]).groupBy("kind", "mark").agg(F.bit_or("own").alias("sides"))
    return flags.where("sides = 3").select("kind", "mark")


def overlap_rows(train: DataFrame | KeyIndex, evaluation: DataFrame | KeyIndex, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, key, side, place, label): each segment that shares a key with the other side, a row of its own."""
    train, evaluation = indexed(train, kinds), indexed(evaluation, kinds)
    both = train.rows.withColumn("side", F.lit("train")).unionByName(evaluation.rows.withColumn("side", F.lit("eval")))
    return both.join(shared_keys(train, evaluation, kinds), ["kind", "mark"], "left_semi").drop("mark")


def overlaps(train: DataFrame, evaluation: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, key, train_segments, eval_segments) of each key on both sides, labels in manifest and segment order.

    A key's segments are one row here; where a key may have more than a row should hold, use overlap_rows.
    """
    listed = lambda side: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("place", "label")))), lambda x: x.label
    )
    rank = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    found = overlap_rows(train, evaluation, kinds).groupBy("kind", "key")
    return found.agg(listed("train").alias("train_segments"), listed("eval").alias("eval_segments")).orderBy(rank[F.col("kind")], "key")


def coverage(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row: hashed and total segments of each side, and their pooled ratio."""
    one = [df.agg(F.count("audio_sha256").alias(f"{n}_hashed"), F.count("*").alias(f"{n}_total")) for n, df in (("train", train), ("eval", evaluation))]
    total = F.col("train_total") + F.col("eval_total")
    return one[0].crossJoin(one[1]).withColumn("coverage", F.when(total > 0, (F.col("train_hashed") + F.col("eval_hashed")) / total))


def verdict(
    train: DataFrame,
    evaluation: DataFrame,
    kinds: tuple[str, ...] = KINDS,
    reviewed: DataFrame | None = None,
    keys: tuple[KeyIndex, KeyIndex] | None = None,
) -> DataFrame:
    """One row: counts by kind, coverage and the state INCOMPLETE, CLEAN, REVIEWED or OVERLAP, in this precedence.

    reviewed (key, reason) approves an audit whose overlaps are of kind text only and whose set of keys is that of
    the reviews.  keys: indexes of both sides, if they are there already.
    """
    shared = shared_keys(*(keys or (train, evaluation)), kinds)
    if reviewed is not None:
        shared = store(shared, "shared")
    counts = shared.groupBy().agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_overlaps") for k in ("file", *KINDS)))
    row = counts.crossJoin(coverage(train, evaluation))
    complete = F.lit(set(KINDS) <= set(kinds)) & (F.col("train_total") > 0) & (F.col("eval_total") > 0) & (F.col("coverage") == 1)
    hard = F.col("file_overlaps") + F.col("id_overlaps") + F.col("audio_overlaps")
    approved = F.lit(False)
    if reviewed is not None:
        found = shared.where("kind = 'text'").select("mark")
        given = reviewed.select(F.sha2("key", 256).alias("mark"))
        differing = found.exceptAll(given.distinct()).unionByName(given.distinct().exceptAll(found)).agg(F.count("*").alias("unmatched"))
        row = row.crossJoin(differing)
        approved = (hard == 0) & (F.col("unmatched") == 0)
    state = (
        F.when(~complete, "INCOMPLETE").when(hard + F.col("text_overlaps") == 0, "CLEAN").when(approved, "REVIEWED").otherwise("OVERLAP")
    )
    return row.withColumn("state", state).drop("unmatched")


def require_no_leakage(train: DataFrame, evaluation: DataFrame, kinds: tuple[str, ...] = KINDS, reviewed: DataFrame | None = None) -> DataFrame:
    """The verdict of an audit that training may rely on; anything else is a ValueError.

    Training manifests must be of split train, the evaluation of dev or test; no key but texts may be shared, all
    digests must be known, and each shared text needs a review with a reason, none of them stale.
    """
    for df, splits, told in ((train, ("train",), "training audit requires train manifests"), (evaluation, ("dev", "test"), "evaluation audit requires dev or test manifests")):
        if "split" in df.columns:
            require_empty(df.where(~F.col("split").isin(*splits)), told, "manifest")
    if reviewed is not None:
        require_empty(reviewed.where("reason is null or trim(reason) = ''"), "reviews without a reason", "key")
    names = train.groupBy("manifest").agg(F.count_distinct("manifest_pos").alias("n"))
    require_empty(names.where("n > 1"), "several training manifests of one name", "manifest")
    keys = (KeyIndex(train, kinds), KeyIndex(evaluation, kinds))
    found = verdict(train, evaluation, kinds, reviewed, keys)
    row = found.first()
    if row["state"] == "INCOMPLETE":
        raise ValueError(f"incomplete audit: {row['train_hashed']}/{row['train_total']} and {row['eval_hashed']}/{row['eval_total']} digests known")
    if row["state"] == "OVERLAP":
        names = first_values(overlap_rows(*keys, kinds), "key")
        raise ValueError(f"train and evaluation overlap: {names}")
    if row["state"] == "CLEAN" and reviewed is not None and reviewed.limit(1).count():
        raise ValueError("stale review decisions")
    return found
