"""Exact duplicates through a minimal perfect hash over the distinct digests (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.storage import store, table

SPACES = r"[\x20\x09-\x0D]+"
#: Mean number of digests in a shard of the index, and displacement buckets in each.
SHARD = 2048
BUCKETS = 1024

_P1, _P2, _P3, _P4, _P5 = (  # fixed values of XXH64
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def chained(seed: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64(x, value) gives where xxhash64(x) is seed: XXH64 of an 8-byte integer."""
    h = (seed + _P5 + np.uint64(8)) ^ (_rotl(value * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def place(hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement and slot of each key: a bijection from n keys to slots 0..n-1.

    Buckets are placed largest first; each takes the least displacement that sends its keys to free,
    different slots.
    """
    n = len(hashes)
    free = np.ones(n, bool)
    moved, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(buckets, kind="stable")
    _, starts, sizes = np.unique(buckets[order], return_index=True, return_counts=True)
    for k in np.argsort(-sizes, kind="stable"):
        keys = order[starts[k] : starts[k] + sizes[k]]
        at, step = 0, 64
        while True:
            tried = np.arange(at, at + step, dtype=np.uint64)
            slots = chained(hashes[keys][None, :], tried[:, None]).view(np.int64) % n
            good = free[slots].all(axis=1)
            if len(keys) > 1:
                ordered = np.sort(slots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            found = np.flatnonzero(good)
            if len(found):
                moved[keys], slot[keys] = at + found[0], slots[found[0]]
                free[slots[found[0]]] = False
                break
            at, step = at + step, min(step * 4, 16_384)
    return moved, slot


def digest(text: Column) -> Column:
    """SHA-256 in hex of a text whose white-space runs are one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary"), 256)


def _number(sha: Column, at: int) -> Column:
    return F.conv(F.substring(sha, at, 8), 16, 10).cast("long")


def _keyed(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumns(
        {"shard": _number(F.col("sha"), 1) % shards, "bucket": (_number(F.col("sha"), 9) % BUCKETS).cast("int")}
    )


class DigestIndex:
    """Sharded minimal perfect hash of a history: slots (shard, slot) hold the full digest and its winner's locator.

    seen: (doc_id, sha) rows of the history.  The winner is the smallest doc_id of a digest, null if it has
    none.  Shards hold SHARD digests on average, however many there are, as digests are uniform.
    """

    def __init__(self, seen: DataFrame):
        distinct = store(seen.groupBy("sha").agg(F.min("doc_id").alias("winner")), "digests")
        self.shards = max(1, -(-distinct.count() // SHARD))
        id_type = distinct.schema["winner"].dataType.simpleString()

        def build(table: pa.Table) -> pa.Table:
            moved, slot = place(table["h"].to_numpy().view(np.uint64), table["bucket"].to_numpy())
            _, first = np.unique(table["bucket"].to_numpy(), return_index=True)
            lead = np.zeros(len(moved), bool)
            lead[first] = True
            made = {"moved": moved, "slot": slot, "slots": np.full(len(moved), len(moved)), "lead": lead}
            out = table.drop_columns(["h"])
            for name, values in made.items():
                out = out.append_column(name, pa.array(values))
            return out

        keyed = _keyed(distinct.withColumn("h", F.xxhash64("sha")), self.shards).select("sha", "winner", "shard", "bucket", "h")
        schema = f"sha string, winner {id_type}, shard long, bucket int, moved long, slot long, slots long, lead boolean"
        self.slots = store(keyed.groupBy("shard").applyInArrow(build, schema), "slots")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows (with sha) plus shard, slot, winner and member; a slot counts only if its digest is the row's, byte by byte.

        Both joins are equi-joins on uniform keys but for repeats of one digest, whose partition is split
        at run time, as nothing above needs the rows of a key together.  shard and slot are null for others.
        """
        moves = self.slots.where("lead").select("shard", "bucket", "moved", "slots")
        held = self.slots.select("shard", "slot", F.col("sha").alias("slot_sha"), "winner")
        at = _keyed(rows, self.shards).join(moves, ["shard", "bucket"], "left")
        at = at.withColumn("slot", F.pmod(F.xxhash64("sha", "moved"), "slots")).join(held, ["shard", "slot"], "left")
        member = F.coalesce(F.col("slot_sha") == F.col("sha"), F.lit(False))
        own = [F.when(member, F.col(c)).alias(c) for c in ("shard", "slot", "winner")]
        return at.select(*rows.columns, *own, member.alias("member"))


def _dealt() -> Column:
    """Whether a row is of the half that serves as history."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def exact_duplicates(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, seen_before), one row for each row of docs.

    The perfect hash is built of a history's distinct digests and every row of docs is looked up.  Members are the
    group of their slot and kept by its locator; nonmembers are grouped separately, by digest.  With history (doc_id,
    text), members are repeats of it: kept is false, keep_id the slot's winner.  Without, docs are dealt by a hash of
    their id, one half being the history of the whole: keep_id is the smallest id of the slot's winner, which stands for
    that half, and the other half's rows that met it.
    group_size counts rows of docs.

    Defined results: null text is empty; of rows equal in doc_id and text one is kept; a row without doc_id
    is kept only if no row of its group has one, and then one of the group is; a text of any length is digested whole; an
    empty table gives an empty one.  Only doc_id and text are read, so other columns may have any name.
    """
    rows = store(
        docs.select("doc_id", digest(F.col("text")).alias("sha")).groupBy("doc_id", "sha").agg(F.count("*").alias("copies")),
        "rows",
    )
    if history is None:
        seen = rows.where(_dealt())
    else:
        seen = history.select("doc_id", digest(F.col("text")).alias("sha"))
    looked = store(DigestIndex(seen).lookup(rows), "looked")
    # a member's group is its slot, whatever its digest; only nonmembers are grouped by digest
    looked = looked.withColumn("group", F.when(F.col("member"), F.concat_ws("/", "shard", "slot")).otherwise(F.col("sha")))
    others = F.min(F.when(F.lit(history is not None) | ~_dealt(), F.col("doc_id")))
    sized = looked.groupBy("group").agg(others.alias("least"), F.first("winner").alias("of_slot"), F.sum("copies").alias("size"))
    before = F.lit(history is not None) & F.col("member")
    keep = F.when(before, F.col("of_slot")).otherwise(F.least("of_slot", "least"))
    found = looked.drop("winner").join(sized, "group")
    return found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("size").alias("group_size"),
        (~before & F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        before.alias("seen_before"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("seen_before")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns."""
    keep = store(
        exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")),
        "kept",
    )
    marked = docs.select(F.col("doc_id"), digest(F.col("text")).alias("digest"), F.struct("*").alias("row"))
    kept = marked.join(keep, marked.doc_id.eqNullSafe(keep["__id"]) & (marked["digest"] == keep["__sha"]), "left_semi")
    repeats = docs.count() - docs.select("doc_id").distinct().count()
    if repeats:
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("row.*")
