"""Stupid-backoff language-model scores from count tables partitioned by hash (operator 10)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.exact import chained
from quillspark.llm.mixing import word_count
from quillspark.llm.storage import table

ORDER = 3
ALPHA = 0.4
#: Count from which an n-gram of two or more words is seen: more than the occurrence that is scored.
SEEN = 2
#: Words of a batch of documents, and n-grams of a hash bucket on average.
BATCH_WORDS = 2_000_000
BUCKET_KEYS = 2_000_000
#: Rows whose words are hashed at a time, and n-grams whose keys are computed at a time.
ROWS, BLOCK = 1000, 131_072
#: Distinct n-grams of a batch for each of its words, as assumed to size the buckets.
KEYS_PER_WORD = 2


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of an unsigned array, plane by plane, compressed."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _loose(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _chain(seeds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """chained, block by block, so that its intermediate arrays are short."""
    out = np.empty(len(seeds), np.uint64)
    for at in range(0, len(seeds), BLOCK):
        out[at : at + BLOCK] = chained(seeds[at : at + BLOCK], values[at : at + BLOCK])
    return out


class Batch:
    """Documents as word hashes."""

    def __init__(self, ids: list, lengths: np.ndarray, hashes: np.ndarray):
        self.ids, self.lengths, self.hashes = ids, lengths, hashes

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n = 1..order: n, the places (of last words) that have n words of one document, and their keys."""
        starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        depth = np.arange(len(self.hashes), dtype=np.int32) - np.repeat(starts, self.lengths)
        key = self.hashes
        for n in range(1, order + 1):
            if n > 1:
                key = np.concatenate([key[:1], _chain(key[:-1], self.hashes[1:])])
            places = np.flatnonzero(depth >= n - 1)
            # the order is part of the key, so that all orders share the buckets
            yield n, places, _chain(key[places], np.broadcast_to(np.uint64(n), len(places)))


def batches(frames: Iterator[pa.RecordBatch], words: int = BATCH_WORDS) -> Iterator[tuple[int, Batch]]:
    """Numbered batches of (doc_id, text) rows: the task's partition number and a counter."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    ids: list = []
    lengths: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    held = 0
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.slice(at, ROWS)
            texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            keys = np.array([xxhash.xxh64_intdigest(w.encode().lower()) for w in known], np.uint64)
            full = np.array([w != "" for w in known], bool)
            where = coded.indices.to_numpy()
            there = full[where] if len(known) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(there)])
            offsets = lists.offsets.to_numpy()
            edges = ends[offsets - offsets[0]]
            ids += part.column(0).to_pylist()
            lengths.append(np.diff(edges))
            hashes.append(keys[where][there] if len(known) else np.zeros(0, np.uint64))
            held += int(edges[-1])
            if held >= words:
                yield number, Batch(ids, np.concatenate(lengths), np.concatenate(hashes))
                number += 1
                ids, lengths, hashes, held = [], [], [], 0
    if ids:
        yield number, Batch(ids, np.concatenate(lengths), np.concatenate(hashes))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts; sorts keys in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, seen: int = SEEN) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row of docs, trained on all of docs.

    A word's score is count(n-gram) / count(its first n-1 words) for the longest n <= order whose n-gram
    occurs at least `seen` times (any number for a single word, whose divisor is the number of words), times
    alpha for each order left out.  log_score sums natural logarithms.  Words are separated by ASCII white
    space; A-Z is lower-cased.

    Each batch of documents sends its distinct n-gram keys with their counts to hash buckets, the partitions
    of the count table.  A bucket adds up its keys and joins the sums to the batches' keys; each batch sums
    its exploded n-grams by document.  A key reaches a bucket once for each batch, so a very frequent n-gram
    weighs no more than others, and the number of buckets follows the number of words.

    Defined results: null, empty and blank texts have no words, log_score 0 and a null mean; repeated rows are
    scored each, and count each; ids may be null and of any type; an empty table gives an empty one.  Only doc_id and
    text are read.  n-grams are known by 64-bit hashes: where two share one, their counts add up (for 10**9 distinct
    n-grams that is expected of 0.03 pairs).  Batches are numbered by their place in the input, so docs must give the same rows in the same
    partitions when read again, as tables do; a batch that differs from the one counted fails the job.
    """
    rows = docs.select("doc_id", "text")
    total = int(rows.agg(F.sum(word_count(F.col("text")))).first()[0] or 0)
    bits = max(3, math.ceil(math.log2(max(1, KEYS_PER_WORD * total / BUCKET_KEYS))))
    # more partitions than usual where the input asks for them, so that a task's share does not grow with it
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [max(usual, n) for n in (1 << bits, -(-total // BATCH_WORDS))]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    id_kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
        return df.repartition(n, key) if n > usual else df

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in batches(frames):
            for n, _, keys in batch.grams(order):
                keys, counts = _distinct(keys)
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(edges))
                for at in range(0, len(used), 256):
                    spans = [slice(edges[b], edges[b + 1]) for b in used[at : at + 256]]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array(used[at : at + 256].astype(np.int64)),
                            "batch": pa.array([number] * len(spans), pa.int64()),
                            "n": pa.array([n] * len(spans), pa.int32()),
                            "keys": [_squeeze(np.diff(keys[x], prepend=np.uint64(0))) for x in spans],
                            "counts": [_squeeze(counts[x].astype(np.uint32)) for x in spans],
                        }
                    )

    def total_up(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_loose(x, np.uint64), dtype=np.uint64) for x in frame["keys"]]
        counts = np.concatenate([_loose(x, np.uint32) for x in frame["counts"]])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=counts)[inverse].astype(np.uint64)  # exact below 2**53
        edges = np.cumsum([0, *map(len, keys)])
        return pd.DataFrame(
            {
                "batch": frame["batch"],
                "bucket": frame["bucket"],
                "n": frame["n"],
                "mark": [zlib.crc32(k.tobytes()) for k in keys],
                "sums": [_squeeze(sums[a:b]) for a, b in zip(edges, edges[1:], strict=False)],
            }
        )

    def texts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in batches(frames):
            words, at = np.unique(batch.hashes, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([batch.ids], pa.list_(id_kind)),
                    pa.array([_squeeze(batch.lengths.astype(np.uint32))], pa.binary()),
                    pa.array([_squeeze(words)], pa.binary()),
                    pa.array([_squeeze(at.astype(np.uint32))], pa.binary()),
                ],
                ["batch", "ids", "lengths", "words", "at"],
            )

    def sum_up(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = own.iloc[0]
        lengths = _loose(row["lengths"], np.uint32).astype(np.int64)
        batch = Batch(list(row["ids"]), lengths, _loose(row["words"], np.uint64)[_loose(row["at"], np.uint32)])
        answers = answers.sort_values(["n", "bucket"])
        logs = np.zeros(len(batch.hashes))
        before: np.ndarray | None = None  # counts of the n-grams one order lower, by place of the last word
        for n, where, keys in batch.grams(order):
            told = answers[answers["n"] == n]
            sums = np.concatenate([np.zeros(0, np.uint64), *(_loose(x, np.uint64) for x in told["sums"])])
            distinct, inverse = np.unique(keys, return_inverse=True)
            edges = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            marks = [zlib.crc32(distinct[edges[b] : edges[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(edges))]
            if len(sums) != len(distinct) or marks != told["mark"].tolist():
                raise RuntimeError(f"batch {row['batch']} is not the one that was counted; docs must read alike each time")
            counts = np.zeros(len(logs))
            counts[where] = sums[inverse]
            if n == 1:
                logs[where] = np.log(counts[where] / max(1, total))
            else:
                known = counts[where] >= seen
                ratio = counts[where] / before[where - 1]
                logs[where] = np.where(known, np.log(np.where(known, ratio, 1.0)), math.log(alpha) + logs[where])
            before = counts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        by_doc = np.array([math.fsum(logs[a:b]) for a, b in zip(ends, ends[1:], strict=False)])
        return pd.DataFrame({"doc_id": pd.Series(batch.ids, dtype="object"), "n_words": lengths, "log_score": by_doc})

    counted = rows.mapInArrow(count, "bucket long, batch long, n int, keys binary, counts binary")
    answers = dealt(counted, parts[0], "bucket").groupBy("bucket").applyInPandas(total_up, "batch long, bucket long, n int, mark long, sums binary")
    held = rows.mapInArrow(texts, f"batch long, ids array<{id_type}>, lengths binary, words binary, at binary")
    scored = (
        dealt(held, parts[1], "batch")
        .groupBy("batch")
        .cogroup(dealt(answers, parts[1], "batch").groupBy("batch"))
        .applyInPandas(sum_up, f"doc_id {id_type}, n_words long, log_score double")
    )
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, rounded so that other engines give the same figures."""
    found = score(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.round("log_score", 4).alias("log_score"),
        F.round("mean_log_score", 6).alias("mean_log_score"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS w3, unnest(range(len(words))) AS pos FROM d
), g AS (
  SELECT doc_id, pos, w3, lag(w3) OVER v AS w2, lag(w3, 2) OVER v AS w1 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos)
), c1 AS (SELECT w3, count(*) AS n FROM g GROUP BY ALL
), c2 AS (SELECT w2, w3, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL
), c3 AS (SELECT w1, w2, w3, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL
), s AS (
  SELECT g.doc_id,
    CASE WHEN t.n >= 2 THEN ln(t.n / tb.n)
         ELSE CASE WHEN g.w1 IS NOT NULL THEN ln(0.4) ELSE 0 END +
              CASE WHEN b.n >= 2 THEN ln(b.n / bu.n)
                   ELSE CASE WHEN g.w2 IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(u.n / (SELECT count(*) FROM g)) END END AS s
  FROM g JOIN c1 u USING (w3)
  LEFT JOIN c2 b ON b.w2 = g.w2 AND b.w3 = g.w3
  LEFT JOIN c1 bu ON bu.w3 = g.w2
  LEFT JOIN c3 t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3
  LEFT JOIN c2 tb ON tb.w2 = g.w1 AND tb.w3 = g.w2
), r AS (SELECT doc_id, count(*) AS n_words, sum(s) AS log_score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(log_score, 0), 4) AS log_score,
       round(log_score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN r USING (doc_id)
"""
