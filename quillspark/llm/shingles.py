"""Sets of word shingles: their fingerprints and exact Jaccard similarity (for operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILAR = 0.8
#: Sets of one proposed group that meet in one task: two tiles of this many.
TILE = 2048
#: Shingles that one numpy block hashes, at most 65535.
BLOCK = 4096
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 2**63, 4).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, 4).astype(np.uint64)
WEIGHTS = _RNG.integers(0, 2**63, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles; a shorter text is one shingle, a blank one has none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and space with \t\n\v\f\r
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    size = min(shingle, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out + h[k : len(h) - size + 1 + k] * WEIGHTS[k])
    return np.unique(out)


def set_print(hashes: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a set of shingles, as four signed words: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK, None]
        bits = np.unpackbits(_mixed(part * FACTORS + SHIFTS).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def set_links(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Index pairs that connect the sets as all pairs of at least this Jaccard similarity would.

    A breadth-first search: what is reached is compared with what is not, so a dense group takes one pass.
    """
    sizes = np.array([len(x) for x in sets])
    known, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    free = np.ones(len(sets), bool)
    mark = np.zeros(len(known), bool)
    out: list[tuple[int, int]] = []
    rest_tokens, rest_owner, stale = tokens, owner, 0
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        for at in queue:
            if not free.any():
                return out
            own = tokens[starts[at] : starts[at] + sizes[at]]
            mark[own] = True
            shared = np.bincount(rest_owner[mark[rest_tokens]], minlength=len(sets))
            mark[own] = False
            hit = np.flatnonzero(free & (shared >= similar * (sizes + sizes[at] - shared) - 1e-9))
            free[hit] = False
            out += [(int(k), at) for k in hit]
            queue += hit.tolist()
            stale += len(hit) + 1
            if stale * 4 > len(sets):
                held = free[rest_owner]
                rest_tokens, rest_owner, stale = rest_tokens[held], rest_owner[held], 0
    return out


def verified_links(sets: DataFrame, groups: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, tile: int | None = None) -> DataFrame:
    """sets (id, text), groups (id, component) -> edges (a, b) that connect ids as all similar pairs of a group would.

    Groups of at most `tile` sets share tasks.  The sets of a larger one fall into tiles by hash and each two
    tiles meet in a task, so no task holds a whole group; a task returns a forest, never all pairs.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                packed = [shingle_set(x, shingle).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()]
                arrays = [part.column(0), pa.array(packed, pa.binary()), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "packed", "component", "tiles"])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in frame.groupby("component"):
            ids = part.id.to_numpy()
            out += [(ids[a], ids[b]) for a, b in set_links([np.frombuffer(x, np.uint64) for x in part.packed], similar)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    tile = tile or TILE
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles"))
    total = groups.count()
    bins = max(1, -(-total // tile))
    members = groups.join(sizes, "component").select("id", "component", "tiles")
    rows = sets.join(members, "id").select("id", "text", "component", "tiles")
    rows = rows.mapInArrow(hashed, "id long, packed binary, component long, tiles long")
    own = F.pmod(F.xxhash64("id"), "tiles")
    other = F.expr("explode(if(tiles = 1, array(0L), filter(sequence(0L, tiles - 1), o -> o <> pmod(xxhash64(id), tiles))))")
    dealt = rows.select("id", "packed", "component", "tiles", own.alias("own"), other.alias("o")).select(
        "id", "packed", "component", (F.col("tiles") > 1).alias("large"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")
    )
    key = F.when(F.col("large"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins)))
    return dealt.withColumn("g", key).groupBy("large", "g", "i", "j").applyInPandas(compare, "a long, b long")
