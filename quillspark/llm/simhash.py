"""SimHash near-duplicates: exact tiled comparison of all distinct fingerprints (operator 8).

Two uses: fingerprints of 64 bits that link within a radius, and, where a Jaccard similarity is asked for, fingerprints
of 256 bits of the sets of shingles, whose close pairs are then held against the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components, local_roots
from quillspark.llm.shingles import set_print, shingle_set, verified_links
from quillspark.llm.storage import store, table

SEED = 42
#: Bits of the three sections of a fingerprint whose population counts order the tiles.
SECTIONS = ((0, 21), (21, 21), (42, 22))
#: Distinct fingerprints that meet in one task: two groups of this many at most, and this many groups at least.
GROUP, LEAST_GROUPS = 131_072, 6
#: Of 256 bits, sets of Jaccard similarity 0.8 differ in 39 on average (standard deviation 6; 48 for the smallest
#: sets), others in 128 (8): the radius of a candidate, and that of its first 64 bits.
WIDE_RADIUS, FIRST_RADIUS = 68, 25
#: Ratio between the sizes of neighbouring cells of sets.
SIZE_STEP = 1.05
#: Most pairs that one numpy block compares.
BLOCK = 2_000_000
HASHES = 65_536


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and space with \t\n\v\f\r
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), HASHES):
        digests = b"".join([xxhash.xxh64_digest(x, SEED) for x in parts[at : at + HASHES]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of every row; a row-local pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x, shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def _cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the fingerprints by their sections' population counts, and the code of those counts."""
    code = np.zeros(len(prints), np.int64)
    for shift, width in SECTIONS:
        part = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        code = code * 32 + np.bitwise_count(part)
    order = np.argsort(code, kind="stable")
    return order, code[order]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two uint64 arrays that differ in at most radius bits, all of them.

    Tiles are runs of equal section population counts.  Two fingerprints differ in at least the summed
    differences of these counts, so pairs of tiles beyond the radius are skipped without a comparison.
    """
    order_a, code_a = _cells(left)
    order_b, code_b = _cells(right)
    a, b = left[order_a], right[order_b]
    tiles, starts = np.unique(code_a, return_index=True)
    ends = np.append(starts[1:], len(a))
    p0, p1, p2 = tiles >> 10, tiles >> 5 & 31, tiles & 31
    for d0 in range(-radius, radius + 1):
        for d1 in range(abs(d0) - radius, radius - abs(d0) + 1):
            spare = radius - abs(d0) - abs(d1)
            base = ((p0 + d0) << 10) + ((p1 + d1) << 5)
            low = np.searchsorted(code_b, base + np.maximum(p2 - spare, 0), "left")
            high = np.searchsorted(code_b, base + np.minimum(p2 + spare, 31), "right")
            valid = (p0 + d0 >= 0) & (p0 + d0 < 32) & (p1 + d1 >= 0) & (p1 + d1 < 32) & (high > low)
            for t in np.flatnonzero(valid):
                lo, hi = low[t], high[t]
                step = max(1, BLOCK // int(hi - lo))
                for s in range(starts[t], ends[t], step):
                    rows = a[s : min(s + step, ends[t])]
                    for c in range(lo, hi, BLOCK):
                        cols = b[c : min(c + BLOCK, hi)]
                        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius)
                        if len(i):
                            yield order_a[s + i], order_b[c + j]


def close_sets(left: np.ndarray, right: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two arrays (a row for each set: four words of its fingerprint and its size) that may be similar.

    In order of size, a row meets those whose sizes leave room for the similarity; the first word sorts out most.
    """
    order_a, order_b = (np.argsort(x[:, 4], kind="stable") for x in (left, right))
    a, b = left[order_a].view(np.uint64), right[order_b].view(np.uint64)
    sizes_a, sizes_b = left[order_a, 4], right[order_b, 4]
    s = 0
    while s < len(a):
        lo = np.searchsorted(sizes_b, np.ceil(sizes_a[s] * similar - 1e-9), "left")
        e = min(len(a), s + 1024, int(np.searchsorted(sizes_a, sizes_a[s] * SIZE_STEP, "right")))
        hi = np.searchsorted(sizes_b, np.floor(sizes_a[e - 1] / similar + 1e-9), "right")
        step = max(1, BLOCK // max(1, hi - lo))
        for t in range(s, e, step):
            rows = a[t : min(t + step, e)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None, 0] ^ b[None, lo:hi, 0]) <= FIRST_RADIUS)
            far = sum(np.bitwise_count(rows[i, k] ^ b[lo + j, k]).astype(np.int64) for k in range(4))
            good = far <= WIDE_RADIUS
            if good.any():
                yield order_a[t + i[good]], order_b[lo + j[good]]
        s = e


def _forest(found: Iterator[tuple[np.ndarray, np.ndarray]], ids_left: np.ndarray, ids_right: np.ndarray) -> pd.DataFrame:
    """Links found between two groups, as a spanning forest: one edge a linked node at most."""
    ids, at = np.unique(np.concatenate([ids_left, ids_right]), return_inverse=True)
    at_left, at_right = at[: len(ids_left)], at[len(ids_left) :]
    root = np.arange(len(ids))
    held_a: list[np.ndarray] = []
    held_b: list[np.ndarray] = []
    held = 0

    def contract() -> None:
        nonlocal root, held
        if held:
            a, b = root[np.concatenate(held_a)], root[np.concatenate(held_b)]
            root = local_roots(a, b, len(ids))[root]
            held_a.clear()
            held_b.clear()
            held = 0

    for i, j in found:
        held_a.append(at_left[i])
        held_b.append(at_right[j])
        held += len(i)
        if held > BLOCK:
            contract()
    contract()
    linked = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})


def deal(cells: np.ndarray, counts: np.ndarray, most: int) -> list[tuple[np.ndarray, int]]:
    """Groups of cells (points of a small grid): the places of a group's cells, and into how many tiles it falls.

    Cells are halved by weight along their widest side until they hold `most` rows; a single cell of more has tiles.
    """
    out, todo = [], [np.arange(len(cells))]
    while todo:
        here = todo.pop()
        total = int(counts[here].sum())
        side = int(np.ptp(cells[here], axis=0).argmax())
        values = cells[here, side]
        if total <= most or values.min() == values.max():
            out.append((here, max(1, -(-total // most))))
            continue
        order = np.argsort(values, kind="stable")
        weight = np.cumsum(counts[here][order])
        cuts = np.flatnonzero(np.diff(values[order])) + 1
        cut = cuts[np.abs(weight[cuts - 1] - total / 2).argmin()]
        todo += [here[order[cut:]], here[order[:cut]]]
    return out


def link_prints(
    prints: DataFrame,
    words: list[str],
    cell: dict[str, Column],
    near: Callable[[np.ndarray, np.ndarray], bool],
    pairs: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]],
    most: int = GROUP,
) -> DataFrame:
    """prints (rep long and the long columns `words`) -> edges (a, b) that connect reps as all close pairs would.

    cell tells a print's place on a grid of some thousands of cells at most, so only counts of cells reach the driver.
    Cells form groups of at most `most` prints, and only groups whose bounds are near (a function of two arrays:
    least and greatest cell) meet, each two in one task.  A task returns a spanning forest of its links, never all
    pairs of a dense cluster.
    """
    spark = prints.sparkSession
    placed = prints.select("rep", *words, *(c.alias(n) for n, c in cell.items()))
    counted = placed.groupBy(*cell).agg(F.count("*").alias("n")).orderBy(*cell).collect()
    cells = np.array([[r[n] for n in cell] for r in counted], np.int64).reshape(-1, len(cell))
    counts = np.array([r["n"] for r in counted], np.int64)
    rows, groups = [], []
    for own, tiles in deal(cells, counts, max(1, min(most, -(-int(counts.sum()) // LEAST_GROUPS)))) if len(cells) else ():
        rows += [(*map(int, cells[k]), len(groups), tiles) for k in own]
        groups += [np.stack([cells[own].min(axis=0), cells[own].max(axis=0)])] * tiles
    meet = [(g, min(g, o), max(g, o)) for g in range(len(groups)) for o in range(len(groups)) if near(groups[g], groups[o])]
    of_cell = spark.createDataFrame(rows, ", ".join([*(f"`{n}` int" for n in cell), "base int", "tiles int"]))
    meetings = spark.createDataFrame(meet, "g int, i int, j int")
    wide = len(words) + 1

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, part in frame.groupby("g"):
                yield pd.DataFrame({"g": [g], "packed": [part[["rep", *words]].to_numpy(np.int64).tobytes()]})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        def side(own: pd.DataFrame) -> np.ndarray:
            return np.concatenate([np.zeros((0, wide), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, wide) for x in own.packed)])

        i, j = int(frame.i.iloc[0]), int(frame.j.iloc[0])
        left = side(frame[frame.g == i])
        right = left if i == j else side(frame[frame.g == j])
        return _forest(pairs(left[:, 1:], right[:, 1:]), left[:, 0], right[:, 0])

    grouped = placed.join(of_cell, list(cell)).select("rep", *words, (F.col("base") + F.pmod(F.xxhash64("rep"), "tiles")).cast("int").alias("g"))
    dealt = grouped.mapInPandas(pack, "g int, packed binary").join(meetings, "g")
    return dealt.groupBy("i", "j").applyInPandas(compare, "a long, b long")


def link_fingerprints(prints: DataFrame, radius: int = 3, most: int = GROUP) -> DataFrame:
    """prints (fp long, rep long), fp distinct -> edges (a, b) of reps whose prints differ in at most radius bits.

    Cells are the population counts of three sections: groups whose counts differ by more than the radius never meet.
    """
    cell = {f"c{k}": F.bit_count(F.col("fp").bitwiseAND(F.lit(_mask(*x)))) for k, x in enumerate(SECTIONS)}

    def near(one: np.ndarray, two: np.ndarray) -> bool:
        return int(np.maximum(0, np.maximum(one[0] - two[1], two[0] - one[1])).sum()) <= radius

    def pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return close_pairs(left[:, 0].copy().view(np.uint64), right[:, 0].copy().view(np.uint64), radius)

    return link_prints(prints, ["fp"], cell, near, pairs, most)


def _mask(shift: int, width: int) -> int:
    """The bits of a section, as a signed integer."""
    mask = (1 << width) - 1 << shift
    return mask - (1 << 64) if mask >> 63 else mask


def set_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, same binary, f0..f3 long, size long) of every row with an id; `same` is equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = (shingle_set(x, shingle) for x in part.column(1).cast(pa.binary()).to_pylist())
                made = [(xxhash.xxh3_128_digest(x.tobytes()), *set_print(x).tolist(), len(x)) for x in sets]
                arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.binary()] + [pa.int64()] * 5, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "same", "f0", "f1", "f2", "f3", "size"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, same binary, f0 long, f1 long, f2 long, f3 long, size long")


def similar_documents(docs: DataFrame, shingle: int = 5, similar: float = 0.8, most: int = GROUP) -> DataFrame:
    """(doc_id, component_id) of every row of docs that has an id: links are sets of shingles of at least this similarity.

    Wide fingerprints propose groups by the same tiled comparison; in each the sets themselves decide.  A group meets
    those of its size only, as similar sets have similar sizes.

    Defined results: equal sets always link, so blank and null texts are one group; repeated rows give repeated
    results; an id names one document, so texts that share an id may link through it; an empty table gives an empty one.
    """
    prints = store(set_prints(docs, shingle), "set-prints")
    words = ["f0", "f1", "f2", "f3", "size"]
    reps = store(prints.groupBy("same").agg(F.min("id").alias("rep"), *(F.first(w).alias(w) for w in words)), "sets")
    cell = {"c0": F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(SIZE_STEP))).cast("int")}
    room = int(np.ceil(-np.log(similar) / np.log(SIZE_STEP))) + 1

    def near(one: np.ndarray, two: np.ndarray) -> bool:
        return bool(one[0, 0] <= two[1, 0] + room and two[0, 0] <= one[1, 0] + room)

    def pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return close_sets(left, right, similar)

    groups = store(connected_components(link_prints(reps.where("size > 0"), words, cell, near, pairs, most)).withColumnRenamed("node", "id"), "groups")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").join(groups.select("id"), "id", "left_semi")
    roots = store(connected_components(verified_links(texts, groups, shingle, similar)), "roots")
    of_set = reps.join(roots, reps.rep == roots.node, "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_set, "same").select(F.col("id").alias("doc_id"), "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    Defined results: a null or blank text has fingerprint zero and links like any other; equal fingerprints
    always link; repeated rows give repeated results; a null doc_id gets the component of its fingerprint but
    names none (if no row of a component has an id, component_id is null); an empty table gives an empty one.
    Only doc_id and text are read, so other columns may have any name.
    """
    prints = store(fingerprints(docs, shingle), "prints")
    reps = store(prints.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    known = reps.where("rep is not null")
    roots = store(connected_components(link_fingerprints(known, radius)), "roots")
    of_print = reps.join(roots, reps.rep == roots.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(of_print, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group of similar documents.

    Rows without a doc_id stay, as nothing tells which of them another row repeats.  Of repeated rows that
    share the smallest doc_id one stays.
    """
    found = similar_documents(docs, shingle, similar)
    keep = store(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies")), "keep")
    return keep_rows(docs, keep)


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """docs restricted to the ids of keep (doc_id, copies), one row each; rows without an id stay."""
    ids = keep.select(F.col("doc_id").alias("keep_id"))
    rows = docs.select(F.col("doc_id"), F.struct("*").alias("row"))
    kept = rows.join(ids, F.col("doc_id") == F.col("keep_id"), "left_semi")
    if keep.where("copies > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
