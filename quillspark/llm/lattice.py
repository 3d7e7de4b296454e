"""Embedding near-duplicates by hashing to cells of E8 lattices (operator 7)."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components, local_roots
from quillspark.llm.storage import store, table

#: Factor from unit vectors to lattice units for LENGTH components at cosine ALIKE; it grows with the root of the
#: length, and falls for lower thresholds (see projections and similar_vectors).
SCALE = 4.5
LENGTH, ALIKE = 64, 0.95
#: Neighbouring cells that each vector probes.
PROBES = 4
#: Lattices whose points make a cell, two at least: one more for each factor SPREAD of vectors beyond CROWD in a cell.
LATTICES, CROWD, SPREAD = 2, 50, 200
#: Share of the pairs at the threshold that meet in a table of LATTICES, halved by each further one (simulated), and
#: the share that all tables should find.
THROUGH, FOUND = 0.47, 0.955
#: Vectors of a block that meet in one task; larger blocks are compared tile by tile.
TILE = 1024
#: Leaders that one numpy block looks at.
COLUMNS = 4096
MOST_TABLES = 64
BLOCK = ["leader", "x", "y"]
SEED = 8


def plan(count: int) -> tuple[int, int]:
    """(lattices, tables) for a number of vectors: cells multiply with the vectors, tables keep the share found."""
    lattices = max(LATTICES, math.ceil(math.log(max(1, count / CROWD)) / math.log(SPREAD)))
    return lattices, math.ceil(math.log(1 - FOUND) / math.log(1 - THROUGH / 2 ** (lattices - LATTICES)))


@functools.cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: (±1, ±1, 0...) in any places, (±½)^8 with an even number of minuses."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            whole.append([s if k == i else t if k == j else 0.0 for k in range(8)])
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even coordinate sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(odd))
    near[odd, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is the even integer points and those moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(axis=1, keepdims=True) <= ((x - b) ** 2).sum(axis=1, keepdims=True), a, b)


@functools.lru_cache(16)
def projections(dim: int, lattices: int, tables: int, scale: float = SCALE, seed: int = SEED) -> list[np.ndarray]:
    """For each table a matrix of random orthonormal columns, eight a lattice (of rows if there are fewer), scaled.

    Eight of dim directions hold 8 / dim of a squared distance, so the scale grows with the root of the length: close
    vectors stay as close in lattice units, and cells as many, whatever the length.
    """
    wide = 8 * lattices
    scale *= (max(dim, wide) / LENGTH) ** 0.5
    out = []
    for t in range(tables):
        m = np.random.default_rng([seed, dim, t]).normal(size=(max(dim, wide), wide))
        out.append(np.linalg.qr(m)[0][:dim] * scale)
    return out


def _cell_key(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of lattice points."""
    key = np.full(points.shape[:-1], salt, np.uint64)
    for k in range(points.shape[-1]):
        part = (2 * points[..., k]).astype(np.int64).view(np.uint64)
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lattice_keys(units: np.ndarray, matrix: np.ndarray, probes: int, salt: int) -> np.ndarray:
    """Keys of the cell that holds each unit vector, then of the neighbouring cells that it probes.

    A cell is a point of each lattice; the neighbours are those a shortest vector of one lattice away whose points
    are nearest.  Sums run component by component, so that a vector has the same cells in whatever company.
    """
    wide = matrix.shape[1]
    at = np.zeros((len(units), wide))
    for k in range(units.shape[1]):
        at += units[:, k, None] * matrix[k]
    steps = shortest()
    own = np.hstack([decode(at[:, k : k + 8]) for k in range(0, wide, 8)])
    off = at - own
    gain = np.zeros((len(units), wide // 8, len(steps)))
    for k in range(wide):
        gain[:, k // 8] += off[:, k, None] * steps[:, k % 8]
    best = np.argpartition(-gain.reshape(len(units), -1), probes, axis=1)[:, :probes]
    cells = np.repeat(own[:, None, :], probes + 1, axis=1).reshape(len(units), probes + 1, -1, 8)
    rows = np.arange(len(units))
    for p in range(probes):
        cells[rows, p + 1, best[:, p] // len(steps)] += steps[best[:, p] % len(steps)]
    return _cell_key(cells.reshape(len(units), probes + 1, wide), salt)


def _cells(reps: DataFrame, lattices: int, tables: int, scale: float, probes: int) -> DataFrame:
    """(cell, rep, own): a row for the cell of each table that holds a vector, and for those it probes; ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, vectors = part.column(0).to_numpy(), part.column(1).to_pylist()
                lengths = np.array([len(v) for v in vectors])
                for dim in np.unique(lengths):
                    here = np.flatnonzero(lengths == dim)
                    units = unit_rows([vectors[k] for k in here])
                    keys = [lattice_keys(units, m, probes, int(dim) * MOST_TABLES + t) for t, m in enumerate(projections(int(dim), lattices, tables, scale))]
                    cells = np.stack(keys, axis=1)
                    own = np.broadcast_to(np.arange(probes + 1) == 0, cells.shape)
                    columns = [cells.ravel(), np.repeat(ids[here], cells[0].size), own.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "rep", "own"])

    return reps.select("rep", "embedding").mapInArrow(run, "cell long, rep long, own boolean")


class Rows:
    """Vectors in blocks as arrays: unit rows, ids, copies, tiles, and each one's leaders (flat, with edges)."""

    def __init__(self, frame: pd.DataFrame, kind: str):
        raw = np.frombuffer(b"".join(frame.raw), kind).reshape(len(frame), -1)
        self.units = unit_rows(raw)
        self.ids, self.copies, self.tile = (frame[c].to_numpy() for c in ("rep", "copies", "tile"))
        self.edges = np.cumsum([0, *map(len, frame.leaders)])
        self.leaders = np.concatenate([*frame.leaders])

    def met_before(self, leader: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs (i, j) of a block's rows also meet in a block of a smaller leader."""
        out = np.zeros(len(i), bool)
        used = np.flatnonzero(np.bincount(np.concatenate([i, j])))
        parts = [self.leaders[self.edges[k] : self.edges[k + 1]] for k in used]
        names, row = np.concatenate(parts), np.repeat(np.arange(len(used)), [len(x) for x in parts])
        names, row = names[names < leader], row[names < leader]
        known, column, counts = np.unique(names, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(counts > 1)
        if not len(shared):
            return out
        spot = np.zeros(used[-1] + 1, np.int64)
        spot[used] = np.arange(len(used))
        for lo in range(0, len(shared), COLUMNS):
            some = shared[lo : lo + COLUMNS]
            place = np.full(len(known), -1)
            place[some] = np.arange(len(some))
            there = place[column] >= 0
            member = np.zeros((len(used), len(some)), np.float32)
            member[row[there], place[column[there]]] = 1
            out |= (member @ member.T)[spot[i], spot[j]] > 0
        return out

    def links(self, s: int, e: int, leader: int, x: int, y: int, threshold: float) -> tuple[np.ndarray, ...] | None:
        """(a, b, linked) of the block in rows s to e."""
        one = x == y
        here = np.arange(s, e)
        left, right = (here, here) if one else (here[self.tile[s:e] == x], here[self.tile[s:e] == y])
        found_i, found_j = [], []
        for at in range(0, len(left), 512):
            i, j = np.nonzero(self.units[left[at : at + 512]] @ self.units[right].T >= threshold)
            i, j = left[at + i], right[j]
            if one:
                i, j = i[i < j], j[i < j]
            if len(i):
                first = ~self.met_before(leader, i, j)
                found_i.append(i[first] - s)
                found_j.append(j[first] - s)
        if not found_i:
            return None
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        copies = self.copies[s:e]
        linked = np.bincount(i, copies[j], e - s) + np.bincount(j, copies[i], e - s)
        root = local_roots(i, j, e - s)
        some = np.flatnonzero(linked)
        return self.ids[s + some], self.ids[s + root[some]], linked[some].astype(np.int64)


def _compare(threshold: float, kind: str):
    """Function for mapInPandas over rows sorted by block: for each linked vector, what the block adds.

    (a, b, linked): vectors linked with a that it meets in no block of a smaller leader, repeats counted, and the
    vector that stands for a's links in the block, so rows never outnumber the block's.
    """

    def links(blocks: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        lengths = blocks.raw.map(len).to_numpy()
        if (lengths != lengths[0]).any():  # vectors of different lengths never link
            for n in np.unique(lengths):
                part = blocks[lengths == n].reset_index(drop=True)
                yield from links(part, *_blocks(part))
            return
        rows = Rows(blocks, kind)
        key = blocks[BLOCK].to_numpy()
        made = [rows.links(s, e, *key[s].tolist(), threshold) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 1]
        made = [m for m in made if m is not None]
        if made:
            yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(("a", "b", "linked"), zip(*made, strict=True), strict=True)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in itertools.chain(frames, [None]):
            last = frame is None
            frame = rest if last else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if frame is None or not len(frame):
                continue
            starts, ends = _blocks(frame)
            done = len(starts) if last else len(starts) - 1
            if done:
                yield from links(frame.iloc[: ends[done - 1]], starts[:done], ends[:done])
            rest = None if last else frame.iloc[starts[-1] :].reset_index(drop=True)

    return run


def _blocks(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where each block of rows in block order starts and ends."""
    key = frame[BLOCK].to_numpy()
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    return starts, np.append(starts[1:], len(frame))


def similar_vectors(
    vectors: DataFrame, threshold: float = ALIKE, scale: float | None = None, probes: int = PROBES, shape: tuple[int, int] | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding).

    Equal vectors are one class; only class representatives are hashed.  In each table a vector has a cell and
    probes neighbouring ones; those tables of cells hold ids only.  The smallest id that a cell holds leads it, and
    the cells of one leader are one block, so that close vectors, which share many cells, meet in few blocks and are
    sent there once.  Cosines of all that meet are computed in double precision.  A block of more than TILE
    vectors is compared tile by tile, each pair of tiles in a task's turn of its own, so nothing is left out and no
    turn grows.  A pair counts in the block of the smallest leader where it meets, so blocks return a sum and a link
    for each vector, never their pairs.  shape: (lattices of a cell, tables), by the number of vectors if not given.

    Defined results: a vector that is null, empty, zero or holds null or non-finite components, or that has no
    vec_id, has no links and is its own component; vectors of different lengths do not link; repeated rows
    count as other vectors; an empty table gives an empty one.  Only vec_id and embedding are read.
    """
    if scale is None:
        scale = SCALE * min(1.0, ((1 - ALIKE) / max(1e-9, 1 - threshold)) ** 0.5)
    x = F.col("embedding")
    fine = (
        F.col("vec_id").isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(x, lambda v: v != 0)
    )
    # 128 bits stand for a vector where equal ones are brought together
    marks = [F.xxhash64(F.lit(k), x).alias(f"h{k}") for k in (1, 2)]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x, *marks, F.coalesce(fine, F.lit(False)).alias("fine"))
    reps = store(
        rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")),
        "classes",
    )
    lattices, tables = shape or plan(reps.count())
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    cells = store(_cells(reps, lattices, tables, scale, probes), "cells")
    led = cells.where("own").groupBy("cell").agg(F.min("rep").alias("leader"))
    met = store(cells.join(led, "cell").select("leader", "rep").distinct(), "met")
    sizes = met.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.count("*").alias("n")).where("n > 1")
    there = met.join(sizes, "leader").groupBy("rep").agg(F.collect_list(F.struct("leader", "tiles")).alias("blocks"))
    raw = F.udf(lambda v: np.asarray(v, kind).tobytes(), "binary", useArrow=True)
    placed = (
        reps.join(there, "rep")
        .select("rep", "copies", raw("embedding").alias("raw"), F.transform("blocks", lambda b: b.leader).alias("leaders"), F.explode("blocks").alias("at"))
        .withColumn("tile", F.pmod(F.xxhash64("rep"), "at.tiles").cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("at.tiles") - 1)).alias("o")
    blocks = placed.select("rep", "copies", "raw", "leaders", "tile", "at.leader", other)
    blocks = blocks.withColumns({"x": F.least("tile", "o"), "y": F.greatest("tile", "o")}).drop("o")
    found = blocks.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInPandas(_compare(threshold, kind), "a long, b long, linked long")
    links = store(found, "links")
    roots = store(connected_components(links.select("a", "b")), "roots")
    others = links.groupBy("a").agg(F.sum("linked").alias("linked"))
    of_rep = (
        reps.select("h1", "h2", "rep", "copies")
        .join(others, reps.rep == others.a, "left")
        .join(roots, reps.rep == roots.node, "left")
        .select(
            F.col("h1").alias("g1"),
            F.col("h2").alias("g2"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = rows.where("fine").join(of_rep, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all embeddings."""
    return similar_vectors(table(spark, sf_dir, "embeddings"))
