"""Block bootstrap of a pooled error rate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.generator import Words, marks, rows_of_choices
from quillspark.storage import store


@dataclass(frozen=True)
class Settings:
    """How a bootstrap draws: each field's type and range stand beside it."""

    resamples: int = 1000
    confidence: float = 0.95
    seed: int = 0

    RANGES: ClassVar = {
        "resamples": (int, lambda x: x >= 100, "a whole number of at least 100"),
        "confidence": (float, lambda x: 0 < x < 1, "a number between 0 and 1"),
        "seed": (int, lambda x: 0 <= x < 2**32, "a whole number below 2**32"),
    }

    def __post_init__(self) -> None:
        wrong = [f"{name} must be {told}" for name, (kind, fits, told) in self.RANGES.items() if type(getattr(self, name)) is not kind or not fits(getattr(self, name))]
        if wrong:
            raise ValueError("; ".join(wrong))


def nearest_rank(share: float, count: int) -> int:
    """1-based rank of a quantile among count ordered values, with the floating-point behaviour of share * count."""
    return min(count, max(1, math.ceil(share * count)))


def ranks(resamples: int, confidence: float) -> tuple[int, int]:
    tail = (1 - confidence) / 2
    return nearest_rank(tail, resamples), nearest_rank(1 - tail, resamples)


def draws(blocks: int, resamples: int, seed: int):
    """For each resample the block numbers drawn, from one seeded generator."""
    for rows in rows_of_choices(Words(seed), blocks, resamples):
        yield from rows.tolist()


def block_sums(counts: DataFrame, block: str = "block_id", errors: str = "word_errors", lengths: str = "words") -> DataFrame:
    """One row a block: the sufficient statistics of the pooled rate."""
    return counts.groupBy(F.col(block).alias("block_id")).agg(F.sum(errors).alias("errors"), F.sum(lengths).alias("length"))


#: Draws that a task makes.
DRAWS = 50_000_000


def resampled(sums: DataFrame, resamples: int = 1000, seed: int = 0, draws_a_task: int = DRAWS) -> DataFrame:
    """(resample, rate): the pooled rate of each draw of as many blocks as there are, with replacement.

    The rate is a ratio of sums, so only block sums are drawn, never segments.  The seeded generator is one
    sequence, and its draws must be those of any other user of the seed.  One task runs through its words, which is
    the fast part, and writes its state down for every stretch of resamples; each stretch is drawn and summed by a
    task of its own, which holds the sums of all blocks, 16 bytes a block.
    """

    def stretches(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame.sort_values("block_id", kind="stable")
        if len(frame) < 2:
            raise ValueError("a block bootstrap needs two blocks at least")
        held = [frame[c].to_numpy().astype(np.int64).tobytes() for c in ("errors", "length")]
        step = max(1, draws_a_task // len(frame))
        for first, own, state in marks(seed, len(frame), resamples, step):
            yield pd.DataFrame([(first, own, state, *held)], columns=["first", "own", "state", "errors", "length"])

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from stretches(pd.concat(list(frames)))

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, own, state, *held in frame.itertuples(index=False):
                errors, length = (np.frombuffer(x, np.int64) for x in held)
                at = first
                for rows in rows_of_choices(Words(state=state), len(errors), own):
                    rates = errors[rows].sum(axis=1) / length[rows].sum(axis=1)
                    yield pd.DataFrame({"resample": np.arange(at, at + len(rows)), "rate": rates})
                    at += len(rows)

    one = sums.select("block_id", "errors", "length").coalesce(1)
    parts = one.mapInPandas(packed, "first int, own int, state binary, errors binary, length binary")
    return parts.repartition("first").mapInPandas(drawn, "resample int, rate double")


def bootstrap_interval(counts: DataFrame, block: str = "block_id", errors: str = "word_errors", lengths: str = "words", resamples: int = 1000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (point, lower, upper, blocks, resamples)."""
    Settings(resamples, float(confidence), seed)
    # used twice; one row a block
    sums = store(block_sums(counts, block, errors, lengths), "sums")
    low, high = ranks(resamples, confidence)
    ordered = F.sort_array(F.collect_list("rate"))
    limits = resampled(sums, resamples, seed).agg(F.element_at(ordered, low).alias("lower"), F.element_at(ordered, high).alias("upper"))
    point = sums.agg((F.sum("errors") / F.sum("length")).alias("point"), F.count("*").alias("blocks"))
    return point.crossJoin(limits).withColumn("resamples", F.lit(resamples))  # one row each
