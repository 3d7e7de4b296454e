"""Edit distances of words and characters."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Hashable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.functions.text import collapse_spaces

#: Distinct words of a pair that fit the characters which stand for them.
MOST_WORDS = 0xD7FF - 0x0100


def char_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(left, right).cast("long")


def words(text: Column) -> Column:
    clean = collapse_spaces(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def word_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance in words: each distinct word of a pair becomes one character, then built-in levenshtein.

    For pairs of short texts; beyond MOST_WORDS distinct words it raises and long_word_distance is the one to use.
    """
    a, b = words(left), words(right)
    known = F.array_distinct(F.concat(a, b))
    coded = [
        F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFF), 4, "0")), "")), "UTF-16BE")
        for x in (a, b)
    ]
    fits = F.size(known) <= MOST_WORDS
    return F.when(fits, F.levenshtein(*coded)).otherwise(F.raise_error(F.lit("too many distinct words"))).cast("long")


def whole_distance(left: Sequence[Hashable], right: Sequence[Hashable]) -> int:
    """Levenshtein distance by bit vectors over whole columns of the table, as integers of any length."""
    if not left or not right:
        return len(left) + len(right)
    places: dict[Hashable, int] = {}
    for k, x in enumerate(left):
        places[x] = places.get(x, 0) | 1 << k
    full, top = (1 << len(left)) - 1, 1 << len(left) - 1
    up, down, score = full, 0, len(left)
    for x in right:
        match = places.get(x, 0)
        cross = (((match & up) + up) ^ up) | match
        plus = down | ~(cross | up) & full
        minus = up & cross
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        down_next = plus & (match | down)
        up = (minus | ~((match | down) | plus)) & full
        down = down_next
    return score


#: Symbols that are compared at a time along a diagonal, diagonals of which that is done at once, symbols of the pairs
#: that are taken together, and bytes of a batch's texts that are taken apart at once.
STRIDE, LIVE, TOGETHER, APART = 32, 65_536, 1_000_000, 2_000_000
#: Nanoseconds that a diagonal of a wave, a column of bit vectors and a row of such a column take, about.
DIAGONAL_NS, COLUMN_NS, ROW_NS = 80, 2_500, 0.1


def _joined(arrays: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one behind the other, each closed by STRIDE ends, and where each begins."""
    sizes = np.array([len(x) + STRIDE for x in arrays])
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), end, np.uint32)
    for x, at in zip(arrays, starts.tolist(), strict=True):
        out[at : at + len(x)] = x
    return out, starts


def waves(lefts: list[np.ndarray], rights: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distances of pairs of arrays of symbols by furthest points; -1 for a pair for which bit vectors would be
    faster.

    After e edits each diagonal of a pair holds the furthest row that it reaches.  The diagonals of all pairs that are
    not at their end advance together, those that match by STRIDE symbols at a time, so a pair takes time that grows
    with its length and the square of its distance.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (lefts, rights))
    a, a_at = _joined(lefts, 0xFFFFFFFF)
    b, b_at = _joined(rights, 0xFFFFFFFE)
    a_strides, b_strides = sliding_window_view(a, STRIDE), sliding_window_view(b, STRIDE)
    least = COLUMN_NS * m + ROW_NS * n * m
    out = np.full(len(n), -1, np.int64)
    pair, spent, edits = np.arange(len(n)), np.zeros(len(n)), 0
    low, size, reached = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    while len(pair):
        begin, every = np.cumsum(size) - size, np.arange(int(size.sum()))
        own = np.repeat(np.arange(len(pair)), size)
        a_row = a_at[pair][own]
        b_row = (b_at[pair] + low - begin)[own] + every
        matching = np.flatnonzero(a[a_row + reached] == b[b_row + reached])
        for begun in range(0, len(matching), LIVE):
            live = matching[begun : begun + LIVE]
            while len(live):
                at = reached[live]
                other = a_strides[a_row[live] + at] != b_strides[b_row[live] + at]
                first = other.argmax(axis=1)
                whole = ~other[np.arange(len(live)), first]
                reached[live] = at + np.where(whole, STRIDE, first)
                live = live[whole]
        goal = (m - n)[pair] - low
        done = (goal >= 0) & (goal < size)
        done[done] = reached[(begin + goal)[done]] >= n[pair[done]]
        out[pair[done]] = edits
        spent += DIAGONAL_NS * size
        going = np.flatnonzero(~done & (spent <= least[pair]))
        # two unreached diagonals stand on both sides of each pair's
        padded = np.full(int(size.sum()) + 4 * len(pair), -1, np.int64)
        lead = begin + 4 * np.arange(len(pair)) + 2
        padded[(lead - begin)[own] + every] = reached
        after = np.maximum(-n[pair], low - 1)
        wide = np.minimum(m[pair], low + size) - after + 1
        own = np.repeat(going, wide[going])
        diagonal = np.arange(len(own)) - np.repeat(np.cumsum(wide[going]) - wide[going], wide[going]) + after[own]
        at = (lead - low)[own] + diagonal
        best = np.maximum(padded[at], padded[at + 1]) + 1
        best[best == 0] = -1
        reached = np.minimum(np.minimum(np.maximum(best, padded[at - 1]), n[pair][own]), m[pair][own] - diagonal)
        pair, spent, low, size, edits = pair[going], spent[going], after[going], wide[going], edits + 1
    return out


def coded(sides: list[Sequence[Hashable]]) -> list[np.ndarray]:
    """Symbols as numbers: code points of texts, else numbers of distinct symbols."""
    numbers: defaultdict[Hashable, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    if all(isinstance(x, str) for x in sides):
        return [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in sides]
    return [np.fromiter(map(numbers.__getitem__, x), np.uint32, len(x)) for x in sides]


def substituted(left: Sequence[Hashable], right: Sequence[Hashable]) -> int:
    """The distance of two sequences of one length of which no symbol at a differing place is also the other's at one, else -1.

    Each of these symbols of the left is one more than the right has, so it takes an edit; substitutions are as many.
    """
    if len(left) != len(right):
        return -1
    if isinstance(left, str) and isinstance(right, str):
        a, b = coded([left, right])
        at = np.flatnonzero(a != b)
        mine, other = a[at].tolist(), b[at].tolist()
    else:
        pairs = [(x, y) for x, y in zip(left, right, strict=True) if x != y]
        mine, other = [x for x, _ in pairs], [y for _, y in pairs]
    return len(mine) if set(mine).isdisjoint(other) else -1


def distances(lefts: Sequence[Sequence[Hashable]], rights: Sequence[Sequence[Hashable]]) -> list[int]:
    """Levenshtein distances of pairs: places that differ where these tell it, else waves of furthest points over pairs of
    TOGETHER symbols at a time, and bit vectors for pairs of many differences."""
    out = [0 if a == b else substituted(a, b) for a, b in zip(lefts, rights, strict=True)]
    unequal = [k for k, told in enumerate(out) if told < 0]
    while unequal:
        taken, size = 0, 0
        while taken < len(unequal) and (not taken or size < TOGETHER):
            size += len(lefts[unequal[taken]]) + len(rights[unequal[taken]])
            taken += 1
        some, unequal = unequal[:taken], unequal[taken:]
        sides = coded([lefts[k] for k in some] + [rights[k] for k in some])
        found = waves(sides[:taken], sides[taken:])
        for at, (k, told) in enumerate(zip(some, found.tolist(), strict=True)):
            out[k] = whole_distance(sides[at].tolist(), sides[taken + at].tolist()) if told < 0 else told
    return out


def distance(left: Sequence[Hashable], right: Sequence[Hashable]) -> int:
    """Levenshtein distance of one pair."""
    return distances([left], [right])[0]


def _of_pairs(left: pa.Array, right: pa.Array, split: bool) -> pa.Array:
    """Distances of a batch's pairs, null where a side is; texts become Python's for pairs of APART bytes at a time, their
    words, too."""
    sizes = pc.add(*(pc.fill_null(pc.binary_length(x), 0).cast(pa.int64()) for x in (left, right)))
    nth = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // APART
    cuts = [0, *(np.flatnonzero(nth[1:] != nth[:-1]) + 1).tolist(), len(nth)]
    out: list[int | None] = []
    for a, b in itertools.pairwise(cuts):
        pairs = [None if x is None or y is None else (x, y) for x, y in zip(*(side[a:b].to_pylist() for side in (left, right)), strict=True)]
        there = [[x.split() for x in p] if split else p for p in pairs if p]
        told = iter(distances([x for x, _ in there], [y for _, y in there]))
        out += [next(told) if p else None for p in pairs]
    return pa.array(out, pa.int64())


@F.arrow_udf(LongType())
def long_char_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """char_distance of texts of any length."""
    return _of_pairs(left, right, split=False)


@F.arrow_udf(LongType())
def long_word_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """word_distance of texts of any length."""
    return _of_pairs(left, right, split=True)
