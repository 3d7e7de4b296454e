"""The stream of Python's seeded generator in blocks: its words by numpy, its choices by rejection.

random.Random(seed) draws a number below n from the top bits of 32-bit words and draws again while it is n or more.
numpy has the same Mersenne twister, so words come in blocks, and a state can be handed to another task, which goes on
from there.
"""

from __future__ import annotations

import math
import random
from array import array
from collections.abc import Iterator

import numpy as np

BITS = 32
#: Words that are made at a time.
BLOCK = 1 << 20


class Words:
    """The generator's 32-bit words from a seed, or from a state that mark gave."""

    def __init__(self, seed: int | None = None, state: bytes | None = None):
        self.twister = np.random.MT19937()
        if state is None:
            told = random.Random(seed).getstate()[1]
            key, at = np.array(told[:-1], np.uint32), told[-1]
        else:
            held = np.frombuffer(state, np.uint32)
            key, at = held[:-1].copy(), int(held[-1])
        self.twister.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": at}}

    def mark(self) -> bytes:
        told = self.twister.state["state"]
        return np.append(told["key"], np.uint32(told["pos"])).astype(np.uint32).tobytes()

    def take(self, count: int) -> np.ndarray:
        return self.twister.random_raw(count).astype(np.int64)


def _bits(n: int) -> int:
    if not 0 < n < 1 << BITS:
        raise ValueError("choices are made of 1 to 2**32 - 1 things")
    return n.bit_length()


def choices(words: Words, n: int, count: int) -> Iterator[np.ndarray]:
    """The next count numbers below n, in blocks; words behind the last one are left untouched."""
    shift = BITS - _bits(n)
    while count:
        before = words.mark()
        block = words.take(min(BLOCK, max(64, count + count // 2)))
        good = np.flatnonzero(block >> shift < n)
        if len(good) >= count:
            good = good[:count]
            words.__init__(state=before)
            words.take(int(good[-1]) + 1)
        yield block[good] >> shift
        count -= len(good)


def rows_of_choices(words: Words, n: int, rows: int) -> Iterator[np.ndarray]:
    """The next rows of n choices each, as arrays of some rows; a row of more than BLOCK choices comes alone."""
    step = max(1, BLOCK // n)
    for at in range(0, rows, step):
        own = min(step, rows - at)
        yield np.concatenate(list(choices(words, n, own * n))).reshape(own, n)


def marks(seed: int, n: int, rows: int, step: int) -> Iterator[tuple[int, int, bytes]]:
    """(first row, rows, state) of stretches of `step` rows of n choices each: who has a state can draw its rows alone."""
    words = Words(seed)
    for first in range(0, rows, step):
        own = min(step, rows - first)
        yield first, own, words.mark()
        for _ in choices(words, n, own * n) if first + own < rows else ():
            pass


def _first_distinct(words: Words, n: int, k: int) -> np.ndarray:
    """A flag for each of n numbers: whether it is among the first k distinct ones of the stream."""
    seen, left = np.zeros(n, bool), k
    shift = BITS - _bits(n)
    while left:
        block = words.take(min(BLOCK, max(64, 2 * left))) >> shift
        block = block[block < n]
        fresh, at = np.unique(block[~seen[block]], return_index=True)
        if len(fresh) > left:
            fresh = fresh[np.argpartition(at, left - 1)[:left]]
        seen[fresh] = True
        left -= len(fresh)
    return seen


def _shrinking(words: Words, n: int, k: int) -> Iterator[np.ndarray]:
    """Numbers below n, then below n - 1, and so on, k of them, in blocks.

    Whether a word is taken depends on how many were before it only if it lies between the bounds that a block may
    reach; those few are looked at one by one.
    """
    made = 0
    while made < k:
        bound = n - made
        shift = BITS - _bits(bound)
        # while the bound keeps its length in bits
        most = min(k - made, bound - (1 << bound.bit_length() - 1) + 1, BLOCK)
        before = words.mark()
        block = words.take(most) >> shift
        taken = block < bound - most
        for at in np.flatnonzero((block < bound) & ~taken).tolist():
            taken[at] = block[at] < bound - int(np.count_nonzero(taken[:at]))
        good = np.flatnonzero(taken)
        yield block[good]
        made += len(good)
        words.__init__(state=before)
        words.take(most)


def sample_flags(seed: int, n: int, k: int) -> np.ndarray:
    """A flag for each place below n: whether random.Random(seed).sample(range(n), k) holds it.

    As there, few of many are the first distinct numbers of the stream; otherwise each draw takes a place out of a pool
    that shrinks.  Memory is a byte a place in the first case and four more in the second, where n is at most 12 k.
    """
    if not 0 <= k <= n:
        raise ValueError("a sample is at most as large as what it is taken from")
    words, flags = Words(seed), np.zeros(n, bool)
    pool_size = 21 + (4 ** math.ceil(math.log(k * 3, 4)) if k > 5 else 0)  # fixed values of the library's choice
    if n > pool_size:
        return _first_distinct(words, n, k) if k else flags
    pool, last = array("L", range(n)), n
    for block in _shrinking(words, n, k):
        for j in block.tolist():
            last -= 1
            flags[pool[j]] = True
            pool[j] = pool[last]
    return flags
