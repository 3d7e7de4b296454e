"""The generator's stream against the standard library."""

import random

import numpy as np
import pytest

from quillspark.functions import generator as G
from quillspark.operators import bootstrap as B
from quillspark.operators.manifests import sampled_places


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 1000, 1 << 20])
def test_choices(n):
    rng = random.Random(9)
    want = [rng.choice(range(n)) for _ in range(5000)]
    words = G.Words(9)
    got = [*G.choices(words, n, 1700), *G.choices(words, n, 3300)]
    assert np.concatenate(got).tolist() == want


def test_marks_go_on_where_the_stream_was():
    whole = np.concatenate(list(G.choices(G.Words(4), 13, 13 * 50)))
    for step in (1, 7, 50, 99):
        rows = [np.concatenate(list(G.choices(G.Words(state=s), 13, 13 * own))) for _, own, s in G.marks(4, 13, 50, step)]
        assert np.concatenate(rows).tolist() == whole.tolist()


@pytest.mark.parametrize("n,k", [(0, 0), (1, 0), (1, 1), (5, 5), (21, 4), (22, 4), (85, 6), (86, 6), (1000, 100), (4096, 400), (5000, 5000), (9000, 4500), (200_000, 300), (70_000, 20_000)])
def test_samples(n, k):
    for seed in (0, 7, 2**32 - 1):
        assert np.flatnonzero(G.sample_flags(seed, n, k)).tolist() == sorted(random.Random(seed).sample(range(n), k))


def test_sampled_places(spark):
    for count, fraction in ((0, 0.1), (12_345, 0.1), (40, 0.5)):
        want = sorted(random.Random(3).sample(range(count), round(fraction * count)))
        assert sorted(r["place"] for r in sampled_places(spark, count, fraction, 3).collect()) == want


def test_resamples_in_any_number_of_tasks(spark):
    rng = random.Random(2)
    blocks = [(f"b{k:03d}", rng.randrange(9), rng.randrange(1, 30)) for k in range(37)]
    sums = spark.createDataFrame(blocks, "block_id string, errors long, length long")
    want = [sum(blocks[b][1] for b in d) / sum(blocks[b][2] for b in d) for d in B.draws(37, 120, 5)]
    for a_task in (37, 37 * 50, 10**9):
        got = {r["resample"]: r["rate"] for r in B.resampled(sums, 120, 5, a_task).collect()}
        assert [got[k] for k in range(120)] == want
