import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import distance as D
from quillspark.functions.distance import coded, distance, distances, substituted, waves, whole_distance
from quillspark.functions.text import bengali_fraction, collapse_spaces, normalize, script_counts
from quillspark.operators import bootstrap as B
from quillspark.operators import scoring

CASES = [
    (["আমি ভাত খাই"], ["আমি ভাত খাই"], 0, 0),
    (["আমি ভাত খাই"], ["আমি ডাল খাই"], 1 / 3, 2 / 11),
    (["আমি ভাত খাই আজ"], ["আমি ভাত খাই"], 1 / 4, 3 / 14),
    (["আমি bank এ যাব"], ["আমি bank এ যাব"], 0, 0),
    (["আমি ভাত খাই", "সে ঘরে থাকে"], ["আমি ডাল খাই", "সে ঘরে থাকে"], 1 / 6, 2 / 22),
    (["আমি আজ সকালে ভাত খাই না", "সে থাকে"], ["আমি আজ সকালে ডাল খাই না", "সে যায়"], 2 / 8, None),
]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_bit_vector_distance(a, b):
    assert distance(a, b) == plain(a, b)




@given(st.lists(st.tuples(st.text("abé", max_size=40), st.text("abé", max_size=40)), min_size=1, max_size=8))
def test_waves(pairs):
    sides = coded([a for a, _ in pairs] + [b for _, b in pairs])
    for told, (a, b) in zip(waves(sides[: len(pairs)], sides[len(pairs) :]).tolist(), pairs, strict=True):
        assert told in (plain(a, b), -1) and whole_distance(a, b) == plain(a, b)
    assert distances(*zip(*pairs, strict=True)) == [plain(a, b) for a, b in pairs]


def test_waves_follow_long_matches():
    rng = random.Random(12)
    pairs = []
    for size, edits in ((300, 3), (4000, 40), (30_000, 25), (0, 0)):
        a = [rng.choice("abcdefgh ") for _ in range(size)]
        b = list(a)
        for _ in range(edits):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices("xyz", k=rng.randint(0, 2))
        pairs.append((a, b))
    pairs.append((list("ab") * 2000, list("cd") * 2000))  # too many differences
    want = [whole_distance(a, b) for a, b in pairs]
    texts = coded(["".join(a) for a, _ in pairs] + ["".join(b) for _, b in pairs])
    assert waves(texts[:5], texts[5:]).tolist() == want[:4] + [-1]
    assert distances(*zip(*pairs, strict=True)) == want


def test_distance_of_long_texts():
    rng = random.Random(4)
    for edits in (0, 1, 50, 300, 1500):
        a = [rng.randrange(5) for _ in range(6000)]
        b = list(a)
        for _ in range(edits):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = [rng.randrange(5) for _ in range(rng.randint(0, 2))]
        assert distance(a, b) == whole_distance(a, b)
    assert distance("x" * 5000, "x" * 4000) == 1000 and distance("", "ab") == 2


@pytest.mark.parametrize("long_texts", [False, True])
def test_score_cases(spark, long_texts):
    rows = [(k, r, h) for k, (rs, hs, *_) in enumerate(CASES) for r, h in zip(rs, hs, strict=True)]
    pairs = spark.createDataFrame(rows, "case int, reference string, hypothesis string")
    got = {r["case"]: r for r in scoring.pooled(scoring.pair_counts(pairs, long_texts=long_texts), "case").collect()}
    for k, (_, _, wer, cer) in enumerate(CASES):
        assert got[k]["wer"] == pytest.approx(wer, abs=1e-12)
        if cer is not None:
            assert got[k]["cer"] == pytest.approx(cer, abs=1e-12)


def test_blank_reference_is_an_error(spark):
    with pytest.raises(ValueError, match="blank references"):
        scoring.score(spark.createDataFrame([("?!", "a")], "reference string, hypothesis string"))


def test_join_needs_every_id(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, reference string")
    b = spark.createDataFrame([("1", "x"), ("3", "y")], "id string, hypothesis string")
    with pytest.raises(ValueError, match="without a segment"):
        scoring.join_hypotheses(a, b)
    with pytest.raises(ValueError, match="without a hypothesis"):
        scoring.join_hypotheses(a, b.where("id = '1'"))


def test_normalization(spark):
    cases = [
        ("কি?", "কি"), ("খাই।", "খাই"), ("আমি   ভাত\tখাই", "আমি ভাত খাই"), ("২০২৬ সালে", "2026 সালে"), ("আমি bank এ যাব", "আমি bank এ যাব"),
        ("অামি।", "আমি"), ("৳১০০", "100"), ("৳ ১০০", "100"), ("ভাত,ডাল", "ভাত ডাল"), ("২+২", "2 2"), ("a​b c\x85d", "ab c d"),
    ]
    df = spark.createDataFrame(cases, "x string, y string").withColumn("z", normalize(F.col("x")))
    for r in df.withColumn("again", normalize(F.col("z"))).collect():
        assert r["z"] == r["y"] == r["again"]


def test_spaces_are_pythons(spark):
    texts = ["a\x1cb", " a  b　", "\x85", "a​b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", collapse_spaces(F.col("x")).alias("y"))
    assert all(r["y"] == " ".join(r["x"].split()) for r in df.collect())


def test_script_profile(spark):
    df = spark.createDataFrame([("আমি bank 2026",), ("৳ price",), ("আমি bank",), ("12",)], "x string")
    rows = df.select(*(c.alias(n) for n, c in script_counts(F.col("x")).items()), bengali_fraction(F.col("x")).alias("f")).collect()
    assert [tuple(r)[:4] for r in rows[:2]] == [(3, 4, 4, 0), (0, 5, 0, 1)]
    assert rows[2]["f"] == 3 / 7 and rows[3]["f"] == 1.0


def test_bootstrap_golden(spark):
    counts = spark.createDataFrame([("A", 0, 3), ("A", 0, 3), ("B", 1, 3), ("B", 1, 3)], "block_id string, word_errors long, words long")
    rates = [round(r["rate"] * 6) for r in B.resampled(B.block_sums(counts)).collect()]
    assert Counter(rates) == {0: 243, 1: 513, 2: 244}
    row = B.bootstrap_interval(counts).first()
    assert (row["point"], row["lower"], row["upper"]) == (pytest.approx(1 / 6), 0.0, pytest.approx(1 / 3))


def test_bootstrap_ranks_and_settings():
    assert B.ranks(1000, 0.95) == (26, 975) and B.ranks(200, 0.95) == (6, 195) and B.ranks(100, 0.95) == (3, 98)
    for bad in ((99, 0.95, 0), (100, 1.0, 0), (100, 0.95, -1), (True, 0.95, 0)):
        with pytest.raises(ValueError):
            B.Settings(*bad)
    assert next(B.draws(3, 1, 5)) == [(r := random.Random(5)).choice(range(3)), r.choice(range(3)), r.choice(range(3))]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("\u0985\u09be\u09ae\u09bf।", "\u0986\u09ae\u09bf"),
        ("\u098b\u09c3", "\u09e0"),
        ("\u0989\u09a4\u09cd\u200d\u09b8", "\u0989\u09ce\u09b8"),
        ("\u09a8\u09bf\u09af\u09bc\u09c7", "\u09a8\u09bf\u09df\u09c7"),
        ("\u09ac\u09a1\u09bc", "\u09ac\u09dc"),
        ("\u0995\u09c7\u09be", "\u0995\u09cb"),
        ("\u09af\u09c1\u09c1\u09a6\u09cd\u09cd\u09a7", "\u09af\u09c1\u09a6\u09cd\u09a7"),
        ("৳১০০", "100"),
        ("২+২", "2 2"),
    ],
)
def test_bengali_repairs(spark, given, expected):
    df = spark.createDataFrame([(given,), (expected,)], "t string").select(normalize(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [expected] * 2


def test_places_that_differ_tell_the_distance():
    assert substituted("the cat", "\x01\x01\x01 cat") == 3 and substituted(["the", "a"], ["x", "a"]) == 1 and substituted("a", "bc") == -1
    assert substituted("abab", "baba") == -1  # two edits, four places
    rng = random.Random(5)
    for _ in range(500):
        a, b = (rng.choices("abcd", k=5) for _ in range(2))
        assert substituted(a, b) in (plain(a, b), -1) and substituted("".join(a), "".join(b)) == substituted(a, b)


@pytest.mark.parametrize("split", [False, True])
def test_a_batch_is_taken_apart_in_bounded_parts(split, monkeypatch):
    """Memory follows the parts, not the batch: of 400 pairs of 4 kB none stand in more than ten of Python's texts at once."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "bb", "ccc"], k=1500)) for _ in range(20)]
    pairs = [(t, t.replace("a bb", "bb", 3)) for t in texts] * 20 + [(None, "x"), ("x", None), ("", "a")]
    most, given = [], D.distances
    monkeypatch.setattr(D, "APART", 40_000)
    monkeypatch.setattr(D, "distances", lambda a, b: most.append(len(a)) or given(a, b))
    found = D._of_pairs(*(pa.array(list(x), pa.string()) for x in zip(*pairs, strict=True)), split).to_pylist()
    assert max(most) <= 10 and found[-3:] == [None, None, 1]
    assert found[:20] == found[380:400] == given(*zip(*([x.split() for x in p] if split else p for p in pairs[:20]), strict=True))
