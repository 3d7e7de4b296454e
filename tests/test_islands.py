"""Islands of a recording against the sweep over all of it."""

import random

from pyspark.sql import functions as F

from quillspark.operators import islands, segments
from quillspark.operators.islands import merge_islands, with_islands
from quillspark.operators.segments import merge_transcriptions
from quillspark.storage import held

RANGES = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}  # several ranges, small as they are

CHUNKS = "recording string, pos long, start_s double, end_s double, text string, words array<struct<start_s:double,end_s:double,word:string>>"


def rows(df):
    return sorted((tuple(map(tuple, [r["warnings"]])), *r[:6]) if r[0] is not None else (tuple(map(tuple, [r["warnings"]])), "", *r[1:6]) for r in df.collect())


def some_chunks(rng, recording, n, spread):
    out = []
    for pos in range(n):
        start, length = rng.randint(0, spread) / 2, rng.choice([0.5, 1, 2, 4])
        words = None
        if rng.random() < 0.7:
            words = []
            for _ in range(rng.randint(0, 4)):
                a = rng.randint(0, int(2 * length)) / 2
                words.append((a, float(min(length, a + rng.randint(0, 3) / 2)), rng.choice(["a", " b", "c ", " "])))
            words.sort(key=lambda w: w[0])
        out.append((recording, pos, start, start + length, rng.choice(["x", "x y", "", "z", None]), words))
    return out


def test_islands_equal_the_sweep(spark):
    rng = random.Random(4)
    given = []
    for k in range(60):
        given += some_chunks(rng, f"r{k}" if k else None, rng.randint(1, 30), rng.choice([10, 60, 400]))
    given += [("touch", k, float(k), k + 1.0, "t", [(0.0, 1.0, "w")]) for k in range(20)]
    given += [("point", 0, 0.0, 2.0, "p", None), ("point", 1, 2.0, 2.0, "p", None), ("point", 2, 2.0, 4.0, "p", None)]
    chunks = spark.createDataFrame(given, CHUNKS).repartition(5)
    with held(spark, RANGES):
        assert rows(merge_islands(chunks)) == rows(merge_transcriptions(chunks))
    assert merge_islands(chunks.limit(0)).count() == 0


def test_a_long_recording_is_many_islands(spark):
    """Half the chunks overlap the next one: islands of two, over several ranges, each with its own rows."""
    given = [("r", k, 2.0 * k + (k % 2) * -0.5, 2.0 * k + 1.8, f"t{k % 7}", [(0.0, 0.4, f"w{k % 5}"), (0.5, 1.0, "v")]) for k in range(3000)]
    chunks = spark.createDataFrame(given, CHUNKS)
    with held(spark, RANGES):
        found = with_islands(chunks, "recording")
    sizes = found.groupBy("__home", "__island").count()
    assert sizes.agg(F.max("count")).first()[0] == 2 and sizes.count() == 1500 and sizes.select("__home").distinct().count() > 1
    assert rows(merge_islands(chunks)) == rows(merge_transcriptions(chunks))


def test_one_row_a_recording_and_bounded_parts(spark):
    """Transcripts come from a row a recording or island, the same by both plans; few chunks are Python's at once."""
    rng = random.Random(9)
    given = [c for k in range(40) for c in some_chunks(rng, f"r{k}" if k else None, rng.randint(1, 30), 60)]
    chunks = spark.createDataFrame(given, CHUNKS).repartition(3)
    recordings = segments.merge_recordings(chunks)
    assert recordings.count() == recordings.select("recording").distinct().count() < merge_transcriptions(chunks).count()
    want = sorted(map(tuple, segments.transcript(merge_transcriptions(chunks)).collect()), key=str)
    assert sorted(map(tuple, segments.transcripts(recordings).collect()), key=str) == want
    assert sorted(map(tuple, islands.transcripts(chunks).collect()), key=str) == want
    assert segments.CHUNKS <= 100 and "FlatMapGroupsInPandas" not in recordings._jdf.queryExecution().toString()
