import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import leakage, manifests
from quillspark.operators.intervals import plan_chunks, union_intervals
from quillspark.operators.segments import chunk_violations, filter_summary, judge, long_form, merge_chunks, rebase
from quillspark.plans import report
from quillspark.sources import files, sinks


def speech(spark, *spans, duration=None):
    return spark.createDataFrame([("r", float(a), float(b), duration) for a, b in spans], "rec string, start_s double, end_s double, dur double")


def plan(df, **more):
    return [(round(r["start_s"], 9), round(r["end_s"], 9), r["forced_split"]) for r in plan_chunks(df, "rec", **more).orderBy("chunk").collect()]


def test_union(spark):
    got = union_intervals(speech(spark, (0, 5), (5, 7), (8, 9), (1, 2)), "rec").orderBy("region").collect()
    assert [(r["start_s"], r["end_s"]) for r in got] == [(0, 7), (8, 9)]


def test_plan(spark):
    assert plan(speech(spark, (0, 10), (11, 20), (21, 40)), max_chunk_s=25) == [(0, 20, False), (21, 40, False)]
    forced = plan(speech(spark, (0, 70)), max_chunk_s=28)
    assert len(forced) == 3 and forced[0][0] == 0 and forced[-1][1] == 70 and all(x[2] for x in forced)
    assert plan(speech(spark, (0, 5)), pad_s=0.5) == [(0, 5.5, False)]
    assert plan(speech(spark, (0, 20), (5, 10)), max_chunk_s=25) == [(0, 20, False)]
    assert plan(speech(spark)) == []
    padded = plan(speech(spark, (0, 70), duration=70.0), pad_s=0.2, duration="dur")
    assert all(b - a <= 28 + 1e-6 for a, b, _ in padded) and all(x[1] >= y[0] for x, y in zip(padded, padded[1:], strict=False))
    with pytest.raises(Exception, match="beyond"):
        plan(speech(spark, (0, 31), duration=30.0), duration="dur")
    with pytest.raises(Exception, match="max_chunks"):
        plan(speech(spark, (0, 60)), max_chunks=2)
    for wrong in ((3, 3), (4, 3), (-1, 2), (0, float("nan"))):
        with pytest.raises(Exception, match="0 <= start < end"):
            plan(speech(spark, (0, 2), wrong))
    two = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 40.0), (None, 2.0, 3.0), (None, 3.0, 4.0)], "rec string, start_s double, end_s double")
    got = {(r["rec"], r["chunk"], r["start_s"], r["end_s"], r["forced_split"]) for r in plan_chunks(two, "rec").collect()}
    assert got == {("a", 0, 0.0, 1.0, False), ("b", 0, 0.0, 20.0, True), ("b", 1, 20.0, 40.0, True), (None, 0, 2.0, 4.0, False)}


def test_plan_against_union(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), float(a), float(a + rng.randint(1, 40))) for a in (rng.randrange(3000) for _ in range(300))]
    df = spark.createDataFrame(rows, "rec int, start_s double, end_s double")
    regions = {k: [] for k in range(5)}
    for r in union_intervals(df, "rec").orderBy("rec", "start_s").collect():
        regions[r["rec"]].append((r["start_s"], r["end_s"]))
    for rec, spans in regions.items():
        want, held = [], None
        for lo, hi in spans:
            if held and hi - held[0] <= 28:
                held[1] = hi
                continue
            want += [held] if held else []
            held = [lo, hi]
            if hi - lo > 28:
                n = -int(-(hi - lo) // 28)
                want += [[lo + k * (hi - lo) / n, hi if k == n - 1 else lo + (k + 1) * (hi - lo) / n] for k in range(n)]
                held = None
        want += [held] if held else []
        got = plan_chunks(df.where(F.col("rec") == rec), "rec").orderBy("chunk").collect()
        assert [[r["start_s"], r["end_s"]] for r in got] == want


def chunk(start, end, text=None, **words):
    own = [{"word": w, "start_s": float(a), "end_s": float(b)} for w, (a, b) in words.items()]
    return {"start_s": float(start), "end_s": float(end), "text": text or " ".join(words), "words": own}


@pytest.mark.parametrize(
    "chunks, text, warned",
    [
        ([chunk(0, 2, one=(0, 2)), chunk(0.5, 2, one=(0, 1))], "one", False),
        ([chunk(0, 2, one=(0, 2)), chunk(0.5, 2, two=(0, 1))], "one two", True),
        ([chunk(0, 2, one=(0, 1)), chunk(0.5, 3, one=(1, 2))], "one one", True),
        ([chunk(0, 10, one=(0, 1), three=(9, 10)), chunk(2, 8, two=(2, 3))], "one two three", True),
        ([chunk(0, 10, "first"), chunk(2, 8, "second")], "first second", True),
        ([chunk(0, 10, "first"), chunk(2, 8, "first")], "first", False),
        ([chunk(0, 3, one=(0, 2), two=(0, 1))], "one two", False),
    ],
)
def test_merge(chunks, text, warned):
    merged, warnings = merge_chunks(chunks)
    assert " ".join(m["text"] for m in merged) == text and bool(warnings) == warned


def by_rules(chunks):
    """The merge by its rules, every earlier word and chunk looked at."""
    words, kept, out, warned = [], [], [], set()
    for n, c in enumerate(sorted(chunks, key=lambda c: c["start_s"])):
        start, end, text = c["start_s"], c["end_s"], c["text"].strip()
        going = [k for k in kept if k[1] > start + 1e-6]
        if c["words"]:
            own = [(start + w["start_s"], start + w["end_s"], w["word"].strip()) for w in c["words"]]
            told = lambda w: any(p[2] == w[2] and p[1] > start + 1e-6 and p[0] <= w[0] + 1e-6 and p[1] >= w[1] - 1e-6 and w[0] < p[1] - 1e-6 for p in words)  # noqa: E731, B023
            fresh = [w for w in own if w[2] and not told(w)]
            if not fresh:
                continue
            words += fresh
            out += [(*w, n) for w in fresh]
        else:
            if not text or any(k[2].split() == text.split() and k[1] >= end - 1e-6 for k in going):
                continue
            out.append((start, end, text, n))
        warned |= {"word" if c["words"] else "text"} if going else set()
        kept.append((start, end, text))
    joined = []
    for lo, hi, text, n in sorted(out, key=lambda x: x[0]):
        if joined and joined[-1][3] == n:
            lo, hi, text = joined[-1][0], max(joined.pop()[1:2] + [hi]), f"{joined_text} {text}"
        joined_text = text
        joined.append([lo, hi, text, n])
    return [x[:3] for x in joined], warned


def test_merge_against_rules():
    rng = random.Random(1)
    for _ in range(2000):
        chunks = []
        for _ in range(rng.randint(0, 6)):
            start, length = rng.randint(0, 6), rng.randint(1, 5)
            words = sorted((rng.randint(0, 2 * length) / 2, rng.choice(["a", " b", "c ", " "])) for _ in range(rng.choice([0, 1, 3, 5])))
            words = [{"word": w, "start_s": a, "end_s": max(a, min(length, a + rng.randint(0, 4) / 2))} for a, w in words]
            chunks.append({"start_s": float(start), "end_s": float(start + length), "text": rng.choice(["x", "x  y", "x y", "", "z"]), "words": words})
        merged, warnings = merge_chunks(chunks)
        want, warned = by_rules(chunks)
        assert [[m["start_s"], m["end_s"], m["text"]] for m in merged] == want
        assert len(warnings) == len(warned) and merge_chunks([chunk(0, 1, " a  b ")])[0][0]["text"] == "a  b"


DECODED = "recording string, chunk int, asked_start_s double, asked_end_s double, start_s double, end_s double, text string, avg_logprob double, compression_ratio double, no_speech_prob double, words array<struct<start_s:double,end_s:double,word:string,probability:double>>"


def decoded(spark, *rows):
    return spark.createDataFrame([("r", 0, 10.0, 20.0, a, b, t, -0.1, 1.0, 0.1, w) for a, b, t, w in rows], DECODED)


def test_rebase(spark):
    given = decoded(
        spark,
        (1.0, 3.0, " ab ", [(0.5, 2.0, "a", 0.9), (2.0, 3.5, "b", 0.8)]),
        (4.0, 5.0, "cd", [(4.0, 4.5, " ", 1.0), (4.5, 5.0, "d", 1.0)]),
        (6.0, 7.0, "ef", [(6.0, 6.5, " ", 1.0)]),
    )
    got = rebase(given).collect()
    assert [(r["window_start_s"], r["window_end_s"], r["text"]) for r in got] == [(10.5, 13.5, "ab"), (14.0, 15.0, "cd"), (16.0, 17.0, "ef")]
    assert [[(w["start_s"], w["end_s"]) for w in r["words"]] for r in got] == [[(0.0, 1.5), (1.5, 3.0)], [(0.0, 0.5), (0.5, 1.0)], []]
    with pytest.raises(Exception, match="outside its audio"):
        rebase(decoded(spark, (9.0, 10.5, "x", []))).collect()
    for wrong in ((-1.0, 2.0, "x", []), (5.0, 2.0, "x", []), (1.0, float("nan"), "x", []), (1.0, 3.0, "x", [(2.0, 1.0, "a", 1.0)]), (1.0, 3.0, "x", [(None, 1.0, "a", 1.0)])):
        with pytest.raises(Exception, match="needs an extent"):
            rebase(decoded(spark, wrong)).collect()
    assert rebase(decoded(spark, (1.0, 3.0, "\t ab\u2003\n", []))).first()["text"] == "ab"
    assert not any(r["violations"] for r in chunk_violations(rebase(given)).collect())
    bad = rebase(decoded(spark, (1.0, 3.0, "x", [(2.0, 2.5, "a", 1.5), (1.0, 1.5, "b", 1.0)]))).withColumn("no_speech_prob", F.lit(2.0))
    assert [len(r["violations"]) for r in chunk_violations(bad).collect()] == [3]


def test_long_form(spark):
    def decode(asked):
        return asked.withColumns(
            {
                "start_s": F.lit(0.0), "end_s": F.lit(1.0), "text": F.concat(F.lit("part "), "chunk"), "avg_logprob": F.when(F.col("chunk") == 1, -3.0).otherwise(-0.1),
                "compression_ratio": F.lit(1.0), "no_speech_prob": F.lit(0.1), "words": F.array().cast("array<struct<start_s:double,end_s:double,word:string>>"),
            }
        )

    talk = spark.createDataFrame([("r", 0.0, 70.0, 70.0)], "recording string, start_s double, end_s double, duration_s double")
    got = long_form(talk, decode)
    row = got["transcripts"].first()
    assert (row["chunks"], row["forced_splits"], row["text"]) == (3, 3, "part 0 part 2") and got["dropped"].count() == 1
    with pytest.raises(ValueError, match="no_speech_prob"):
        long_form(talk, lambda asked: decode(asked).withColumn("no_speech_prob", F.lit(2.0)))


def test_confidence(spark):
    df = spark.createDataFrame([(-0.2, 1.5, 0.1), (-1.8, 1.5, 0.1), (-0.2, 3.5, 0.1), (-0.2, 1.5, 0.9), (-1.0, 2.4, 0.6)], "avg_logprob double, compression_ratio double, no_speech_prob double")
    assert [r["kept"] for r in judge(df).collect()] == [True, False, False, False, True]
    assert filter_summary(df).first()["summary"] == "kept 2, dropped 3 decoder segments"


def sides(spark, train, evaluation):
    schema = "manifest string, manifest_pos int, pos long, id string, source string, text string, audio_sha256 string"
    make = lambda name, rows: spark.createDataFrame([(name, 0, k, *r) for k, r in enumerate(rows)], schema)
    return make("t", train), make("e", evaluation)


def test_leakage(spark):
    t, e = sides(spark, [("1", "a", "বাক্য", "x")], [("1", "b", "বাক্য।", "y")])
    assert [(r["kind"], r["train_segments"]) for r in leakage.overlaps(t, e).collect()] == [("text", ["t:1"])]
    assert leakage.verdict(t, e).first()["state"] == "OVERLAP"
    keys = spark.createDataFrame([("বাক্য", "same phrase")], "key string, reason string")
    assert leakage.verdict(t, e, reviewed=keys).first()["state"] == "REVIEWED"
    assert leakage.verdict(t, e, kinds=("text",)).first()["state"] == "INCOMPLETE"
    t, e = sides(spark, [("1", "a", "x", "h")], [("2", "a", "y", None)])
    row = leakage.verdict(t, e).first()
    assert (row["coverage"], row["state"]) == (0.5, "INCOMPLETE")
    t, e = sides(spark, [("1", "a", "x", "h")], [("2", "a", "y", "g")])
    assert leakage.verdict(t, e).first()["state"] == "CLEAN"
    assert leakage.require_no_leakage(t, e).first()["state"] == "CLEAN"
    t, e = sides(spark, [("1", "a", "x", "AB")], [("2", "a", "y", "ab")])
    assert leakage.verdict(t, e).first()["state"] == "OVERLAP"
    with pytest.raises(ValueError, match="overlap"):
        leakage.require_no_leakage(t, e)
    t, e = sides(spark, [("1", "a", "x", "h"), ("3", "a", "x", "i")], [("2", "a", "x", "g")])
    twice = spark.createDataFrame([("x", "same"), ("x", "again")], "key string, reason string")
    assert leakage.verdict(t, e, reviewed=twice).first()["state"] == "REVIEWED"


def test_leakage_by_file(spark):
    t, e = sides(spark, [("1", "a", "x", None)], [("2", "b", "y", None)])
    t, e = t.withColumn("audio", F.lit("a.wav")), e.withColumn("audio", F.lit("link.wav"))
    files_ = spark.createDataFrame([("a.wav", "inode1", "AA"), ("link.wav", "inode1", "AA")], "audio string, file_key string, sha256 string")
    t, e = leakage.with_file_hashes(t, files_), leakage.with_file_hashes(e, files_)
    found = [(r["kind"], r["train_segments"], r["eval_segments"]) for r in leakage.overlaps(t, e, ("file", *leakage.KINDS)).collect()]
    assert found == [("file", ["t:1"], ["e:2"]), ("audio", ["t:1"], ["e:2"])]
    row = leakage.verdict(t, e, ("file", *leakage.KINDS)).first()
    assert (row["file_overlaps"], row["coverage"], row["state"]) == (1, 1.0, "OVERLAP")
    with pytest.raises(ValueError, match="does not match"):
        leakage.with_file_hashes(t.withColumn("audio_sha256", F.lit("bb")), files_)
    with pytest.raises(ValueError, match="missing"):
        leakage.with_file_hashes(t.withColumn("audio", F.lit("gone")), files_)


def rows(spark, *given):
    base = {"audio": "a.wav", "text": "x", "duration_s": 2.0, "start_s": None, "speaker": None, "language": "bn", "audio_sha256": None, "source": "s"}
    schema = manifests.SEGMENT + ", source string"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    full = [base | {"recording_id": g["id"]} | g for g in given]
    return spark.createDataFrame([tuple(f[n] for n in names) for f in full], schema)


def test_collapse(spark):
    df = rows(
        spark,
        {"id": "b", "recording_id": "r1", "start_s": 4.0, "text": "দ্বিতীয়"},
        {"id": "a", "recording_id": "r1", "start_s": 0.0, "text": "প্রথম"},
        {"id": "c", "recording_id": "r2", "duration_s": 3.0},
    )
    got = {r["id"]: r for r in manifests.collapse_to_recordings(df).collect()}
    assert (got["r1"]["text"], got["r1"]["duration_s"], got["r2"]["duration_s"]) == ("প্রথম দ্বিতীয়", 6.0, 3.0)
    measured = lambda s: manifests.collapse_to_recordings(df.withColumn("measured_s", F.lit(s))).collect()
    assert {r["duration_s"] for r in measured(7.5)} == {7.5}
    with pytest.raises(Exception, match="inconsistent"):
        measured(5.0)
    with pytest.raises(Exception, match="inconsistent"):
        manifests.collapse_to_recordings(rows(spark, {"id": "a", "recording_id": "r"}, {"id": "b", "recording_id": "r"})).collect()


def test_selection(spark):
    df = rows(spark, *({"id": str(k), "audio": f"{k}.wav", "duration_s": d} for k, d in enumerate([0.5, 2.0, 30.0, 40.0])))
    assert [r["duration_s"] for r in manifests.select_examples(df).collect()] == [2.0, 30.0]
    ten = rows(spark, *({"id": str(k), "audio": f"{k}.wav"} for k in range(10)))
    flags = [[r["use_timestamps"] for r in manifests.select_examples(ten, fraction=0.5, seed=7).collect()] for _ in range(2)]
    assert flags[0] == flags[1] == [k in random.Random(7).sample(range(10), 5) for k in range(10)] and sum(flags[0]) == 5
    with pytest.raises(ValueError, match="repeated"):
        manifests.select_examples(rows(spark, {"id": "1"}, {"id": "1"}))


def test_contract(spark):
    good = rows(spark, {"id": "1"})
    manifests.check_manifest(good)
    bad = rows(spark, {"id": "1", "audio": "../x", "duration_s": 0.0, "start_s": -1.0})
    assert len(manifests.violations(bad).first()["violations"]) == 3
    with pytest.raises(ValueError):
        manifests.check_manifest(rows(spark, {"id": "1"}, {"id": "1"}))
    numbers = spark.createDataFrame([("1_0",), ("1d",), (" 2.5 ",), ("nan",)], "x string").select(manifests.parse_number(F.col("x")).alias("y"))
    assert [r["y"] for r in numbers.collect()] == [10.0, None, 2.5, None]


def test_manifest_round_trip(spark, tmp_path):
    df = rows(spark, {"id": "1", "text": "a b"}, {"id": "2", "start_s": 0.0}).withColumn("pos", F.col("id").cast("long"))
    header = {"name": "m", "source": "s", "split": "dev", "domain": "read", "version": "1"}
    sinks.write_lines(sinks.manifest_lines(df, header), str(tmp_path / "m"))
    back = files.read_manifests(spark, str(tmp_path / "m" / "*.txt")).orderBy("pos").collect()
    assert [(r["id"], r["text"], r["start_s"], r["manifest"]) for r in back] == [("1", "a b", None, "m"), ("2", "x", 0.0, "m")]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited(spark, tmp_path):
    good = write(tmp_path / "a.tsv", '﻿a\t"b\nc"\nd\te\n')
    assert sorted((r["line"], r["fields"]) for r in files.delimited_rows(spark, good).collect()) == [(1, ["a", "b\nc"]), (3, ["d", "e"])]
    with pytest.raises(Exception, match="b.tsv:1"):
        files.delimited_rows(spark, write(tmp_path / "b.tsv", 'a\t"b\n')).collect()


def test_indexes(spark, tmp_path):
    cv = write(tmp_path / "cv.tsv", "client_id\tpath\tsentence\nc1\tx.mp3\tকি\n\ty.mp3\t \n\tz.mp3\tখাই\n")
    times = write(tmp_path / "d.tsv", "clip\tduration[ms]\nx.mp3\t1500\n\nz.mp3\t2000\n")
    got = {r["id"]: r for r in files.common_voice(spark, cv, times).collect()}
    assert set(got) == {"x", "z"} and got["x"]["duration_s"] == 1.5 and got["x"]["recording_id"] == "c1" and got["z"]["recording_id"] == "z"
    fl = write(tmp_path / "f.tsv", "1\tx.wav\tRAW\tকি\t32000\tMALE\n")
    assert files.fleurs(spark, fl).first()["duration_s"] == 2.0
    paths = [write(tmp_path / n, t) for n, t in (("text", "u1 কি\nu2 খাই\n"), ("wav.scp", "r1 a.wav\nr2 b.wav\n"), ("segments", "u1 r1 0 1.5\nu2 r1 2 4\n"), ("utt2spk", "u1 s\nu2 s\n"))]
    assert {(r["id"], r["recording_id"], r["start_s"], r["duration_s"]) for r in files.kaldi(spark, *paths).collect()} == {("u1", "r1", 0.0, 1.5), ("u2", "r1", 2.0, 2.0)}
    with pytest.raises(ValueError, match="differ"):
        files.kaldi(spark, paths[0], paths[1])
    loop = write(tmp_path / "l.jsonl", json.dumps({"id": "1", "audio_filepath": "/r/a.wav", "duration": 2, "text": "x"}) + "\n")
    assert files.loop_jsonl(spark, loop, "/r").first()["audio"] == "a.wav"
    with pytest.raises(ValueError, match="repeated key"):
        files.strict_object('{"a": {"b": 1, "b": 2}}')


def test_audio_files(spark, tmp_path):
    import hashlib
    import wave

    for name, seconds in (("sub/u1.wav", 1), ("u2.WAV", 2)):
        path = tmp_path / "w" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with wave.open(str(path), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"\0\0" * 8000 * seconds)
    (tmp_path / "w" / "note.txt").write_text("x")
    root = str(tmp_path / "w")
    index = files.wav_index(spark, root)
    assert {(r["stem"], r["audio"], r["duration_s"]) for r in index.collect()} == {("u1", "sub/u1.wav", 1.0), ("u2", "u2.WAV", 2.0)}
    tsv = write(tmp_path / "s.tsv", "u1\tsp1\tকি\nu2\tsp2\t \n")
    assert [(r["id"], r["audio"], r["duration_s"], r["recording_id"]) for r in files.slr53(spark, tsv, index).collect()] == [("u1", "sub/u1.wav", 1.0, "sp1")]
    hashes = {r["path"]: r["sha256"] for r in files.file_hashes(spark, root).collect()}
    assert set(hashes) == {"sub/u1.wav", "u2.WAV", "note.txt"} and hashes["note.txt"] == hashlib.sha256(b"x").hexdigest()
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no files"):
        files.file_hashes(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="evaluation only"):
        files.loop_jsonl(spark, tsv, split="train")


def test_windows_and_numbers(spark):
    from quillspark.operators.intervals import real_time_factor

    given = [(None, 2.0, 2.0005, 2.0005), (None, None, 3.0, 3.0), (1.0, 1.0005, 2.0, 1.0), (1.0, None, 2.5, 1.5), (0.0, 0.5, 2.0, 0.5)]
    df = spark.createDataFrame([("a", *g) for g in given], "audio string, start_s double, duration_s double, actual_s double, want double")
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in df.withColumn("got", manifests.validate_window()).collect())
    for bad in ((None, 1.0, 2.0), (2.0, 1.0, 2.0), (3.0, None, 2.0), (-1.0, 1.0, 2.0), (1.0, 1.5, 2.0), (None, 1.0, None), (0.0, 0.0, 2.0)):
        with pytest.raises(Exception, match="does not fit a"):
            spark.createDataFrame([("a", *bad)], "audio string, start_s double, duration_s double, actual_s double").select(manifests.validate_window()).collect()
    numbers = spark.createDataFrame([(x,) for x in ("1_0", " 2.5 ", "1d", "1e3", "nan", "", None)], "t string")
    assert [r[0] for r in numbers.select(manifests.parse_number(F.col("t"))).collect()] == [10.0, 2.5, None, 1000.0, None, None, None]
    assert spark.range(1).select(real_time_factor(F.lit(1.0), F.lit(4.0))).first()[0] == 0.25
    registry = spark.createDataFrame([("b", "pending"), ("a", "pending"), ("c", "approved")], "id string, status string")
    assert [r["id"] for r in manifests.sources_of(registry).collect()] == ["c", "a", "b"] and manifests.sources_of(registry, "approved").count() == 1
    ids = spark.createDataFrame([("r2",), ("r1",), ("r2",)], "recording_id string")
    assert [r[0] for r in manifests.recording_ids(ids).collect()] == ["r1", "r2"]


def test_licenses_and_report(spark):
    fields = dict(id="s", name="n", url="u", license="l", access="open", status="eval-only", domain="read", version="1", notes="", confidence="high")
    text = "[[licenses]]\n" + "\n".join(f'{k} = "{v}"' for k, v in fields.items())
    registry = files.read_licenses(spark, text)
    held = spark.createDataFrame([("s", "train"), ("s", "test"), ("q", "test")], "source string, split string")
    got = {(r["source"], r["split"]): r["problem"] for r in manifests.license_state(held, registry).collect()}
    assert got == {("s", "train"): "for evaluation only", ("s", "test"): None, ("q", "test"): "not registered"}
    cells = [{"system": "a|b", "slice": "s", "pending": None, "wer": 0.25, "cer": 0.1, "segments": 2}, {"system": "c", "slice": "s", "pending": "later"}]
    page = report.render_markdown("t", cells)
    assert "| a\\|b | 25.0% | 10.0% | 2 |" in page and "pending: later" in page
    assert json.loads(report.render_json("t", cells))["title"] == "t"


def test_atomic_outputs(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "no" / "b")
    with pytest.raises(OSError):
        sinks.write_atomic({a: "1", b: "2"})
    assert not (tmp_path / "a").exists()
    sinks.write_atomic({a: "1"})
    assert (tmp_path / "a").read_text() == "1"


def test_stream(spark, tmp_path):
    from quillspark.streaming.filters import filtered_stream

    spark.createDataFrame([(-0.2, 1.5, 0.1), (-1.8, 1.5, 0.1)], "avg_logprob double, compression_ratio double, no_speech_prob double").write.parquet(str(tmp_path / "in"))
    schema = "avg_logprob double, compression_ratio double, no_speech_prob double"
    query = filtered_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("kept").count() == 1
