
import pytest
from pyspark.sql import functions as F

from quillspark.operators import manifests
from quillspark.sources import files, prepare

LICENSES = [("common_voice_bn", "approved"), ("fleurs_bn", "eval-only"), ("mucs_slr104", "approved"), ("bengali_loop", "excluded")]


@pytest.fixture
def root(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")

    write("common_voice/train.tsv", "client_id\tpath\tsentence\nc1\tx.mp3\tকি\nc2\ty.mp3\t \n")
    write("common_voice/test.tsv", "client_id\tpath\tsentence\nc3\tz.mp3\tকি\n")
    write("common_voice/clip_durations.tsv", "clip\tduration[ms]\nx.mp3\t1500\n\nz.mp3\t2000\n")
    write("fleurs/test.tsv", "1\tw.wav\tRAW\tখাই\t32000\tMALE\n")
    return tmp_path


def test_prepare(spark, root):
    licenses = spark.createDataFrame(LICENSES, "id string, status string")
    indexes = prepare.known_indexes(str(root), {"loop": f"{root}/loop.jsonl"})
    got = prepare.prepare(spark, indexes, licenses, str(root / "out"))
    assert set(got.manifests) == {"cv-bn-train", "cv-bn-test", "fleurs-bn-test"}
    assert set(got.pending) == {"Common Voice dev: local index missing", "MUCS train: local index missing", "MUCS test: local index missing", "loop: permissions are unconfirmed"}
    row = got.manifests["cv-bn-train"].first()
    assert (row["id"], row["audio"], row["duration_s"], row["pos"], row["split"]) == ("x", "common_voice/clips/x.mp3", 1.5, 0, "train")
    states = {name: df.first() for name, df in got.audits.items()}
    assert set(states) == {"cv-bn-test", "fleurs-bn-test"} and states["cv-bn-test"]["text_overlaps"] == 1 and states["fleurs-bn-test"]["state"] == "INCOMPLETE"
    back = files.read_manifests(spark, str(root / "out" / "cv-bn-test.manifest.jsonl" / "part-*")).first()
    assert (back["manifest"], back["id"], back["text"]) == ("cv-bn-test", "z", "কি")
    denied = spark.createDataFrame([("common_voice_bn", "eval-only"), *LICENSES[1:]], "id string, status string")
    with pytest.raises(ValueError, match="license"):
        prepare.prepare(spark, indexes, denied)


def test_build_manifest(spark):
    header = prepare.Header("m", "s", "train", "read", "1")
    rows = spark.createDataFrame([("b", "b.wav", " x ", None, None), ("a", "a.wav", "y", 2.0, 1.0), ("c", "c.wav", " ", None, None)], "id string, audio string, text string, duration_s double, start_s double")
    lengths = spark.createDataFrame([("b.wav", 3.0)], "audio string, seconds double")
    hashes = spark.createDataFrame([("a.wav", "1", "A" * 64), ("b.wav", "2", "b" * 64)], "audio string, file_key string, sha256 string")
    got = prepare.build_manifest(rows, header, lengths, hashes).orderBy("pos").collect()
    assert [(r["id"], r["text"], r["duration_s"], r["recording_id"], r["language"], r["audio_sha256"]) for r in got] == [("a", "y", 2.0, "a", "bn", "a" * 64), ("b", "x", 3.0, "b", "bn", "b" * 64)]
    for wrong, told in ((rows.withColumn("duration_s", F.lit(None).cast("double")), "need a length"), (rows.withColumn("audio", F.lit("../a")), "outside"), (rows, "invalid")):
        with pytest.raises(ValueError, match=told):
            prepare.build_manifest(wrong, header)
    with pytest.raises(ValueError, match="split"):
        prepare.Header("m", "s", "all", "read", "1")


def test_preflight(spark):
    schema = manifests.SEGMENT + ", manifest string, manifest_pos int, source string, split string, pos long"

    def side(name, split, *ids, source="common_voice_bn", pos=0, start=None, length=2.0, language="bn", text="কি {}"):
        rows = [(i, f"{i.rstrip('+')}.wav", text.format(i), length, "r", start, None, language, None, name, pos, source, split, k) for k, i in enumerate(ids)]
        return spark.createDataFrame(rows, schema)

    def files(**other):
        rows = [(f"{i}.wav", f"k{i}", other.get(f"sha{i}", f"h{i}"), other.get(f"len{i}", 2.0)) for i in "1234"]
        return spark.createDataFrame(rows, "audio string, file_key string, sha256 string, actual_s double")

    licenses = spark.createDataFrame(LICENSES, "id string, status string")
    train, dev, held = side("t", "train", "1", "2"), side("e", "dev", "3"), side("h", "test", "4")
    a, b = manifests.training_preflight(train, dev, licenses, files(), held)
    assert (a.count(), b.count()) == (2, 1)
    long_crops = side("t", "train", "1", start=0.5, length=1.5).unionByName(side("t", "train", "1+", start=0.5, length=1.5004))
    wrong = [
        ((side("t", "test", "1"), dev, files()), "not for train"),
        ((train, side("e", "test", "3"), files()), "split dev"),
        ((train, dev.limit(0), files()), "needs development"),
        ((train, side("t", "dev", "3"), files()), "several sides"),
        ((side("t", "train", "1", language="en"), dev, files()), "another language"),
        ((train, dev, files().where("audio <> '2.wav'")), "missing audio"),
        ((train.withColumn("audio_sha256", F.lit("zz")), dev, files()), "does not match"),
        ((train, dev, files(len1=5.0)), "does not fit"),
        ((train, dev, files(sha2="h1")), "repeated windows"),
        ((long_crops, dev, files()), "repeated windows"),
        ((train, dev, files(sha4="h3"), held), "held-out manifests overlap"),
        ((train, dev, files(sha3="h1")), "overlap"),
        ((side("t", "train", "1", text="এক"), side("e", "dev", "3", text="এক।"), files()), "overlap"),
    ]
    for (train_, dev_, *more), told in wrong:
        with pytest.raises(Exception, match=told):
            manifests.training_preflight(train_, dev_, licenses, *more)
    reviews = spark.createDataFrame([("এক", "a greeting")], "key string, reason string")
    texts = (side("t", "train", "1", text="এক"), side("e", "dev", "3", text="এক।"))
    assert manifests.training_preflight(*texts, licenses, files(), reviewed=reviews)[0].count() == 1
    with pytest.raises(ValueError, match="stale"):
        manifests.training_preflight(train, dev, licenses, files(), reviewed=reviews)
    runs = spark.createDataFrame([("base", 1.0, 10, 0.5, 0.2), ("new", 2.0, 20, 0.25, 0.1)], "run string, hours double, steps int, wer double, cer double")
    assert [(r["run"], r["wer_delta"]) for r in manifests.experiment_table(runs, "base").collect()] == [("new", -0.25), ("base", 0.0)]
    with pytest.raises(ValueError, match="no run"):
        manifests.experiment_table(runs, "other")
