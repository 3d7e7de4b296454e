"""Files by streams, checkpoints, and runs of a model over a manifest."""

import hashlib
import io
import json
import os
import sys
import wave

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators.manifests import SEGMENT
from quillspark.plans import transcription
from quillspark.sources import checkpoints, files, streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test
ROWS = "manifest string, pos long, " + SEGMENT


def wav(path, seconds, rate=8000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * int(rate * seconds))
    return path


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse WAV file of over 2 GB: its header and its digest, by streams."""
    long = wav(tmp_path / "long.wav", 1)
    frames = (1 << 30) + 4000
    with open(long, "r+b") as f:
        f.seek(4)
        f.write((36 + 2 * frames).to_bytes(4, "little"))
        f.seek(40)
        f.write((2 * frames).to_bytes(4, "little"))
        f.truncate(44 + 2 * frames)
    head = files.wav_durations(spark, str(tmp_path), hashed=False).first()
    assert head["duration_s"] == frames / 8000 and head["sha256"] is None and head["stem"] == "long"
    with open(long, "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert files.file_hashes(spark, str(tmp_path)).collect()[0]["sha256"] == want


def test_openers_and_names(spark, tmp_path):
    """Names that addresses encode are kept; an opener of one's own is used; what is no WAV file is told by its path."""
    wav(tmp_path / "a b%20é#.wav", 0.5)
    row = files.wav_durations(spark, str(tmp_path)).first()
    assert (row["stem"], row["duration_s"]) == ("a b%20é#", 0.5)
    assert files.file_hashes(spark, str(tmp_path), opener=lambda path: io.BytesIO(b"other")).first()["sha256"] == hashlib.sha256(b"other").hexdigest()
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    with pytest.raises(Exception, match="bad.wav cannot be read"):
        files.wav_durations(spark, str(tmp_path)).collect()


def test_content_without_streams(spark, tmp_path, monkeypatch):
    """Where tasks cannot open files, contents come through Spark, with the same results."""
    wav(tmp_path / "u.wav", 1)
    streamed = files.wav_durations(spark, str(tmp_path)).collect()
    monkeypatch.setattr(streams, "opener_of", lambda spark, path: None)
    assert files.wav_durations(spark, str(tmp_path)).collect() == streamed


def test_checkpoint_scan(spark, tmp_path):
    assert checkpoints.checkpoints(spark, str(tmp_path / "none")).count() == 0
    assert not checkpoints.latest(spark, str(tmp_path)).resumes
    states = {
        "checkpoint-10": '{"global_step": 10}', "checkpoint-9": '{"global_step": 9, "epoch": 1.5}', "checkpoint-300": '{"global_step": 30}',
        "checkpoint-400": "{", "checkpoint-500": '{"global_step": 500.0}', "checkpoint-600": '{"global_step": true}', "checkpoint-700": "[700]",
        "checkpoint-800": '{"global_step": 800, "global_step": 800}', "checkpoint-x": '{"global_step": 1}', "old-checkpoint-900": '{"global_step": 900}',
        "checkpoint-0": '{"global_step": 0}', "checkpoint-99999999999999999999": '{"global_step": 99999999999999999999}',
    }
    for name, state in states.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "trainer_state.json").write_text(state)
    (tmp_path / "checkpoint-1000").mkdir()
    found = checkpoints.checkpoints(spark, str(tmp_path)).collect()
    assert [r["step"] for r in found] == [0, 9, 10] and found[-1]["path"].endswith("/checkpoint-10")
    best = checkpoints.latest(spark, str(tmp_path))
    assert best.step == 10 and best.resumes and str(best).startswith("from step 10, ") and str(checkpoints.Resume()) == "from the start"
    assert checkpoints.latest(spark, str(tmp_path), enabled=False) == checkpoints.Resume()


def test_checkpoint_hashes(spark, tmp_path):
    root = tmp_path / "m"
    given = {"config.json": b"{}", "part/weights.bin": b"w" * 1000, ".hidden": b"h", "_under": b"u", "empty": b"", "part/deep/x": b"x"}
    for name, data in given.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "config.json", root / "link.json")
    want = {k: hashlib.sha256(v).hexdigest() for k, v in (given | {"link.json": b"{}"}).items()}
    identity = checkpoints.checkpoint_identity(spark, str(root))
    assert identity["files_sha256"] == want and identity["source"] == "local" and identity["path"] == str(root)
    os.symlink(root / "part", root / "linked")
    with pytest.raises(ValueError, match="linked"):
        checkpoints.checkpoint_hashes(spark, str(root))
    os.remove(root / "linked")
    os.symlink(root / "gone", root / "broken")
    with pytest.raises(ValueError, match="broken"):
        checkpoints.checkpoint_hashes(spark, str(root))
    (tmp_path / "none").mkdir()
    for name in ("none", "nowhere"):
        with pytest.raises(ValueError, match="no f"):
            checkpoints.checkpoint_hashes(spark, str(tmp_path / name))


class Fake:
    """Notes each time it is made, and tells the window that it was given."""

    def __init__(self, log, text=None):
        self.log, self.text = log, text
        with open(log, "a") as f:
            f.write("made\n")

    def transcribe(self, audio_path, start_s=None, duration_s=None):
        with open(self.log, "a") as f:
            f.write("called\n")
        assert os.path.isfile(audio_path)
        return self.text if self.text is not None else f"{os.path.basename(audio_path)} {start_s} {duration_s}"

    def observed_runtime_context(self):
        return {"device": "none", "token": "hf_secret"}


@pytest.fixture()
def audio(tmp_path):
    for name in ("a.wav", "deep/b.wav"):
        wav(tmp_path / "w" / name, 2)
    return str(tmp_path / "w")


def manifest(spark, rows):
    full = [("m", k, i, a, "কি", d, i, s, None, "bn", h) for k, (i, a, s, d, h) in enumerate(rows)]
    return spark.createDataFrame(full, ROWS)


GOOD = [("u1", "a.wav", None, 2.0, None), ("u2", "a.wav", 0.5, 1.5, None), ("u3", "deep/b.wav", 0.0, 1.0, None)]


def test_run_over_manifest(spark, tmp_path, audio):
    log = str(tmp_path / "log")
    known = transcription.audio_files(spark, audio)
    rows = manifest(spark, GOOD + [(f"v{k}", "a.wav", 0.0, 1.0 + k / 100, None) for k in range(60)])
    told = transcription.run_over_manifest(rows, known, lambda: Fake(log), "fake", tasks=3)
    got = {r["id"]: r for r in told.collect()}
    assert len(got) == 63 and {r["system"] for r in got.values()} == {"fake"} and told.count() == 63
    assert [got[k]["hypothesis"] for k in ("u1", "u2", "u3")] == ["a.wav None 2.0", "a.wav 0.5 1.5", "b.wav 0.0 1.0"]
    lines = open(log).read().split()
    assert lines.count("made") <= 3 and lines.count("called") == 63
    head = transcription.predictions_header(told, {"seed": 1})
    assert head["manifest"] == "m" and head["run_context"]["seed"] == 1 and head["run_context"]["observed_runtime"]["device"] == "none"
    assert "hf_secret" not in json.dumps(head)


@pytest.mark.parametrize(
    ("bad", "match"),
    [
        (("x", "gone.wav", None, 2.0, None), "missing audio"),
        (("x", "../w/a.wav", None, 2.0, None), "invalid segments"),
        (("x", "a.wav", 1.0, 1.5, None), "does not fit"),
        (("x", "a.wav", None, 1.5, None), "does not fit"),
        (("x", "a.wav", None, 2.0, "0" * 64), "does not match"),
        (("u1", "a.wav", 0.0, 1.0, None), "duplicate"),
    ],
)
def test_invalid_segments_stop_a_run(spark, tmp_path, audio, bad, match):
    """No transcriber is made if any segment is wrong."""
    log = tmp_path / "log"
    with pytest.raises(Exception, match=match):
        transcription.run_over_manifest(manifest(spark, [*GOOD, bad]), transcription.audio_files(spark, audio), lambda: Fake(str(log)), "fake")
    assert not log.exists()


def test_other_wrong_runs(spark, tmp_path, audio):
    known, log = transcription.audio_files(spark, audio), str(tmp_path / "log")
    with pytest.raises(ValueError, match="name of its system"):
        transcription.run_over_manifest(manifest(spark, GOOD), known, lambda: Fake(log), " ")
    with pytest.raises(ValueError, match="one manifest"):
        transcription.run_over_manifest(manifest(spark, GOOD).withColumn("manifest", F.col("id")), known, lambda: Fake(log), "fake")
    with pytest.raises(ValueError, match="one manifest"):
        transcription.run_over_manifest(manifest(spark, []), known, lambda: Fake(log), "fake")
    with pytest.raises(Exception, match="no text for segment"):
        transcription.run_over_manifest(manifest(spark, GOOD), known, lambda: Fake(log, text=7), "fake")
