import json
from datetime import UTC, datetime

import pytest

from quillspark import provenance
from quillspark.plans import evaluation
from quillspark.sources import sinks

NOW = datetime(2026, 1, 2, tzinfo=UTC)
SPEC = {
    "name": "r1",
    "title": "A|B",
    "n_resamples": 200,
    "slices": [{"name": "read", "manifest": "m.jsonl", "domain": "read"}, {"name": "mix", "manifest": "x.jsonl"}, {"name": "none", "manifest": "n.jsonl"}, {"name": "shut", "manifest": "s.jsonl"}],
    "systems": [{"name": "base", "model_kind": "pretrained"}, {"name": "tuned", "model_kind": "fine_tuned", "training_audit": "required", "pending_slices": {"mix": "not run"}}],
}
SEGMENTS = "slice string, manifest string, manifest_pos int, pos long, id string, source string, domain string, recording_id string, text string, audio_sha256 string, manifest_sha256 string"


@pytest.fixture
def given(spark):
    rows = [("read", "m", 0, k, f"i{k}", "s", "read", f"r{k % 2}", "আমি ভাত খাই", f"h{k}", "sha") for k in range(4)]
    rows += [("mix", "x", 0, 0, "j", "s", "code-switch", "r", "My BANK", "g", "sha2"), ("shut", "z", 0, 0, "q", "t", "read", "r", "x", "f", "sha3")]
    told = [("base", "read", f"i{k}", "আমি ডাল খাই" if k == 1 else "আমি ভাত খাই") for k in range(4)] + [("tuned", "read", f"i{k}", "আমি ভাত খাই") for k in range(4)] + [("base", "mix", "j", "my bank")]
    predictions = spark.createDataFrame([(*p, "psha") for p in told], "system string, slice string, id string, hypothesis string, predictions_sha256 string")
    licenses = spark.createDataFrame([("s", "l", "approved", True, None, False, 1.0), ("t", "l", "excluded", None, None, None, None)], "id string, license string, status string, redistributable_audio boolean, attribution_required boolean, share_alike boolean, hours double")
    train = spark.createDataFrame([("t", 0, 0, "a", "tr", "বই", "k")], "manifest string, manifest_pos int, pos long, id string, source string, text string, audio_sha256 string")
    return spark.createDataFrame(rows, SEGMENTS), predictions, licenses, train


def test_report(given, tmp_path):
    segments, predictions, licenses, train = given
    context = provenance.run_context(0, {"n_resamples": 200, "api_key": "k"}, "run --token abc", now=NOW)
    spec = evaluation.Spec.parse(json.dumps(SPEC))
    report = evaluation.build_report(spec, segments, predictions, licenses, context, {"tuned": train})
    cells = {(c["system"], c["slice"]): c for c in report["cells"]}
    base = cells["base", "read"]
    assert (base["wer"], base["norm_wer"], base["segments"], base["recordings"]) == (1 / 12, 1 / 12, 4, 2)
    assert (base["wer_lower"], base["wer_upper"]) == (0.0, 1 / 6) and cells["tuned", "read"]["norm_cer"] == 0
    assert cells["base", "mix"]["norm_wer"] == 0 and cells["base", "mix"]["wer"] == 1 and cells["base", "mix"]["wer_lower"] is None
    pending = {k: c["pending"] for k, c in cells.items() if c["pending"]}
    assert pending == {
        ("tuned", "mix"): "not run", ("base", "none"): "manifest unavailable", ("tuned", "none"): "manifest unavailable",
        ("base", "shut"): "source is excluded", ("tuned", "shut"): "source is excluded",
    }
    assert cells["tuned", "read"]["leakage"] == "CLEAN" and base["input_hashes"] == {"manifest": "sha", "predictions": "psha"}
    page, data = evaluation.write_report(report, str(tmp_path))
    text = open(page, encoding="utf-8").read()
    assert "# A\\|B" in text and "8.3% [0.0%, 16.7%]" in text and "(1 block, no CI)" in text and "abc" not in text and "Pending: not run." in text
    assert json.load(open(data, encoding="utf-8"))["run_context"]["config"] == {"n_resamples": 200, "api_key": "[redacted]"}
    with pytest.raises(ValueError, match="input"):
        evaluation.write_report(report, str(tmp_path), (page,))
    with pytest.raises(ValueError, match="needs an audit"):
        evaluation.build_report(spec, segments, predictions, licenses, context)
    with pytest.raises(ValueError, match="differs"):
        evaluation.build_report(spec, segments, predictions, licenses, context | {"seed": 1})
    extra = predictions.unionByName(predictions.limit(1).selectExpr("system", "slice", "'zz' as id", "hypothesis", "predictions_sha256"))
    with pytest.raises(ValueError, match="without a segment"):
        evaluation.build_report(spec, segments, extra, licenses, context, {"tuned": train})


@pytest.mark.parametrize(
    "change",
    [
        {"name": "a b"}, {"title": " "}, {"slices": []}, {"extra": 1}, {"n_resamples": 5}, {"seed": -1}, {"slices": [{"name": "a", "manifest": "/x"}]},
        {"systems": [{"name": "a", "model_kind": "fine_tuned"}]}, {"systems": [{"name": "a", "predictions": {"zz": "p"}}]}, {"systems": [{"name": "a", "colour": 1}]},
        {"systems": [{"name": "a"}, {"name": "a"}]}, {"systems": [{"name": "a", "pending_slices": {"mix": ""}}]},
    ],
)
def test_spec_is_checked(change):
    with pytest.raises(ValueError):
        evaluation.Spec.parse(json.dumps(SPEC | change))


def test_redaction():
    told = provenance.redact({"apiKey": "x", "AWSSecretAccessKey": "x", "my-token": "x", "tokens": 3, "empty_password": "", "deep": [{"Cookie": "c", "note": "X-Api-Key: abc"}]})
    assert told == {"apiKey": "[redacted]", "AWSSecretAccessKey": "[redacted]", "my-token": "[redacted]", "tokens": 3, "empty_password": "", "deep": [{"Cookie": "[redacted]", "note": "X-Api-Key: [redacted]"}]}
    assert provenance.redact_text("see https://me:pw@host/a?sig=1&b=2 now") == "see https://[redacted]@host/a?sig=[redacted]&b=2 now"
    for raw, told in {
        "Authorization: Bearer abc\nkeep: this": "Authorization: [redacted]\nkeep: this",
        "sent ('x-goog-api-key : k') ok": "sent ('x-goog-api-key: [redacted]",
        "note: no secret here": "note: no secret here",
        "s3://u:p@host/x?AWSSecretAccessKey=1#token=2&page=3": "s3://[redacted]@host/x?AWSSecretAccessKey=[redacted]#token=[redacted]&page=3",
        "a?api%5Fkey=1 b": "a?api%5Fkey=[redacted] b",
        "mail me@host at 10:30": "mail me@host at 10:30",
        "": "",
    }.items():
        assert provenance.redact_text(raw) == told
    for raw, told in {
        "run --token --seed 3": "run --token '[redacted]' 3",
        "run --api_key": "run --api_key",
        "X=1 SECRET= run": "X=1 'SECRET=[redacted]' run",
        "run 'https://a:b@c/d'": "run 'https://[redacted]@c/d'",
        "run --tokens 3": "run --tokens 3",
    }.items():
        assert provenance.redact_command(raw) == told
    assert provenance.redact({"Token": 0, "auth": None, "password": [1]}) == {"Token": 0, "auth": None, "password": "[redacted]"}
    hidden = provenance.redact_command("HF_TOKEN=abc run --api-key k1 --seed 3 --password=p 'a b'")
    assert hidden == "'HF_TOKEN=[redacted]' run --api-key '[redacted]' --seed 3 '--password=[redacted]' 'a b'"
    assert provenance.redact({"command": "run --token t"}) == {"command": "run --token '[redacted]'"}
    for bad in (float("nan"), {1: 2}, object()):
        with pytest.raises(ValueError):
            provenance.redact(bad)
    with pytest.raises(ValueError, match="quoted"):
        provenance.redact_command("a 'b")
    with pytest.raises(ValueError, match="time zone"):
        provenance.run_context(0, {}, now=datetime(2026, 1, 1))
    assert provenance.seed_everything(3) == 3


def test_transcription_json(spark):
    rows = [("r", 1, 1.0, 2.0, "b", "word", ["w"]), ("r", 0, 0.0, 1.0, "a", "chunk", ["w"]), ("q", 0, 0.0, 1.0, "z", "word", [])]
    merged = spark.createDataFrame(rows, "recording string, pos int, start_s double, end_s double, text string, timing_precision string, warnings array<string>")
    told = json.loads(sinks.transcription_json(merged, "r", {"token": "t"}))
    assert (told["text"], told["warnings"], told["run_context"]) == ("a b", ["w"], {"token": "[redacted]"}) and len(told["segments"]) == 2
    lines = [r["value"] for r in sinks.prediction_lines(spark.createDataFrame([(0, "i", "h")], "pos long, id string, hypothesis string"), {"system": "s", "token": "t"}).collect()]
    assert json.loads(lines[0]) == {"predictions": {"system": "s", "token": "[redacted]"}} and json.loads(lines[1]) == {"id": "i", "hypothesis": "h"}


def lines(path, *records):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records), encoding="utf-8")


def test_report_from_files(spark, tmp_path):
    from quillspark.__main__ import report

    def segment(i, text, digest):
        return {"id": i, "audio": f"{i}.wav", "text": text, "duration_s": 2.0, "recording_id": f"r{i}", "audio_sha256": digest * 64}

    head = {"name": "m", "source": "s", "split": "test", "domain": "read", "version": "1"}
    lines(tmp_path / "m.jsonl", {"manifest": head}, segment("a", "এক দুই", "a"), segment("b", "তিন", "b"))
    lines(tmp_path / "t.jsonl", {"manifest": head | {"name": "t", "split": "train"}}, segment("c", "চার", "c"))
    lines(tmp_path / "p.jsonl", {"predictions": {"system": "tuned", "manifest": "m"}}, {"id": "a", "hypothesis": "এক"}, {"id": "b", "hypothesis": "তিন", "more": 1})
    fields = dict(id="s", name="n", url="u", license="l", access="open", status="approved", domain="read", version="1", notes="", confidence="high")
    (tmp_path / "l.toml").write_text("[[licenses]]\n" + "\n".join(f'{k} = "{v}"' for k, v in fields.items()))
    spec = {"name": "r", "title": "R", "slices": [{"name": "s1", "manifest": "m.jsonl"}, {"name": "s2", "manifest": "gone.jsonl", "domain": "long-form"}]}
    system = {"name": "tuned", "model_kind": "fine_tuned", "training_audit": "required", "train_manifests": ["t.jsonl"], "predictions": {"s1": "p.jsonl"}}
    (tmp_path / "spec.json").write_text(json.dumps(spec | {"systems": [system]}))
    given = [str(tmp_path / "spec.json"), str(tmp_path), str(tmp_path / "l.toml")]
    (tmp_path / "out").mkdir()
    _, data = report(spark, *given, str(tmp_path / "out"))
    cells = {c["slice"]: c for c in json.loads(open(data, encoding="utf-8").read())["cells"]}
    assert (cells["s1"]["norm_wer"], cells["s1"]["leakage"], cells["s2"]["pending"]) == (1 / 3, "CLEAN", "manifest unavailable")
    assert len(cells["s1"]["input_hashes"]["manifest"]) == 64
    found = evaluation.runs(evaluation.Spec.parse((tmp_path / "spec.json").read_text()))
    assert [(r["slice"], r["mode"]) for r in found] == [("s1", "bounded-short"), ("s2", "long-form-vad")]
    lines(tmp_path / "p.jsonl", {"predictions": {"system": "other", "manifest": "m"}}, {"id": "a", "hypothesis": "x"})
    with pytest.raises(ValueError, match="is not of tuned"):
        report(spark, *given, str(tmp_path / "out"))
