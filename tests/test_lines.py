"""Readers over many splits against the standard library on whole files, and the ordered writer."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, lines, sinks
from quillspark.storage import held

SMALL = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def told(text):
    """(line, fields) by one reader over the whole text."""
    reader, line, out = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter="\t", strict=True), 1, []
    for fields in reader:
        out.append((line, fields))
        line = reader.line_num + 1
    return out


def table(rng, rows):
    cells = ["a", "", "é\u2028x", 'say "hi"', "two\nlines", "three\n\nlines\twith tab", "\n", 'q""q\n"', "x" * 300, "plain text"]
    out = io.StringIO()
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    for _ in range(rows):
        writer.writerow([rng.choice(cells) for _ in range(3)])
        if rng.random() < 0.1:
            out.write('mid "quote\tb\tc\n\n')
    return out.getvalue()


def test_quoted_records_over_splits(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"{k}.tsv": ("\ufeff" if k == 1 else "") + table(rng, rows) + ("a\tb\tlast" if k == 2 else "") for k, rows in enumerate((0, 60, 200, 5))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    with held(spark, SMALL):
        assert spark.read.text(str(tmp_path / "2.tsv"), lineSep="\n").rdd.getNumPartitions() > 20
        got = lines.quoted_records(spark, str(tmp_path / "*.tsv")).collect()
    for name, text in texts.items():
        assert sorted((r["line"], r["fields"]) for r in got if r["path"].endswith(name)) == told(text)


def test_errors_name_the_record(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("h\tk\n" + "x\ty\n" * 80 + 'x\t"open\n' + "z\tz\n" * 40)
    (tmp_path / "b.tsv").write_text("h\tk\n" + "x\ty\n" * 80 + "x\n")
    (tmp_path / "c.tsv").write_text("h\th\nx\ty\n")
    (tmp_path / "d.tsv").write_text("")
    with held(spark, SMALL):
        with pytest.raises(Exception, match="a.tsv:82"):
            lines.quoted_records(spark, str(tmp_path / "a.tsv")).collect()
        with pytest.raises(Exception, match="b.tsv:82"):
            files.named_rows(spark, str(tmp_path / "b.tsv"), ["h"]).collect()
        with pytest.raises(Exception, match="each name once"):
            files.named_rows(spark, str(tmp_path / "c.tsv"), ["h"]).collect()
        with pytest.raises(ValueError, match="without a header"):
            files.named_rows(spark, str(tmp_path / "d.tsv"), ["h"])


def test_lines_of_many_splits(spark, tmp_path):
    rng = random.Random(5)
    raw = [rng.choice(["", " ", "x", "é\u2028y", "z" * 150, "w\r"]) for _ in range(400)]
    (tmp_path / "t").write_text("\ufeff" + "\n".join(raw), encoding="utf-8", newline="")
    want = [(k, t.removesuffix("\r")) for k, t in enumerate(raw, 1) if t.strip()]
    with held(spark, SMALL):
        got = sorted((r["line"], r["nth"], r["value"]) for r in lines.numbered_lines(spark, str(tmp_path / "t")).collect())
    assert got == [(line, n, t) for n, (line, t) in enumerate(want, 1)]


def test_ordered_parts_are_one_manifest(spark, tmp_path):
    n = 300
    names = ("id", "audio", "text", "duration_s", "recording_id", "start_s", "speaker", "language", "audio_sha256")
    rows = spark.range(n).select(F.col("id").alias("pos"), *(F.concat(F.lit(f"{c}-"), F.col("id")).alias(c) if c not in ("duration_s", "start_s") else F.lit(1.5).alias(c) for c in names))
    header = {"name": "m", "source": "s", "split": "dev", "domain": "read", "version": "1"}
    path = tmp_path / "m"
    with held(spark, SMALL):
        sinks.write_lines(sinks.manifest_lines(rows.repartition(7), header), str(path))
        parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
        texts = "".join(p.read_text() for p in parts).splitlines()
        back = {r["pos"]: r for r in files.read_manifests(spark, str(path)).collect()}
    assert len(parts) > 1 and json.loads(texts[0]) == {"manifest": header}
    assert [json.loads(t)["id"] for t in texts[1:]] == [f"id-{k}" for k in range(n)]
    assert sorted(back) == list(range(n)) and all(back[k]["id"] == f"id-{k}" for k in range(n))
    shas = [hashlib.sha256(p.read_bytes()).hexdigest() for p in parts]
    assert back[0]["manifest_sha256"] == hashlib.sha256("".join(shas).encode()).hexdigest()


def test_a_failing_job_leaves_no_parts(spark, tmp_path):
    bad = spark.range(50).select(F.col("id").alias("pos"), F.when(F.col("id") == 49, F.raise_error(F.lit("stop"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_lines(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not [p for p in (tmp_path / "out").rglob("*part-*") if not p.name.startswith(".")]


def test_predictions_repeated(spark, tmp_path):
    rows = [{"id": f"i{k}", "hypothesis": "h"} for k in range(40)] + [{"id": "i3", "hypothesis": "h"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, [{"predictions": {"system": "s", "manifest": "m"}}, *rows])))
    with held(spark, SMALL), pytest.raises(Exception, match="p.jsonl:42: ids must be unique"):
        files.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()
