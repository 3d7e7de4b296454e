"""Operator 12 against the vocabulary's library on whole texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quillspark.llm import pieces

DOC = "doc_id long, text string, batch string, number int, `odd name` string"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    signs = ["a", "the", "é", "日本", "😀", " ", "  ", "\n", "\t", "▁", "▁▁", "x́", "​", "<s>", "</s>", "<0x0A>", "\x00", "﻿", "ß", "　", "\xa0", "1234", ".,", " " * 40]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300)]
    texts += [None, "", " ", "  ", "▁", "a", " a ", "word " * 30_000, "x" * 20_000, "日" * 5000, texts[0], texts[0]]
    rows = [(k, t, "b", 1, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id", "b", 1, "x"), rows[3]], DOC).repartition(5).cache()


@pytest.mark.parametrize("block", [50, pieces.BLOCK])
def test_ids_and_texts(docs, model, block):
    got = pieces.encode(docs, block=block).collect()
    want = []
    for row in docs.collect():
        ids = model.encode(row["text"] or "")
        want.append((row["doc_id"], ids, model.decode(ids)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query(spark, docs, model, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pieces.op12(spark, f"file://{tmp_path}").collect()}
    for row in docs.collect():
        ids, found = model.encode(row["text"] or ""), got[row["doc_id"]]
        assert found["n_tokens"] == len(ids) and found["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    docs.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert pieces.op12(spark, f"file://{tmp_path}/none").count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.ChunkModel(str(tmp_path / "none"))
