"""Toxicity by a chain of linear classifiers (operator 2)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.storage import store, table

#: The chain, in order: a name and the condition on a labelled row.  `labels` tells one category of toxicity, which is
#: the last link; the link before it is low quality, the one other category that the table knows.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Most labelled documents that the models are fitted on, those of least hash of their id.
TRAINING_ROWS = 6000
#: Word features of a model, those that tell its category apart best.
SELECTED = 1024
FOLDS = 5
PREFIXES = (3, 4, 5, 6)
REMEMBERED = 150_000

WORDS = re.compile(r"[^\W\d_]+")
UPPER = regex.compile(r"\p{Uppercase}+")


def word_features(word: str) -> list[int]:
    """Hashes of a word and its prefixes."""
    forms = [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(x.encode()) for x in forms]


def shape(text: str, words: int, letters: int) -> list[float]:
    """Features of a text beside its words, of which it has so many distinct ones and so many letters in all."""
    n = max(1, len(text))
    upper = sum(map(len, UPPER.findall(text)))
    lines = text.split("\n")
    return [
        np.log1p(words),
        letters / n,
        upper / max(1, letters),
        text.count("|") / n * 10,
        len(set(lines)) / len(lines),
        words / max(1, len(text.split())),
    ]


SHAPES = 6


@dataclass
class Linear:
    """A logistic model of selected word features (presence), text shape and earlier categories."""

    chosen: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, present: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(dense), 1)), (dense - self.mean) / self.scale, present])

    def probability(self, present: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(present, dense) @ self.weights, -30, 30)))


def presence(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """rows x chosen matrix of which hashes a row has; chosen is sorted."""
    out = np.zeros((len(rows), len(chosen)), np.float64)
    for k, row in enumerate(rows):
        at = np.searchsorted(chosen, row)
        at[at == len(chosen)] = 0
        hit = at[chosen[at] == row] if len(chosen) else at[:0]
        out[k, hit] = 1
    return out


def select(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The hashes whose document shares differ most between the two classes, for their standard error."""
    if not len(rows):
        return np.zeros(0, np.uint32)
    keys, at = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    inside = np.bincount(at, weights=y[owner], minlength=len(keys))
    total = np.bincount(at, minlength=len(keys))
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    p1, p0 = (inside + 0.5) / (n1 + 1), (total - inside + 0.5) / (n0 + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    good = np.flatnonzero((total >= 3) & (np.abs(z) > 2))
    best = good[np.argsort(-np.abs(z[good]), kind="stable")[:most]]
    return np.sort(keys[best])


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, most: int = SELECTED, ridge: float = 1.0) -> Linear:
    """Ridge logistic regression by Newton steps, on features selected from the same rows."""
    chosen = select(rows, y, most)
    scale = dense.std(axis=0)
    model = Linear(chosen, dense.mean(axis=0), np.where(scale > 0, scale, 1), np.zeros(1 + dense.shape[1] + len(chosen)))
    x = model.inputs(presence(rows, chosen), dense)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = model.weights
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return model


def fit_chain(rows: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model for each column of labels; later ones also see earlier categories' probabilities.

    The probabilities that a later model is trained with are out of fold: each from a model that was fitted,
    with its feature selection, without that row.
    """
    chain = []
    fold = np.arange(len(rows)) % folds
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        chain.append(fit(rows, dense, y))
        if c + 1 < labels.shape[1]:
            seen = np.zeros(len(rows))
            for k in range(folds):
                train, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                if len(train) and len(held):
                    part = fit([rows[i] for i in train], dense[train], y[train])
                    seen[held] = part.probability(presence([rows[i] for i in held], part.chosen), dense[held])
            dense = np.hstack([dense, seen[:, None]])
    return chain


def featurize(text: str | None) -> tuple[set[str], list[float]]:
    text = text or ""
    found = WORDS.findall(text)
    words = {w.lower() for w in set(found)}
    return words, shape(text, len(words), sum(map(len, found)))


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, most_rows: int = TRAINING_ROWS) -> list[Linear]:
    """The chain, fitted on at most most_rows labelled documents; empty if there are none.

    Labels with a null among the categories' columns are left out; of repeated labels of a document any
    positive one counts, and of repeated documents the one of least text hash.  The sample's words are hashed on the
    executors; only the sample reaches the driver, one row a label.  Labels without a document are no sample, and an
    empty table of documents or labels gives an empty chain.
    """
    given = labels.select("doc_id", *(F.expr(f"int({rule})").alias(name) for name, rule in categories))
    given = given.na.drop().groupBy("doc_id").agg(*(F.max(name).alias(name) for name, _ in categories))
    sample = store(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "labelled")
    names = [name for name, _ in categories]

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [featurize(t) for t in frame.text]
            yield pd.DataFrame(
                {
                    "doc_id": frame.doc_id,
                    "hashes": [
                        np.unique(np.array([h for w in words for h in word_features(w)], np.uint32)).tobytes()
                        for words, _ in found
                    ],
                    "dense": [s for _, s in found],
                }
                | {n: frame[n] for n in names}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most most_rows rows of a few integers
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    known = known.groupBy("doc_id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = known.mapInPandas(
        hashed, f"doc_id {kind}, hashes binary, dense array<double>, " + ", ".join(f"{n} int" for n in names)
    )
    got = rows.toPandas().sort_values(["doc_id", "hashes"]).reset_index(drop=True)
    if not len(got):
        return []
    words = [np.frombuffer(x, np.uint32) for x in got.hashes]
    return fit_chain(words, np.array(got.dense.tolist()), got[names].to_numpy())


class Scorer:
    """Probabilities of texts; remembers which selected features a word has, up to a bound."""

    def __init__(self, chain: list[Linear]):
        self.chain = chain
        everything = np.unique(np.concatenate([m.chosen for m in chain])) if chain else np.zeros(0, np.uint32)
        self.number = {int(h): k for k, h in enumerate(everything)}
        self.columns = [np.searchsorted(everything, m.chosen) for m in chain]
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        present = np.zeros((len(texts), len(self.number)))
        dense = np.zeros((len(texts), SHAPES))
        known, number = self.known, self.number
        for k, text in enumerate(texts):
            words, dense[k] = featurize(text)
            if len(known) > REMEMBERED:
                known.clear()
            hit: set[int] = set()
            for w in words:
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple({number[h] for h in word_features(w) if h in number})
                if own:
                    hit.update(own)
            if hit:
                present[k, list(hit)] = 1
        out = np.zeros((len(texts), len(self.chain)))
        for c, model in enumerate(self.chain):
            out[:, c] = model.probability(present[:, self.columns[c]], dense)
            dense = np.hstack([dense, out[:, c : c + 1]])
        return out


def probabilities(docs: DataFrame, chain: list[Linear], categories=CATEGORIES, threshold: float = 0.5) -> DataFrame:
    """docs plus p_<category> for each category of the chain and rejected, the last one's above threshold.

    Row-local.  Defined results: null and empty texts are scored as texts without words; without a single
    labelled row all probabilities are 0; columns of docs that have our names are overwritten.
    """
    names = [f"p_{name}" for name, _ in categories]

    @F.pandas_udf("array<double>")
    def scores(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(chain)
        for texts in series:
            parts = [scorer(texts.iloc[k : k + 500].tolist()) for k in range(0, len(texts), 500)]
            rows = np.vstack(parts) if parts and chain else np.zeros((len(texts), len(names)))
            yield pd.Series(list(rows), index=texts.index)

    scored = docs.withColumn("__scores", scores("text"))
    out = scored.withColumns({n: F.col("__scores")[k] for k, n in enumerate(names)}).drop("__scores")
    return out.withColumn("rejected", F.col(names[-1]) > threshold)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all documents and whether they are rejected as toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return probabilities(docs.select("doc_id", "text"), chain).drop("text").withColumnRenamed("rejected", "toxic")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the chain does not reject, with all their columns."""
    rows = docs.select(F.col("text"), F.struct("*").alias("row"))
    return probabilities(rows, train(docs, labels)).where("not rejected").select("row.*")
