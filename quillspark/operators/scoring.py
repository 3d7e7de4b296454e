"""Pooled word and character error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.distance import char_distance, long_char_distance, long_word_distance, word_distance, words
from quillspark.functions.text import collapse_spaces, is_blank, normalize


def first_values(df: DataFrame, column: str = "id", most: int = 5) -> list:
    return [row[0] for row in df.select(column).orderBy(column).limit(most).collect()]


def require_empty(df: DataFrame, message: str, column: str = "id") -> None:
    """Raise ValueError with the first few values if df has rows."""
    found = first_values(df, column)
    if found:
        raise ValueError(f"{message}: {found}")


def join_hypotheses(segments: DataFrame, hypotheses: DataFrame, check: bool = True) -> DataFrame:
    """segments joined to hypotheses (id, hypothesis) on id; every id must be on both sides, once."""
    if check:
        for name, df in (("segments", segments), ("hypotheses", hypotheses)):
            require_empty(df.groupBy("id").count().where("count > 1"), f"duplicate ids in {name}")
        require_empty(hypotheses.join(segments, "id", "left_anti"), "hypotheses without a segment")
        require_empty(segments.join(hypotheses, "id", "left_anti"), "segments without a hypothesis")
    return segments.join(hypotheses, "id")


def pair_counts(pairs: DataFrame, prefix: str = "", reference: Column | None = None, hypothesis: Column | None = None, long_texts: bool = False) -> DataFrame:
    """pairs plus word and character errors and reference lengths of each (reference, hypothesis)."""
    ref = collapse_spaces(F.col("reference") if reference is None else reference)
    hyp = collapse_spaces(F.coalesce(F.col("hypothesis") if hypothesis is None else hypothesis, F.lit("")))
    by_word, by_char = (long_word_distance, long_char_distance) if long_texts else (word_distance, char_distance)
    return pairs.withColumns({"__ref": ref, "__hyp": hyp}).withColumns(
        {
            f"{prefix}word_errors": by_word("__ref", "__hyp") if long_texts else by_word(F.col("__ref"), F.col("__hyp")),
            f"{prefix}words": F.size(words(F.col("__ref"))).cast("long"),
            f"{prefix}char_errors": by_char("__ref", "__hyp") if long_texts else by_char(F.col("__ref"), F.col("__hyp")),
            f"{prefix}chars": F.length("__ref").cast("long"),
        }
    ).drop("__ref", "__hyp")


def pooled(counts: DataFrame, *keys: str, prefix: str = "") -> DataFrame:
    """Σ errors / Σ reference length for each key, not a mean of ratios; integers are summed, with map-side combine."""
    sums = [F.sum(f"{prefix}{c}").alias(f"{prefix}{c}") for c in ("word_errors", "words", "char_errors", "chars")]
    return counts.groupBy(*keys).agg(F.count("*").alias("segments"), *sums).withColumns(
        {
            f"{prefix}wer": F.col(f"{prefix}word_errors") / F.col(f"{prefix}words"),
            f"{prefix}cer": F.col(f"{prefix}char_errors") / F.col(f"{prefix}chars"),
        }
    )


def score(pairs: DataFrame, *keys: str, check: bool = True, long_texts: bool = False, normalizer=normalize) -> DataFrame:
    """Raw and normalised pooled rates of pairs (reference, hypothesis) in one pass.

    A reference that is blank raw or after normalisation is an error; an empty hypothesis is legal.
    """
    ready = pairs.withColumns({"__nref": normalizer(F.col("reference")), "__nhyp": normalizer(F.coalesce("hypothesis", F.lit("")))})
    if check:
        if ready.limit(1).count() == 0:
            raise ValueError("nothing to score")
        require_empty(ready.where(is_blank(F.col("reference")) | is_blank(F.col("__nref"))), "blank references", "reference")
    counts = pair_counts(ready, long_texts=long_texts)
    counts = pair_counts(counts, "norm_", F.col("__nref"), F.col("__nhyp"), long_texts)
    names = ("word_errors", "words", "char_errors", "chars")
    sums = [F.sum(p + c).alias(p + c) for p in ("", "norm_") for c in names]
    rates = {f"{p}{r}": F.col(f"{p}{e}_errors") / F.col(f"{p}{e}s") for p in ("", "norm_") for r, e in (("wer", "word"), ("cer", "char"))}
    return counts.groupBy(*keys).agg(F.count("*").alias("segments"), *sums).withColumns(rates)
