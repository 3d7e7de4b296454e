"""Mixing sources to target weights with built-in functions only (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.storage import store, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Least rows of a key range; ranges of a source with n rows hold about the square root of n beyond that.
RANGE_ROWS = 1024


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, place, rows, source_size, target), one row for each source of sizes (source, size).

    Sources by code point, null last, weigh weights, repeating; they share the fraction `share` of all words.
    A target stops at cap times its source's size; what is above is shared anew by weight until none is above:
    the capped sources are those of least cap for their weight, found by running sums in that order.
    The windows run over one row a source, never over documents.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1).cast("double")
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    known = each.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    known = known.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("most").over(by_cap), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))),
    )
    known = known.withColumn("capped", F.col("level") * F.col("weight") >= F.col("most"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("most")).otherwise((F.col("budget") - used) / free * F.col("weight"))
    return known.select("source", "place", "rows", "source_size", target.alias("target"))


def mix(rows: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """rows, which have __id, __source, __size and __mark (a hash of the text), plus __source_size, __target and __taken.

    Each row gets a hash-random key of id, size and mark, so rows share a key if they are equal in all of them.  A source's keys fall into ranges; range totals give each range its
    start, and a running sum inside a range gives each row its place in the source's order.  A source's
    budget is the whole part of its target: whole passes over the source, then rows in key order, the row at
    the budget's end in part.  Hot sources only have more ranges, so no task grows with a source.

    Defined results: null ids and sources are values like others; rows equal in id and text are
    interchangeable; sources without words have target 0; an empty table gives an empty one.
    """
    keyed = rows.withColumn("__key", F.xxhash64("__id", "__size", "__mark", F.lit(seed)))
    plain = keyed.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key"))
    sources = store(source_targets(plain, share, weights, cap), "sources")

    def ranged(df: DataFrame, source: str, key: str) -> DataFrame:
        """df with its source's figures and the number of its key range, which rises with the key."""
        own = sources.withColumnRenamed("source", "__name")
        ranges = F.ceil(F.col("rows") / F.greatest(F.lit(RANGE_ROWS), F.sqrt("rows")))
        at = F.floor((F.col(key).cast("double") / F.lit(2.0**64) + F.lit(0.5)) * ranges)
        return df.join(own, df[source].eqNullSafe(own["__name"])).withColumn("range", F.least(at, ranges - 1).cast("long"))

    totals = ranged(plain, "source", "key").groupBy("place", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(
        totals.select(
            F.col("place").alias("__place"),
            F.col("range").alias("__range"),
            F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("__range_start"),
        ),
        "starts",
    )
    names = [F.col(f"`{c}`") for c in rows.columns]
    own = ranged(keyed, "__source", "__key").select(
        *names,
        "__key",
        F.col("place").alias("__place"),
        F.col("range").alias("__range"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
    )
    inside = Window.partitionBy("__place", "__range").orderBy("__key", "__id", "__size", "__mark")
    running = F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = running - F.col("__size") + F.col("__range_start")
    budget = F.floor("__target").cast("long")
    passes = F.when(F.col("__source_size") > 0, F.expr("floor(__target) div __source_size")).otherwise(0)
    rest = budget - passes * F.col("__source_size")
    taken = passes * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - start))
    return own.join(starts, ["__place", "__range"]).select(
        *names, "__source_size", "__target", taken.cast("long").alias("__taken")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of docs."""
    sizes = store(
        docs.select(
            F.col("doc_id").alias("__id"), F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"), F.xxhash64("text").alias("__mark")
        ),
        "sizes",
    )
    return mix(sizes).select(
        F.col("__id").alias("doc_id"),
        F.col("__source").alias("source"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return mixture(table(spark, sf_dir, "documents")).drop("source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as mixed: a row for every whole pass that takes it, and one cut behind the last word taken.

    n_chars of a cut row is the length of its text.
    """
    rows = docs.select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        word_count(F.col("text")).alias("__size"),
        F.xxhash64("text").alias("__mark"),
        F.struct("*").alias("row"),
    )
    mixed = mix(rows)
    whole = F.when(F.col("__size") > 0, F.expr("__taken div __size")).otherwise(0)
    part = F.when(F.col("__size") > 0, F.col("__taken") % F.col("__size")).otherwise(0)
    lengths = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    spread = mixed.select("row", F.explode(lengths).alias("__cut"))
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__cut") < 0, F.col("row.text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col("__cut").cast("int")), "")
    )
    n_chars = F.when(F.col("__cut") < 0, F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0)).otherwise(F.length(text))
    made = {"text": text, "n_chars": n_chars}
    return spread.select([made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
