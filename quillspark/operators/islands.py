"""Merging of recordings of any length: a recording is cut where nothing overlaps, and its islands are merged apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.segments import joined, merge_sorted
from quillspark.storage import store


def earlier(ranged: DataFrame, key: str, order: list[str], columns: dict[str, Column], take: Callable = F.max, both: Callable = F.greatest) -> DataFrame:
    """ranged plus, by name, what take gives of a column over the key's earlier rows; null for its first.

    ranged is in ranges of key and order, numbered by __part.  A window sees a key's rows of one range; those of the ranges
    before come as one value a key and range.
    """
    rows = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("__part").alias("__range"), F.col(key).alias("__key")).agg(*(take(c).alias(f"__of_{n}") for n, c in columns.items()))
    carried = totals.select("__range", "__key", *(take(f"__of_{n}").over(ranges).alias(f"__to_{n}") for n in columns))
    inside = ranged.withColumns({n: take(c).over(rows) for n, c in columns.items()})
    joined = inside.join(carried, (F.col("__part") == F.col("__range")) & F.col(key).eqNullSafe(F.col("__key")))
    met = {n: F.when(F.col(n).isNull(), F.col(f"__to_{n}")).when(F.col(f"__to_{n}").isNull(), F.col(n)).otherwise(both(F.col(n), F.col(f"__to_{n}"))) for n in columns}
    return joined.withColumns(met).drop("__range", "__key", *(f"__to_{n}" for n in columns))


def with_islands(chunks: DataFrame, key: str) -> DataFrame:
    """chunks plus __island, the time at which its island begins, and __home, the range that holds that; stored.

    A chunk reaches from the first to the last of its own and its words' times.  An island begins where all earlier
    chunks have ended, and began before; chunks of different islands cannot repeat each other.
    """
    words = F.col("words")
    low = F.least("start_s", F.col("start_s") + F.array_min(F.transform(words, lambda w: w.start_s)))
    high = F.greatest("end_s", F.col("start_s") + F.array_max(F.transform(words, lambda w: w.end_s)))
    timed = chunks.withColumns({"__low": low, "__high": high})
    ranged = store(timed.repartitionByRange(key, "__low").withColumn("__part", F.spark_partition_id()), "chunk-ranges")
    known = earlier(ranged, key, ["__low", "pos"], {"__ended": F.col("__high"), "__began": F.col("start_s")})
    cut = F.col("__ended").isNull() | ((F.col("__low") >= F.col("__ended")) & (F.col("__low") > F.col("__began")))
    begin = F.when(cut, F.struct(F.col("__low").alias("at"), F.col("__part").alias("home")))
    flagged = store(known.select(*ranged.columns, begin.alias("__begin")), "chunk-cuts")
    found = earlier(flagged, key, ["__low", "pos"], {"__last": F.col("__begin")})
    own = F.coalesce("__begin", "__last")
    return found.select(*chunks.columns, own["at"].alias("__island"), own["home"].alias("__home"))


def merged_islands(chunks: DataFrame, key: str) -> DataFrame:
    """(key, __part, __island, segments, warnings): a row for each island from which something stays; __part is its range.

    A task goes through sorted islands and holds the chunks of one, not of a recording.
    """
    found = with_islands(chunks.select(key, "pos", "start_s", "end_s", "text", "words"), key)
    found = found.withColumnRenamed("__home", "__part")
    dealt = found.repartition(key, "__part", "__island").sortWithinPartitions(key, "__part", "__island", "pos")
    return merge_sorted(dealt, key, "__part", "__island")


def merge_islands(chunks: DataFrame, key: str = "recording") -> DataFrame:
    """(key, pos, start_s, end_s, text, timing_precision, warnings): the rows of merge_transcriptions, island by island.

    Defined results: a null key is a recording of its own; null and empty words are a chunk without word times; a table
    without rows gives none; times must be finite and no chunk may end before it starts (chunk_violations tells those
    that do).
    """
    merged = store(merged_islands(chunks, key), "islands")
    place = earlier(merged, key, ["__island"], {"__before": F.size("segments").cast("long")}, F.sum, lambda a, b: a + b).drop("warnings")
    told = merged.where("size(warnings) > 0").select(F.col(key).alias("__key"), "__island", F.posexplode("warnings").alias("__nth", "warning"))
    first = told.groupBy("__key", "warning").agg(F.min(F.struct("__island", "__nth")).alias("at"))
    warned = first.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "warning")))["warning"].alias("warnings"))
    rows = place.join(warned, F.col(key).eqNullSafe(F.col("__key")), "left")
    rows = rows.select(key, F.coalesce("__before", F.lit(0)).alias("__before"), F.posexplode("segments").alias("__row", "s"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    return rows.select(key, (F.col("__before") + F.col("__row")).cast("int").alias("pos"), "s.*", "warnings")


def transcripts(chunks: DataFrame, key: str = "recording") -> DataFrame:
    """(key, text, duration_s) of recordings merged island by island: a row an island is brought together, not one a segment."""
    text, end = joined(F.col("segments"))
    told = merged_islands(chunks, key).select(key, F.struct("__island", text.alias("text")).alias("told"), end.alias("end"))
    grouped = told.groupBy(key).agg(F.array_sort(F.collect_list("told")).alias("told"), F.max("end").alias("duration_s"))
    return grouped.select(key, F.array_join(F.col("told")["text"], " ").alias("text"), "duration_s")
