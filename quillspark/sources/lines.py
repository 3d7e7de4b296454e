"""Lines and quoted records of text files of any size, by Spark's own splits.

Spark's text source cuts files into splits in any store that it reads, so a file is many tasks and has no bound of
size.  Lines keep the numbers that they have in their file: those of a split start behind the splits before it.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank

INSIDE = re.compile(r'(?:[^"]|"")*')


#: Parts of a folder that Spark wrote are one text, in order of their names.
PART = r"/part-\d+[^/]*$"


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): lines by split; blocks sort as they stand in a text, at grows by one from line to line.

    path is the file, or the folder of which it is a part.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    block = F.concat(file, F.lit("#"), F.lpad(start.cast("string"), 20, "0"))
    mark = (start == 0) & F.startswith("value", F.lit("\ufeff"))
    value = F.when(mark, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.regexp_replace(file, PART, "").alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("at"), value.alias("value"))


def _starts(lines: DataFrame, at: str = "at", before: str = "before") -> DataFrame:
    """(path, block, first, before): where at begins in a split, and the lines of its text before it; one row a split."""
    splits = lines.groupBy("path", "block").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, nth, value): the lines that are not blank, with their number in the text and among such lines, from 1.

    Lines end at line feeds only; a byte-order mark and a carriage return at a line's end are left out.  Only rows of a
    split are counted and joined; lines are not sorted or shuffled while those rows are few.
    """
    lines = _split_lines(spark, path)
    kept = lines.where(~is_blank(F.col("value"))).withColumn("own", F.monotonically_increasing_id())
    places = _starts(lines).join(_starts(kept, "own", "earlier").withColumnRenamed("first", "own_first"), ["path", "block"])
    told = kept.join(places, ["path", "block"])
    line = F.col("before") + F.col("at") - F.col("first") + 1
    nth = F.col("earlier") + F.col("own") - F.col("own_first") + 1
    return told.select("path", line.alias("line"), nth.alias("nth"), F.regexp_replace("value", "\r\\z", "").alias("value"))


def ends_quoted(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a line that begins at a record's start, or inside a quoted field, ends inside one."""
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            at = INSIDE.match(line, at if inside else at + 1).end()
            if at >= len(line):
                return True
            inside = False
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _summaries(delimiter: str):
    """A split's rows to one: for either state at its start, whether it ends inside a record and where that began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for path, block, at, value in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "at", "value")), strict=True):
                own = found.setdefault((path, block), [False, True, None, None])
                if '"' in value:
                    for k in (0, 1):
                        after = ends_quoted(value, delimiter, own[k])
                        if after and not own[k]:
                            own[k + 2] = at
                        elif not after:
                            own[k + 2] = None
                        own[k] = after
        rows = [(*key, *own) for key, own in found.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "block", "out0", "out1", "open0", "open1"])

    return run


def _carried(frame: pd.DataFrame) -> pd.DataFrame:
    """For each split of a file, in order, whether it begins inside a record and at which line that record began."""
    inside, opened, out = False, None, []
    for row in frame.sort_values("block").itertuples(index=False):
        out.append((row.path, row.block, row.first, row.before, inside, opened))
        after, at = (row.out1, row.open1) if inside else (row.out0, row.open0)
        if after and not pd.isna(at):
            opened = int(row.before + at - row.first + 1)
        inside = bool(after)
        opened = opened if inside else None
    told = pd.DataFrame(out, columns=["path", "block", "first", "before", "inside", "opened"])
    return told.astype({"opened": "Int64"})


def _parsed(path: str, line: int, text: str, delimiter: str) -> list[list[str]]:
    try:
        return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True))
    except csv.Error as e:
        raise ValueError(f"{path}:{line}: {e}") from e


def quoted_records(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """(path, line, fields) of delimited text: strict quoting, quoted line breaks kept, line that of a record's start.

    A split may begin inside a quoted field.  One pass tells for each split how it would end from either state; the
    states at the splits' starts follow from these, a row a split; a second pass knows them.  Records within a line
    are parsed where they are read, only the lines of longer ones are brought together.
    """
    lines = _split_lines(spark, path)
    told = lines.mapInArrow(_summaries(delimiter), "path string, block string, out0 boolean, out1 boolean, open0 long, open1 long")
    # a split is in one task, so it has one row
    states = _starts(lines).join(told, ["path", "block"]).groupBy("path")
    carried = states.applyInPandas(_carried, "path string, block string, first long, before long, inside boolean, opened long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "block", "at", "value", "first", "before", "inside", "opened")
        current, inside, opened = None, False, None
        for batch in batches:
            out = []
            for name, block, at, value, first, before, starts_inside, starts_opened in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (name, block) != current:
                    current, inside, opened = (name, block), starts_inside, starts_opened
                line = before + at - first + 1
                after = ends_quoted(value, delimiter, inside) if '"' in value else inside
                if after and not inside:
                    opened = line
                if inside or after:
                    out.append((name, opened, line, None, value))
                else:
                    out += [(name, line, line, fields, None) for fields in _parsed(name, line, value, delimiter) or [[]]]
                inside = after
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "line", "part", "fields", "value"])

    schema = "path string, line long, part long, fields array<string>, value string"
    ordered = lines.join(carried, ["path", "block"]).sortWithinPartitions("path", "block", "at")
    parts = ordered.mapInArrow(run, schema)

    @F.udf("array<array<string>>")
    def record(name: str, line: int, text: str) -> list[list[str]]:
        return _parsed(name, line, text, delimiter)

    long = parts.where("fields IS NULL").groupBy("path", "line").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part", "value")))["value"], "\n").alias("text"))
    joined = long.select("path", "line", F.explode(record("path", "line", "text")).alias("fields"))
    return parts.where("fields IS NOT NULL").select("path", "line", "fields").unionByName(joined)
