"""Streams of decoder segments: the confidence filter is stateless, so it is the batch operator on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.segments import Limits, judge


def filtered_stream(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return judge(segments, limits).where("kept").drop("failed", "kept")


def windowed_summary(segments: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Kept and dropped segments of each time window, behind a watermark."""
    judged = judge(segments.withWatermark(time, late))
    return judged.groupBy(F.window(time, width)).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
