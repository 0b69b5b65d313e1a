"""Pair counts of a growing alignment with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.marginals import pair_bins


def streaming_bicounts(stream: DataFrame, length: int) -> DataFrame:
    """(i, j, a, b, n) of a stream with a column seq; state is one row a bin.  Write it in update or complete mode."""
    return pair_bins(stream, length).groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))


def windowed_bicounts(stream: DataFrame, length: int, time: str, width: str, late: str) -> DataFrame:
    """The same by event-time windows of ``width``; rows later than ``late`` are left out and their windows' state is dropped."""
    bins = pair_bins(stream.withWatermark(time, late), length, time)
    return bins.groupBy(F.window(time, width), "i", "j", "a", "b").agg(F.count("*").alias("n"))
