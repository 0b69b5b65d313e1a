"""Totals of timed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame, name: str, start: Column, end: Column) -> DataFrame:
    """(name, total, n): summed durations of each event name, longest first."""
    return events.groupBy(F.col(name).alias("name")).agg(F.sum(end - start).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), "name")
