"""Pair histograms as dense vectors.

A task counts its sequences into vectors of whole ranges of pairs: one bincount a pair and batch, and no row for a sequence and pair.  Vectors of a range are then added
up in a tree: each round adds the vectors of ``FAN`` tasks, so no task gets those of all.  A model with more bins than a task holds is cut into
stretches of ranges, each of which reads the sequences for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Bins of a range of pairs, bins that a task holds at most (8 bytes each), and vectors that are added up at once.
RANGE_BINS, HELD_BINS, FAN = 1 << 17, 1 << 24, 32
#: Sequences that are counted at once.
ROWS = 4096
VECTORS = "part int, chunk int, v array<double>"


def dense_counts(rows: DataFrame, length: int, q: int, whole: bool) -> DataFrame:
    """(i, j, a, b, n), all bins: summed n of the sequences of ``rows`` (seq, n); long if ``whole``, else double.

    Null sequences count nowhere.  A letter that isn't below q, and a sequence of another length, are errors.  Whole numbers are exact up to 2^53.
    """
    ship(rows.sparkSession)
    pairs = [(i, j) for i in range(length - 1) for j in range(i + 1, length)]
    per = max(1, RANGE_BINS // (q * q))
    chunks = ceil(len(pairs) / per)
    stretch = max(1, HELD_BINS // (per * q * q))
    stretches = ceil(chunks / stretch)
    rows = rows.where("seq is not null").select("seq", F.col("n").cast("double").alias("n"))

    def count(batches: Iterator[pa.RecordBatch], own: int) -> Iterator[pa.RecordBatch]:
        first, last = own * stretch, min(chunks, (own + 1) * stretch)
        mine = pairs[first * per : last * per]
        bins = np.zeros((len(mine), q * q))
        some = False
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                flat = part.column(0).flatten()
                if len(flat) != length * part.num_rows or flat.null_count:
                    raise ValueError(f"a sequence hasn't {length} letters")
                s = np.ascontiguousarray(np.asarray(flat, np.int64).reshape(-1, length).T)
                if s.min() < 0 or s.max() >= q:
                    raise ValueError(f"a letter isn't one of {q}")
                w = part.column(1).to_numpy()
                first_letter = s * q
                for p, (i, j) in enumerate(mine):
                    bins[p] += np.bincount(first_letter[i] + s[j], w, q * q)
                some = True
        if some:
            task = TaskContext.get().partitionId()
            for c in range(first, last):
                v = bins[(c - first) * per : (c - first + 1) * per].reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([c], pa.int32()), pa.ListArray.from_arrays([0, len(v)], pa.array(v))], names=["part", "chunk", "v"])

    parts = rows.mapInArrow(lambda batches: count(batches, 0), VECTORS)
    for own in range(1, stretches):
        parts = parts.unionByName(rows.mapInArrow(lambda batches, own=own: count(batches, own), VECTORS))
    tasks = _tasks(rows)
    while tasks > FAN:
        tasks = ceil(tasks / FAN)
        parts = _added(parts.withColumn("part", F.expr(f"cast(part % {tasks} as int)")), True)
    return _rows(_added(parts, False), pairs, per, q, whole)


def _tasks(rows: DataFrame) -> int:
    """About how many tasks read ``rows``, by the planner's size of it: a guess only makes rounds of adding up more or fewer."""
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(1 << 20, size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() + spark.sparkContext.defaultParallelism)


def _added(parts: DataFrame, by_part: bool) -> DataFrame:
    """Vectors of each chunk, or of each chunk and part, added up."""

    def add(t: pa.Table) -> pa.Table:
        v = sum(x.values.to_numpy() for x in t.column("v"))
        return pa.Table.from_arrays([t.column("part").slice(0, 1), t.column("chunk").slice(0, 1), pa.chunked_array([pa.ListArray.from_arrays([0, len(v)], pa.array(v))])], names=["part", "chunk", "v"])

    return parts.groupBy(*(("part", "chunk") if by_part else ("chunk",))).applyInArrow(add, VECTORS)


def _rows(vectors: DataFrame, pairs: list[tuple[int, int]], per: int, q: int, whole: bool) -> DataFrame:
    """The bins of all chunks as rows; those of chunks that nothing was counted for are zero."""
    every = np.array(pairs, np.int32).reshape(-1, 2)
    a, b = np.divmod(np.arange(q * q, dtype=np.int32), q)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine = every[batch.column(0)[k].as_py() * per :][:per]
                v = batch.column(1)[k].values
                v = v.to_numpy() if v is not None else np.zeros(len(mine) * q * q)
                keys = (np.repeat(mine[:, 0], q * q), np.repeat(mine[:, 1], q * q), np.tile(a, len(mine)), np.tile(b, len(mine)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(v.astype(np.int64) if whole else v)], names=["i", "j", "a", "b", "n"])

    chunks = vectors.sparkSession.range(ceil(len(pairs) / per)).select(F.col("id").cast("int").alias("chunk"))
    return chunks.join(vectors.select("chunk", "v"), "chunk", "left").mapInArrow(unpack, f"i int, j int, a int, b int, n {'long' if whole else 'double'}")
